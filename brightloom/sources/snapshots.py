"""Keyed tables in versions: upserts and deletes by key that rewrite only the buckets concerned.

Rows lie in buckets by the hash of ``bucket_by``, a part of the key such as a
parent's id. A version is a small file that names the folders of each bucket. A
write puts the buckets that it changes into new folders and then moves its
version's file into place, which fails where another writer has taken the
number. So a reader sees one version from beginning to end, whatever is written
meanwhile, and a write that fails leaves nothing that is ever read.

Defined cases: of several new rows of a key the one that sorts last stays; a
null in a key is a value like any other; a change that names no row makes no
version; a bucket without rows has no folder; new columns are not taken, columns
that are left out are null.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


OLD, GONE, NEW = range(3)  # of rows of a key the last of these is what becomes of it
FILES_A_TASK = 4  # files of all buckets that a task writes, about


class TakenVersion(RuntimeError):
    """Another writer has made the next version; read again and try again."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.files = self._place(self.path).getFileSystem(self.conf)

    def _place(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _version_path(self, number: int) -> str:
        return f"{self.path}/versions/{number:012d}.json"

    def versions(self) -> list[int]:
        """Numbers of the versions that are there, in order."""
        place = self._place(f"{self.path}/versions")
        if not self.files.exists(place):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        """What a version consists of; the last one if not told which."""
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no table at {self.path}")
        stream = self.files.open(self._place(self._version_path(known[-1] if version is None else version)))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> int:
        number = manifest["version"]
        own = self._place(f"{self.path}/versions/.{uuid.uuid4().hex}")
        stream = self.files.create(own, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        # A plain rename of some file systems replaces what is there; this one never does.
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        target = self._place(self._version_path(number))
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(own, target, options)
        except Exception as e:
            self.files.delete(own, False)
            if self.files.exists(target):
                raise TakenVersion(f"version {number} of {self.path} was made by another writer") from e
            raise
        return number

    def _dealt(self, rows: DataFrame, manifest: dict) -> DataFrame:
        return rows.withColumn("__bucket", F.pmod(F.xxhash64(*manifest["bucket_by"]), F.lit(manifest["buckets"])).cast("int"))

    def _shaped(self, rows: DataFrame, manifest: dict, rank: int) -> DataFrame:
        """``rows`` with the table's columns; of rows of a key those with the greatest rank count."""
        schema = StructType.fromJson(manifest["schema"])
        shaped = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        return rows.select(*shaped, F.lit(rank).alias("__rank"))

    def _write(self, ranked: DataFrame, manifest: dict) -> dict[str, str]:
        """Write the last row of each key into new folders, one a bucket; the folders by bucket.

        One shuffle deals rows out by bucket and key, so that keys meet where
        their bucket's files are written; a bucket has several.
        """
        out = f"{self.path}/data/{uuid.uuid4().hex}"
        keys, names = manifest["keys"], [f["name"] for f in manifest["schema"]["fields"]]
        rest = [n for n in names if n not in keys]
        spread = -(-FILES_A_TASK * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // manifest["buckets"])
        dealt = self._dealt(ranked, manifest).withColumn("__file", F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(spread)).cast("int"))
        last = dealt.repartition("__bucket", "__file").groupBy("__bucket", "__file", *keys).agg(F.max(F.struct("__rank", *rest)).alias("__r")).where(F.col("__r.__rank") != GONE)
        last = last.select("__bucket", *[F.col(f"__r.{n}").alias(n) if n in rest else F.col(n) for n in names])
        try:
            last.write.partitionBy("__bucket").parquet(out)
        except Exception:
            self.files.delete(self._place(out), True)
            raise
        names = [s.getPath().getName() for s in self.files.listStatus(self._place(out)) if s.isDirectory()]
        return {n.split("=")[1]: f"{out}/{n}" for n in names}

    def _named(self, rows: DataFrame, keys: list[str], manifest: dict) -> DataFrame:
        """The columns of ``rows`` that name the table's rows, in the table's types, so that equal keys have one bucket."""
        return self._shaped(rows.select(*keys), manifest, NEW).select(*keys)

    def create(self, rows: DataFrame, keys: list[str], bucket_by: list[str] | None = None, buckets: int = 16) -> int:
        """The first version of the table, from rows of one key each or more."""
        bucket_by = bucket_by or keys
        if not set(bucket_by) <= set(keys) <= set(rows.columns):
            raise ValueError("bucket_by must be part of the keys, and the keys columns of the rows")
        manifest = {"version": 0, "keys": keys, "bucket_by": bucket_by, "buckets": buckets, "schema": rows.schema.jsonValue(), "folders": {}}
        if self.versions():
            raise TakenVersion(f"there is a table at {self.path}")
        manifest["folders"] = self._write(self._shaped(rows, manifest, NEW), manifest)
        return self._commit(manifest)

    def _scan(self, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        folders = [f for b, f in manifest["folders"].items() if buckets is None or b in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; the last one if not told which."""
        return self._scan(self.manifest(version))

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, by: list[str] | None = None, read_at: int | None = None) -> int:
        """The next version: ``deletes`` gone, then ``upserts`` put in place of the rows with their keys.

        ``deletes`` names rows by ``by``, the whole key or a part of it that
        holds ``bucket_by`` (a parent: its children go). With ``read_at`` the
        changes are meant for that version, and another one in between is an
        error. Returns the version that holds the changes.
        """
        manifest = self.manifest()
        if read_at is not None and manifest["version"] != read_at:
            raise TakenVersion(f"version {read_at} of {self.path} is not the last one any more")
        by = by or manifest["keys"]
        if not set(manifest["bucket_by"]) <= set(by):
            raise ValueError("deletes must name what buckets are dealt by")
        sides = [(rows, keys) for rows, keys in ((upserts, manifest["keys"]), (deletes, by)) if rows is not None]
        touched = reduce(lambda a, b: a | b, ({str(r[0]) for r in self._dealt(self._named(rows, keys, manifest), manifest).select("__bucket").distinct().collect()} for rows, keys in sides), set())  # at most the number of buckets
        if not touched:
            return manifest["version"]
        kept = self._scan(manifest, sorted(touched))
        ranked = []
        if deletes is not None and set(by) == set(manifest["keys"]):
            ranked.append(self._shaped(deletes.select(*by), manifest, GONE))
        elif deletes is not None:
            own = deletes.select(*[F.col(k).alias(f"__{k}") for k in by]).distinct()
            kept = kept.join(own, reduce(lambda a, b: a & b, (kept[k].eqNullSafe(own[f"__{k}"]) for k in by)), "left_anti")
        if upserts is not None:
            ranked.append(self._shaped(upserts, manifest, NEW))
        folders = self._write(reduce(DataFrame.unionByName, ranked, self._shaped(kept, manifest, OLD)), manifest)
        stay = {b: f for b, f in manifest["folders"].items() if b not in touched}
        return self._commit({**manifest, "version": manifest["version"] + 1, "folders": {**stay, **folders}})

    def vacuum(self, keep: int = 1) -> int:
        """Remove all versions but the last ``keep``, and the folders that none of those names; how many folders went.

        Not to be run while a write is under way: its folders are not named yet.
        """
        known = self.versions()
        stay = {f for v in known[-keep:] for f in self.manifest(v)["folders"].values()}
        for v in known[:-keep]:
            self.files.delete(self._place(self._version_path(v)), False)
        gone = 0
        data = self._place(f"{self.path}/data")
        for write in self.files.listStatus(data) if self.files.exists(data) else []:
            for folder in self.files.listStatus(write.getPath()):
                name = f"{self.path}/data/{write.getPath().getName()}/{folder.getPath().getName()}"
                if folder.isDirectory() and name not in stay:
                    gone += bool(self.files.delete(folder.getPath(), True))
            if not any(s.isDirectory() for s in self.files.listStatus(write.getPath())):
                self.files.delete(write.getPath(), True)
        return gone
