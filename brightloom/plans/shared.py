"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. A table written there
survives lost executors, cuts lineage, and gives adaptive execution a plain
scan on both sides of a join, so that skewed keys can be split. Once a table
is written, the shuffle files that led to it are of no more use and go.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_own: dict[str, str] = {}  # folders made for applications that name none


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, a temporary one in local mode and one in a shared warehouse elsewhere."""
    root = spark.conf.get(SETTING, None)
    if not root:
        context = spark.sparkContext
        app = context.applicationId
        if app not in _own:
            local = context.master.startswith("local") and not context.master.startswith("local-cluster")
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            if not local and warehouse.startswith("file:"):
                raise RuntimeError(f"{SETTING} names no folder that all executors share, and the warehouse is local to a machine")
            _own[app] = "file://" + tempfile.mkdtemp(prefix="brightloom-") if local else f"{warehouse.rstrip('/')}/_scratch"
        root = _own[app]
    return root.rstrip("/")


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside sends Python workers ``rows`` rows at a time, for rows that are large."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


class Scratch:
    """Tables of one job, by name; a name that is written again drops the old files."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/brightloom/{job}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[str, str] = {}

    def path(self, name: str) -> str:
        return f"{self.base}/{name}-{uuid.uuid4().hex[:8]}"

    def write(self, df: DataFrame, path: str, compression: str = "snappy", options: dict[str, str] | None = None) -> None:
        """Write ``df`` as Parquet; its shuffle files go when the files stand."""
        conf = self.spark.conf
        before = conf.get(CLEANUP)
        conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", compression).options(**(options or {})).parquet(path)
        finally:
            conf.set(CLEANUP, before)

    def keep(self, df: DataFrame, name: str, compression: str = "snappy", options: dict[str, str] | None = None) -> DataFrame:
        """Write ``df`` as Parquet and return a scan of the files."""
        path = self.path(name)
        self.write(df, path, compression, options)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            self.remove(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                self.remove(self.paths.pop(name))

    def drop_all_but(self, *names: str) -> None:
        """Remove what the job's result doesn't read."""
        self.drop(*(set(self.paths) - set(names)))

    def remove(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
