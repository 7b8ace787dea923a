"""Shards by fixed virtual slots.

A record's id is hashed into one of ``slots`` slots, thousands whatever the
number of shards. Bytes and rows are summed by slot, and a map says which shard
holds each slot. The map is a table of versions; to move data, a new version of
the map is written that edits the one before:

* version 0 deals slots out in turn, before sizes are known;
* ``rebalanced`` takes the slots by falling bytes: a slot stays where it is as
  long as its shard has room up to the mean, and else goes to the shard with
  the least bytes so far. Shards end up equal but for about a small slot;
* ``grown`` adds a shard, which takes over from each shard those of its smaller
  slots that it has above the new mean. No slot moves between the old shards.

A slot that holds more than ``HOT`` times the mean's rows or bytes (one id on
many rows) is split: its rows go to parts by their text and place, and each
part is an entry of the map. The map has a bounded number of rows, about
``slots``, so it is folded in one task and broadcast; records are shuffled once,
by slot and part, to be numbered, without their texts.

Defined cases: a null text has no bytes, and the checksum of an empty one; null
ids hash alike and their slot is split; equal rows may stand in any order;
a long text is never cut, so a shard can't be smaller than its longest text;
an empty table gives an empty result, and a map of empty slots; other columns,
whatever their names, are left out of ``placed`` and kept by ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightloom.plans.shared import Scratch

SHARDS = 16
SLOTS = 1 << 14
HOT = 4  # times the mean, from which a slot is split
KEYS = ["slot_no", "part"]


def _slot(key: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, slot_no, mix`` of every row; ``mix`` deals out the rows of a slot that is split."""
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), raw.alias("raw"), F.monotonically_increasing_id().alias("row_no"))
    return rows.select("doc_id", (F.length("raw") + F.lit(1).cast("long")).alias("size"), F.crc32("raw").alias("text_crc32"), _slot(F.col("doc_id"), slots).alias("slot_no"), F.xxhash64("raw", "row_no").alias("mix"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``slot_no, part, parts, bytes, rows`` of every slot, empty ones too, hot ones in parts."""
    one = rows.groupBy("slot_no").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.max("size").alias("largest"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot_no")).join(one, "slot_no", "left").fillna(0, ["bytes", "rows", "largest"])
    whole = Window.partitionBy(F.lit(0))  # a row for each slot
    # Long texts alone don't make a slot hot: splitting it would not help.
    times = F.greatest(F.try_divide("rows", F.avg("rows").over(whole)), F.least(F.try_divide("bytes", F.avg("bytes").over(whole)), F.try_divide("bytes", "largest")))
    every = every.withColumn("parts", F.when(times > HOT, F.ceil(times / 2)).otherwise(1).cast("int"))
    cut = F.broadcast(every.where("parts > 1").select("slot_no", "parts"))
    split = rows.join(cut, "slot_no").groupBy("slot_no", "parts", F.pmod("mix", F.col("parts")).cast("int").alias("part")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    columns = ["slot_no", "part", "parts", "bytes", "rows"]
    return every.where("parts = 1").withColumn("part", F.lit(0)).select(*columns).unionByName(split.select(*columns))


def first_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 0 of the map: slots dealt out in turn."""
    return sizes.withColumn("shard", F.pmod(F.col("slot_no") + F.col("part"), F.lit(shards)).cast("int")).withColumn("version", F.lit(0))


def rebalanced(slot_map: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of a map, with near equal bytes in ``shards`` shards and as few moves as that takes."""
    entry = F.struct((-F.col("bytes")).alias("order"), "slot_no", "part", "parts", "bytes", "rows", "shard", "version")
    gathered = slot_map.agg(F.sort_array(F.collect_list(entry)).alias("entries"), F.sum("bytes").alias("all"))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("chosen"))

    def put(state: Column, x: Column) -> Column:
        loads = state["loads"]
        room = (x["shard"] < shards) & (F.get(loads, x["shard"]) + x["bytes"] <= F.col("all") / shards)
        to = F.when(room, x["shard"]).otherwise(F.array_position(loads, F.array_min(loads)).cast("int") - 1)
        return F.struct(F.transform(loads, lambda load, i: load + F.when(i == to, x["bytes"]).otherwise(0)).alias("loads"), F.concat(state["chosen"], F.array(to)).alias("chosen"))

    chosen = gathered.select("entries", F.aggregate("entries", start, put)["chosen"].alias("chosen"))
    moved = chosen.select(F.explode(F.arrays_zip("entries", "chosen")).alias("x")).select("x.entries.*", "x.chosen")
    return moved.select("slot_no", "part", "parts", "bytes", "rows", F.col("chosen").alias("shard"), (F.col("version") + 1).alias("version"))


def grown(slot_map: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of a map of ``shards`` shards, with one more, which only takes over."""
    larger = Window.partitionBy("shard").orderBy(F.desc("bytes"), *KEYS).rowsBetween(Window.unboundedPreceding, 0)
    mean = F.sum("bytes").over(Window.partitionBy(F.lit(0))) / (shards + 1)
    over = slot_map.withColumn("upto", F.sum("bytes").over(larger)).withColumn("mean", mean)
    # The largest slot of a shard stays.
    goes = (F.col("upto") > F.col("mean")) & (F.col("upto") > F.col("bytes"))
    return over.select("slot_no", "part", "parts", "bytes", "rows", F.when(goes, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"), (F.col("version") + 1).alias("version"))


def write_map(slot_map: DataFrame, path: str) -> None:
    """Store a version of the map beside the others; a version that is there is not written again."""
    version = slot_map.select("version").first()["version"]
    slot_map.coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the last one if not told which."""
    if version is None:
        version = spark.read.parquet(path).agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{path}/version={version}")


def _part(parts: Column) -> Column:
    return F.pmod(F.col("mix"), parts).cast("int")


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with ``shard``, and ``slot``, their place in it: slot by slot, by id within."""
    before = Window.partitionBy("shard").orderBy(*KEYS).rowsBetween(Window.unboundedPreceding, -1)
    entries = slot_map.select(*KEYS, "parts", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    parts = F.broadcast(slot_map.where("parts > 1").groupBy("slot_no").agg(F.first("parts").alias("parts")))
    dealt = rows.join(parts, "slot_no", "left").withColumn("part", F.coalesce(_part(F.col("parts")), F.lit(0)))
    inside = Window.partitionBy(*KEYS).orderBy("doc_id", "text_crc32", "mix")
    numbered = dealt.withColumn("nth", F.row_number().over(inside)).drop("parts")
    return numbered.join(F.broadcast(entries.drop("parts")), KEYS).withColumn("slot", F.col("base") + F.col("nth") - 1).drop("base", "nth")


def shard(docs: DataFrame, map_path: str, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every row of ``docs`` in near equal shards; both versions of the map are stored at ``map_path``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    rows = scratch.keep(records(docs, id_col, text_col, slots), "rows", "zstd")
    write_map(first_map(slot_sizes(rows, slots), shards), map_path)
    write_map(rebalanced(read_map(spark, map_path, 0), shards), map_path)
    return placed(rows, read_map(spark, map_path))


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> None:
    """Write ``docs``, all columns, as Parquet in a folder for each shard of a map; nothing is shuffled."""
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    marked = docs.select(F.struct(*docs.columns).alias("row"), _slot(docs[id_col], slots).alias("slot_no"), F.xxhash64(raw, F.monotonically_increasing_id()).alias("mix"))
    parts = F.broadcast(slot_map.where("parts > 1").groupBy("slot_no").agg(F.first("parts").alias("parts")))
    dealt = marked.join(parts, "slot_no", "left").withColumn("part", F.coalesce(_part(F.col("parts")), F.lit(0)))
    dealt.join(F.broadcast(slot_map.select(*KEYS, "shard")), KEYS).select("row", "shard").write.partitionBy("shard").parquet(path)


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    """Shard and place of every document, sizes near equal."""
    found = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op13").path("map"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op13_sharding": op13_sharding}
#: SQL here has neither the hash nor the checksum; tests hold the query against plain Python.
ORACLE_SQL: dict[str, str] = {}
