"""Exact deduplication by deterministic block naming.

A text is cut into blocks of fixed size. The distinct blocks are sorted by
their bytes and the sort position, counted from 0 over all partitions, becomes
the block's integer name. Adjacent names are then paired and the distinct pairs
sorted and named the same way, level by level, until each document has a single
name. Two documents share an identity if and only if they are equal byte for
byte, and names depend on the texts alone, not on how rows are dealt out.

Contents are shuffled to be told apart, after partial aggregation on the map
side, so a block that a third of all rows hold leaves each task once, and again
to be sorted. A digest only carries a finished name back to the block's places.
Where different blocks share a digest, their names are carried back by the
blocks themselves.

Defined cases: a null text counts as empty, and all empty texts are equal; a
null id sorts below every other; of rows with the same text and the same id,
one stays; a very long text is cut into more blocks and takes more levels; an
empty table gives an empty result; further columns, whatever
their names, are left out of the result of ``exact_groups`` and untouched by
``exact_dedup``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.plans.shared import Scratch

BLOCK_BYTES = 2048
PREFIX = 128  # bytes of a block that deal it out to be sorted; a sample of them goes to the driver
HOT = 1 << 16  # different blocks of one prefix, from which the next bytes deal them out as well


def sha256(block: Column) -> Column:
    return F.sha2(block, 256)


def _integer_names(distinct: DataFrame, keys: list[str], kept: list[Column], scratch: Scratch, name: str, deal: list[Column] | None = None) -> DataFrame:
    """Sort distinct rows by ``keys``; ``kept`` columns and each row's position in that order as ``name``.

    ``deal`` are what the order of the keys begins with; the keys themselves if not given.
    """
    ordered = distinct.repartitionByRange(*(deal or keys)).sortWithinPartitions(*keys)
    part = F.spark_partition_id().cast("long")
    placed = scratch.keep(ordered.select(*kept, part.alias("part"), (F.monotonically_increasing_id() - F.shiftleft(part, 33)).alias("within")), name)
    # One row per partition: their running total is a small window.
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(F.broadcast(base), "part").withColumn("name", F.col("base") + F.col("within")).drop("part", "base", "within")


def _blocks(raw: Column, size: int) -> Column:
    """The text's bytes in blocks of ``size``; an empty text has one empty block."""
    last = F.greatest(F.lit(0), F.ceil(F.length(raw) / F.lit(size)).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _named_blocks(rows: DataFrame, digest: Callable[[Column], Column], scratch: Scratch) -> DataFrame:
    """``row_no, doc_id, text_sha256, n, pos, name`` of every block of ``rows``."""
    contents = scratch.keep(rows.select("block").distinct().select(digest(F.col("block")).alias("digest"), "block"), "contents", "zstd")
    clash = scratch.keep(contents.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("digest"), "clash")
    # Blocks are long and would all go to the driver as samples of the order, so their first bytes stand for them.
    prefix = F.substring("block", 1, PREFIX)
    deal = [prefix]
    hot = scratch.keep(contents.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("prefix", F.lit(True).alias("hot")), "hot")
    if not hot.isEmpty():
        contents = contents.withColumn("prefix", prefix).join(hot, "prefix", "left")
        deal = [F.col("prefix"), F.when(F.col("hot"), F.substring("block", PREFIX + 1, 4 * PREFIX)).otherwise(F.unhex(F.lit("")))]
    spine = rows.withColumn("digest", digest(F.col("block")))
    out = ["row_no", "doc_id", "text_sha256", "n", "pos", "name"]
    if clash.isEmpty():
        names = _integer_names(contents, ["block"], [F.col("digest")], scratch, "names", deal)
        return scratch.keep(spine.drop("block").join(names, "digest").select(*out), "level0")
    # Blocks of a shared digest keep their bytes on either side.
    clash = clash.withColumn("shared", F.lit(True))
    bytes_of = F.when(F.col("shared"), F.col("block")).alias("bytes")
    names = _integer_names(contents.join(clash, "digest", "left"), ["block"], [F.col("digest"), bytes_of], scratch, "names", deal)
    spine = spine.join(clash, "digest", "left").select("row_no", "doc_id", "text_sha256", "n", "pos", "digest", bytes_of).withColumnsRenamed({"digest": "d", "bytes": "b"})
    return scratch.keep(spine.join(names, (F.col("d") == F.col("digest")) & F.col("b").eqNullSafe(F.col("bytes"))).select(*out), "level0")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, height, name``.

    ``name`` with ``height``, the number of pairings, is the document's
    collision-free identity. Of equal texts the row with the largest id is kept.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = (
        docs.select(F.col(id_col).alias("doc_id"), F.encode(text, "UTF-8").alias("raw"))
        .withColumn("row_no", F.monotonically_increasing_id())
        .withColumn("blocks", _blocks(F.col("raw"), block_bytes))
        .select("row_no", "doc_id", F.sha2("raw", 256).alias("text_sha256"), F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    )
    level = _named_blocks(rows, digest, scratch)
    scratch.drop("contents", "clash", "hot", "names")
    longest = level.agg(F.max("n")).first()[0] or 1
    done: DataFrame | None = None
    height = 0
    while True:
        # A document that is down to one name is finished; its height tells levels apart.
        finished = level.where("n = 1").select("doc_id", "text_sha256", "name", F.lit(height).alias("height"))
        done = finished if done is None else done.unionByName(finished)
        if longest == 1:
            break
        pairs = (
            level.where("n > 1")
            .groupBy("row_no", F.shiftright("pos", 1).alias("pos"))
            .agg(
                F.first("doc_id").alias("doc_id"),
                F.first("text_sha256").alias("text_sha256"),
                F.shiftright(F.first("n") + 1, 1).alias("n"),
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            )
        )
        pairs = scratch.keep(pairs, "pairs")
        height, longest = height + 1, (longest + 1) // 2
        names = _integer_names(pairs.select("left", "right").distinct(), ["left", "right"], [F.col("left"), F.col("right")], scratch, "names")
        level = scratch.keep(pairs.join(names, ["left", "right"]).select("row_no", "doc_id", "text_sha256", "n", "pos", "name"), f"level{height}")

    done = scratch.keep(done, "identity")
    # The larger id wins; the digest column is equal within a group.
    groups = scratch.keep(done.groupBy("height", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    scratch.drop_all_but("identity", "groups")
    rivals = scratch.keep(done.groupBy("height", "name", "doc_id").agg(F.first("text_sha256").alias("text_sha256"), F.count(F.lit(1)).alias("rows")), "rivals")
    return (
        rivals.join(groups, ["height", "name"])
        .withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
            "text_sha256",
            "height",
            "name",
        )
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they were."""
    found = exact_groups(docs, id_col, text_col, block_bytes)
    stay = found.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), (F.col("group_size") > 1).alias("__copies"))
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    marked = docs.withColumn("__key", F.sha2(text, 256))
    rows = marked.join(stay, marked[id_col].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__sha")), "inner")
    # Rows repeated with the same id and text: one of them.
    alone = rows.where(~F.col("__copies"))
    copies = rows.where("__copies").dropDuplicates([id_col, "__key"])
    return alone.unionByName(copies).select(*docs.columns)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the id that stays for its text."""
    found = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = {
    "op1_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER g AS keep_id,
               count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}
QUERIES = {"op1_exact_dedup": op1_exact_dedup}
