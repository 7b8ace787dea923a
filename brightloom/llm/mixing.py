"""Mixing sources to target weights by pivotal dependent rounding.

Sources, by code point with null last, weigh 1, 2, 3, repeating, and share the
words of the corpus. A target stops at ``max_copies`` times the source's size;
what is above goes to the other sources by weight until none is above. Each
document's copies are ``target / source_size``: a whole part, and a fraction
that has to be rounded.

The fractions of a source are rounded dependently. Two documents with open
fractions move mass between them, weighed by their sizes so that the words
that the pair takes stay the same, until one fraction is 0 or 1; which way the
mass goes is drawn so that every fraction keeps its expectation. The other
document goes on to the next pair. A bounded bucket of a source leaves one open
document at most; the leftovers of many buckets meet in the next level of a
reduction tree until a source has one, which is rounded by a draw of its own.
The largest documents of a bucket are rounded before that, each against the
bucket's other documents together, so the one that stays open is small: a
source's words miss the target by less than that document.

Buckets come from a hash of id and text, and draws from a hash of the seed and
that key, so a rerun decides alike. Within a bucket, documents pair in
descending order of size. A source with a third of all rows fills more buckets, not larger ones.

Defined cases: a null text has size 0; documents of size 0 take no words and
count no copy beyond the whole part; a null source is a source of its own,
last in order; rows with a null or repeated id are rounded separately; a
very long text is a large document, rounded before smaller ones; an empty table gives an empty result; clashing columns are left out of the plan
and untouched in the mixed rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.plans.shared import Scratch

MAX_COPIES = 3
BUCKET_ROWS = 4096
FAN_IN = 64
SEED = 17


def water_fill(sizes: list[int], weights: list[float], max_copies: int = MAX_COPIES) -> list[float]:
    """Shares of ``sum(sizes)`` by weight, none above ``max_copies`` times its size."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > max_copies * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = weights[i] * unit
            break
        for i in sorted(full):
            targets[i] = float(max_copies * sizes[i])
            left -= targets[i]
            open_.discard(i)
    return targets


def source_targets(sizes: DataFrame, scratch: Scratch, max_copies: int = MAX_COPIES) -> DataFrame:
    """``source, source_size, target, place`` from ``sizes(source, source_size)``, one row per source.

    Sources may be many, such as hosts: they are put in order and counted over
    sorted partitions, and the share of a unit of weight is found in rounds that
    take a row of sums each. Whoever is above its limit at some unit stays above
    it, since what it leaves makes the unit larger.
    """
    keys = [F.col("source").isNull().alias("last"), "source"]
    ordered = sizes.select("source", "source_size", keys[0]).repartitionByRange("last", "source").sortWithinPartitions("last", "source")
    part = F.spark_partition_id().cast("long")
    placed = scratch.keep(ordered.select("source", "source_size", part.alias("part"), (F.monotonically_increasing_id() - F.shiftleft(part, 33)).alias("within")), "placed")
    # One row per partition: their running total is a small window.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = placed.join(F.broadcast(base), "part").withColumn("place", F.col("base") + F.col("within"))
    rows = rows.select("source", "source_size", "place", (F.col("place") % 3 + 1).alias("weight"), (F.col("source_size") * max_copies).alias("most"))
    unit = 0.0
    while True:
        full = F.col("weight") * F.lit(unit) > F.col("most")
        words, capped, weight = rows.agg(F.sum("source_size"), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        share = ((words or 0) - (capped or 0)) / weight if weight else unit
        if share <= unit:
            break
        unit = share
    return scratch.keep(rows.select("source", "source_size", F.least(F.col("weight") * F.lit(unit), F.col("most").cast("double")).alias("target"), "place"), "targets")


def _draw(key: int, level: int, seed: int) -> float:
    """A uniform number in [0, 1) from a document's key."""
    mixed = (key ^ (seed * 0x9E3779B97F4A7C15) ^ (level * 0xC2B2AE3D27D4EB4F)) & (1 << 64) - 1
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> shift)) * factor & (1 << 64) - 1
    return ((mixed ^ (mixed >> 31)) >> 11) / (1 << 53)


def settle_large(p: np.ndarray, sizes: np.ndarray, keys: np.ndarray, level: int, seed: int = SEED, largest: int = 64) -> np.ndarray:
    """Round the largest documents first, each against all others of its bucket at once.

    Sizes descend. The others move by ``min(p, 1 - p)`` in proportion, up or
    down, so that words and every expectation stay. Were a large document left
    to small partners, it would stay open to the end and miss the target by
    its own size. A document that the others can't make up for is left open.
    """
    p = p.astype(float).copy()
    for i in range(min(largest, len(p) - 1)):
        room = np.minimum(p, 1 - p)
        room[: i + 1] = 0
        words, own, a = float(room @ sizes), float(sizes[i]), p[i]
        if not 1e-9 < a < 1 - 1e-9 or max(a, 1 - a) * own > words / 2:
            continue
        if _draw(int(keys[i]), level + 1000, seed) < a:
            p = p - room * ((1 - a) * own / words)
            p[i] = 1.0
        else:
            p = p + room * (a * own / words)
            p[i] = 0.0
    return p


def pivot(p: np.ndarray, sizes: np.ndarray, keys: np.ndarray, level: int, seed: int = SEED) -> np.ndarray:
    """Round the fractions in order until at most one is open; the sum of ``p * sizes`` stays."""
    p = p.astype(float).copy()
    eps = 1e-12
    held = -1
    for i in range(len(p)):
        if not eps < p[i] < 1 - eps:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b, sa, sb = p[held], p[i], float(sizes[held]), float(sizes[i])
        # Words that can move from i to held, and from held to i.
        up, down = min((1 - a) * sa, b * sb), min(a * sa, (1 - b) * sb)
        move = up if _draw(int(keys[i]) ^ int(keys[held]), level, seed) < down / (up + down) else -down
        a, b = a + move / sa, b - move / sb
        p[held], p[i] = a, b
        # What has become whole leaves; the other is held.
        a_open, b_open = 1e-9 < a < 1 - 1e-9, 1e-9 < b < 1 - 1e-9
        for j, still in ((held, a_open), (i, b_open)):
            if not still:
                p[j] = round(p[j])
        held = i if b_open else held if a_open else -1
    return p


def _rounding(level: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # Largest first, so that what stays open to the end is a small document.
        rows = rows.sort_values(["size", "key", "nth"], ascending=False, kind="stable")
        sizes, keys = rows["size"].to_numpy(), rows["key"].to_numpy()
        rows["p"] = pivot(settle_large(rows["p"].to_numpy(), sizes, keys, level, seed), sizes, keys, level, seed)
        return rows

    return run


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """``doc_id, text_sha256, size, source_size, target, copies, nth`` for every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"),
    )
    # Repeated rows are told apart by their number among equals.
    rows = rows.groupBy("doc_id", "source", "size", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("nth")).drop("n")
    rows = scratch.keep(rows.withColumn("key", F.xxhash64("doc_id", "text_sha256", "nth")), "rows")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    total = rows.count()
    places = source_targets(totals.select("source", "source_size"), scratch, max_copies)
    s = rows.join(places.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(ratio + 1e-12), F.lit(max_copies)).cast("long")
    s = s.withColumn("whole", whole).withColumn("p", F.greatest(F.lit(0.0), ratio - F.col("whole")))
    s = s.withColumn("open", (F.col("size") > 0) & (F.col("p") > 1e-12))

    buckets = max(1, -(-total // BUCKET_ROWS))
    spine = ["place", "key", "nth", "size", "p", "bucket"]
    schema = "place long, key long, nth int, size long, p double, bucket long"
    level_rows = s.where("open").withColumn("bucket", F.pmod("key", F.lit(buckets))).select(*spine)
    settled: DataFrame | None = None
    level = 0
    while True:
        rounded = scratch.keep(level_rows.groupBy("place", "bucket").applyInPandas(_rounding(level, seed), schema), f"level{level}")
        whole_now = rounded.where("p = 0 OR p = 1")
        settled = whole_now if settled is None else settled.unionByName(whole_now)
        left = rounded.where("p > 0 AND p < 1")
        if buckets == 1:
            # One open document per source is left: a draw of its own.
            last = left.groupBy("place").applyInPandas(_last_draw(seed), schema)
            settled = settled.unionByName(last)
            break
        buckets = -(-buckets // FAN_IN)
        level_rows = left.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN)).select(*spine)
        level += 1
    settled = scratch.keep(settled.select("place", "key", "nth", "p"), "settled")
    out = s.join(settled.withColumnRenamed("p", "up"), ["place", "key", "nth"], "left")
    copies = F.col("whole") + F.coalesce(F.col("up"), F.lit(0.0)).cast("long")
    return out.select("doc_id", "text_sha256", "nth", "size", "source_size", "target", copies.alias("copies"))


def _last_draw(seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows["p"] = [float(_draw(int(k), -1, seed) < p) for k, p in zip(rows["key"], rows["p"])]
        return rows

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns."""
    plan = mixing_plan(docs, id_col, text_col, source_col, max_copies, seed)
    plan = plan.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("nth").alias("__nth"), F.col("copies").alias("__copies")).where("__copies > 0")
    # Rows with the same id and text are alike; their copies are added and dealt to one of them.
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    plan = plan.groupBy("__id", "__sha").agg(F.sum("__copies").alias("__copies"), F.max("__nth").alias("__rows"))
    marked = docs.withColumn("__key", F.sha2(text, 256))
    rows = marked.join(plan, marked[id_col].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__sha")))
    alone = rows.where("__rows = 1")
    rows = alone.unionByName(rows.where("__rows > 1").dropDuplicates([id_col, "__key"]))
    return rows.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """Size, its source's size and target, and the words taken of every document."""
    plan = mixing_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op4_mixing": op4_mixing}
ORACLE_SQL: dict[str, str] = {}
