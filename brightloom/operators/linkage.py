"""Average-linkage clusters of large groups, by rounds of mutual best pairs.

The mean cosine of two clusters is the product of their sums of unit vectors
over the product of their sizes, so a cluster is one row whatever its size.
Merging two clusters never brings the result nearer to a third than the nearer
of the two was. So any two clusters that are each other's best can be merged at
once, in any order, with the same result as merging the best pair of all again
and again; what is below the threshold never comes back; and a cluster looks
for its best again only when that one was merged.

A round compares the clusters that look for their best with all of their group,
block by block: a task holds two blocks and a strip of their products. Pairs of
blocks are spread by key, and each row of a block sends its best alone. Once a
group has few clusters left that can still merge, one task goes on with them.
Joins sort both sides: what many rounds broadcast would all go through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.plans.shared import Scratch

BLOCK = 4096
STRIP = 512  # rows of a block that are multiplied at a time
DIGITS = 12  # of a similarity; what agrees in them is a tie


def _blocks(rows: DataFrame, counts: DataFrame, block: int) -> DataFrame:
    """Rows of a group in blocks of about ``block``: ``grp, blk, of, cids, ns, totals``."""
    of = F.greatest(F.ceil(F.col("size") / block).cast("int"), F.lit(1))
    dealt = rows.join(counts, "grp").withColumn("of", of).withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("of")).cast("int"))
    return dealt.groupBy("grp", "of", "blk").agg(F.sort_array(F.collect_list(F.struct("cid", "n", "total"))).alias("x")).select("grp", "of", "blk", F.col("x.cid").alias("cids"), F.col("x.n").alias("ns"), F.flatten("x.total").alias("totals"))


def _best_of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for grp, cids, ns, totals, other, other_ns, other_totals in zip(*(batch[c] for c in ("grp", "cids", "ns", "totals", "o_cids", "o_ns", "o_totals"))):
            x, y = (np.asarray(t, float).reshape(len(k), -1) / np.asarray(n, float)[:, None] for t, n, k in ((totals, ns, cids), (other_totals, other_ns, other)))
            cids, other = np.asarray(cids), np.asarray(other)
            best, sim = np.empty(len(cids), other.dtype), np.empty(len(cids))
            for at in range(0, len(cids), STRIP):
                product = np.round(x[at : at + STRIP] @ y.T, DIGITS)
                product[cids[at : at + STRIP, None] == other[None]] = -np.inf
                far = product.argmax(axis=1)  # of equals the first, which has the least id
                best[at : at + STRIP], sim[at : at + STRIP] = other[far], product[np.arange(len(far)), far]
            found = np.isfinite(sim)
            yield pd.DataFrame({"grp": [grp] * int(found.sum()), "cid": cids[found], "best": best[found], "sim": sim[found]})


def _best(seeking: DataFrame, live: DataFrame, block: int) -> DataFrame:
    """``grp, cid, best, sim``: the most similar other cluster of each that seeks; of equals the least id."""
    counts = live.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    theirs = _blocks(live, counts, block).select("grp", F.col("blk").alias("o_blk"), F.col("cids").alias("o_cids"), F.col("ns").alias("o_ns"), F.col("totals").alias("o_totals"))
    mine = _blocks(seeking, counts, block).withColumn("o_blk", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    kinds = dict(live.dtypes)
    met = mine.join(theirs.hint("merge"), ["grp", "o_blk"]).select("grp", "cids", "ns", "totals", "o_cids", "o_ns", "o_totals")
    each = met.mapInPandas(_best_of_blocks, f"grp {kinds['grp']}, cid {kinds['cid']}, best {kinds['cid']}, sim double")
    # The greatest similarity, then the least id.
    top = each.groupBy("grp", "cid", "sim").agg(F.min("best").alias("best")).groupBy("grp", "cid").agg(F.max_by(F.struct("best", "sim"), "sim").alias("x"))
    return top.select("grp", "cid", "x.best", "x.sim")


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def numbered(rows: DataFrame, group: str, order: str, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with their place in their group by ``order``, from 0; no group goes to one task."""
    part = F.spark_partition_id().cast("long")
    placed = rows.repartitionByRange(group, order).sortWithinPartitions(group, order).withColumns({"__part": part, "__at": F.monotonically_increasing_id() - F.shiftleft(part, 33)})
    placed = scratch.keep(placed, name)
    # One row a partition: their running total is a small window.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = placed.join(F.broadcast(base), "__part").withColumn("__at", F.col("base") + F.col("__at"))
    start = placed.groupBy(group).agg(F.min("__at").alias("start"))
    return placed.join(start, group).withColumn("number", F.col("__at") - F.col("start")).drop("__part", "__at", "base", "start")


def agglomerate(sim: np.ndarray, size: np.ndarray, stop: float) -> list[list[int]]:
    """Members by the first of them, merged by the greatest mean similarity down to ``stop``; ``sim`` is overwritten."""
    n = len(sim)
    np.fill_diagonal(sim, -np.inf)
    members, size = [[i] for i in range(n)], size.astype(float)
    while n > 1:
        i, j = sorted(divmod(int(sim.argmax()), n))
        if not sim[i, j] >= stop:
            break
        merged = (size[i] * sim[i] + size[j] * sim[j]) / (size[i] + size[j])
        sim[i], sim[:, i] = merged, merged
        sim[i, i] = -np.inf
        sim[j], sim[:, j] = -np.inf, -np.inf
        members[i] += members[j]
        size[i] += size[j]
        members[j] = []
    return members


def _ended(rest: DataFrame, stop: float) -> DataFrame:
    """``grp, cid, gone``: what the clusters of each group still merge to, a group in one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cid")
        size, cids = rows["n"].to_numpy(), rows["cid"].to_numpy()
        means = np.stack(rows["total"].to_numpy()).astype(float) / size[:, None]
        pairs = [(m[0], i) for m in agglomerate(means @ means.T, size, stop) for i in m[1:]]
        return pd.DataFrame({"grp": [rows["grp"].iloc[0]] * len(pairs), "cid": [cids[i] for i, _ in pairs], "gone": [cids[j] for _, j in pairs]})

    kinds = dict(rest.dtypes)
    return rest.groupBy("grp").applyInPandas(run, f"grp {kinds['grp']}, cid {kinds['cid']}, gone {kinds['cid']}")


def linked_clusters(rows: DataFrame, group: str, id_col: str, stop: float, min_size: int, block: int = BLOCK, at_once: int = 0) -> DataFrame:
    """``group, id, cluster`` of every vector; a cluster's number counts by first member, -1 for small ones.

    A group with ``at_once`` clusters or fewer left goes on in one task; 0 keeps to the rounds.
    """
    scratch = Scratch(rows.sparkSession, "linkage")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    units = rows.select(F.col(group).alias("grp"), F.col(id_col).alias("id"), F.transform("embedding", lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12))).alias("unit"), (norm > 0).alias("seen"))
    # Equal vectors come together before all others. A vector of zeros is like nothing, so each is alone.
    named = units.withColumn("own", F.when(F.col("seen"), F.lit(None)).otherwise(F.col("id")))
    first = scratch.keep(named.groupBy("grp", "unit", "own").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("n")), "first")
    members = scratch.keep(named.join(first.hint("merge"), [named["grp"].eqNullSafe(first["grp"]), named["unit"] == first["unit"], named["own"].eqNullSafe(first["own"])]).select(named["grp"], "id", "cid"), "members")
    live = scratch.keep(first.select("grp", "cid", "n", F.transform("unit", lambda x: x * F.col("n")).alias("total")), "live0")
    scratch.drop("first")
    best = scratch.keep(_best(live, live, block).where(F.col("sim") >= stop), "best0")
    ended: list[DataFrame] = []  # merges, each of a cluster into one with a lesser id
    turn = 0
    while not best.isEmpty():
        turn += 1
        # Only clusters that can still merge are carried on.
        alive = live.join(best.select("grp", "cid").hint("merge"), ["grp", "cid"], "left_semi")
        if at_once:
            left = scratch.keep(best.groupBy("grp").agg((F.count(F.lit(1)) <= at_once).alias("few")), f"left{turn}")
            few = left.where("few").select("grp").hint("merge")
            if not few.isEmpty():
                ended.append(scratch.keep(_ended(alive.join(few, "grp", "left_semi"), stop), f"ended{turn}"))
                more = left.where("NOT few").select("grp").hint("merge")
                best = scratch.keep(best.join(more, "grp", "left_semi"), f"larger{turn}")
                if best.isEmpty():
                    break
                alive = live.join(best.select("grp", "cid").hint("merge"), ["grp", "cid"], "left_semi")
        there = best.select("grp", F.col("best").alias("cid"), F.col("cid").alias("back"), F.col("best").alias("of"))
        mutual = best.join(there.hint("merge"), ["grp", "cid"]).where((F.col("best") == F.col("back")) & (F.col("cid") < F.col("best"))).select("grp", "cid", F.col("best").alias("gone"))
        mutual = scratch.keep(mutual, f"mutual{turn}")
        if mutual.isEmpty():  # similarities that rounding tells apart on one side only: the best pair of all
            top = best.orderBy(F.desc("sim"), F.least("cid", "best"), F.greatest("cid", "best")).limit(1)
            mutual = scratch.keep(top.select("grp", F.least("cid", "best").alias("cid"), F.greatest("cid", "best").alias("gone")), f"mutual{turn}")
        ended.append(mutual)
        ends = mutual.select("grp", "cid", F.col("cid").alias("to")).unionByName(mutual.select("grp", F.col("gone").alias("cid"), F.col("cid").alias("to")))
        ends = scratch.keep(ends, f"ends{turn}")
        gone = ends.select("grp", "cid").hint("merge")
        parts = alive.join(ends.hint("merge"), ["grp", "cid"]).select("grp", F.col("to").alias("cid"), "n", "total", (F.col("cid") == F.col("to")).alias("stays"))
        joined = parts.groupBy("grp", "cid").agg(F.sum("n").alias("n"), F.max_by("total", "stays").alias("one"), F.min_by("total", "stays").alias("two")).select("grp", "cid", "n", _add(F.col("one"), F.col("two")).alias("total"))
        live = scratch.keep(alive.join(gone, ["grp", "cid"], "left_anti").select("grp", "cid", "n", "total").unionByName(joined), f"live{turn}")
        # Those whose best is as it was keep it.
        rest = best.join(gone, ["grp", "cid"], "left_anti")
        kept = rest.join(ends.select("grp", F.col("cid").alias("best")).hint("merge"), ["grp", "best"], "left_anti").select("grp", "cid", "best", "sim")
        seeking = live.join(kept.select("grp", "cid").hint("merge"), ["grp", "cid"], "left_anti")
        best = scratch.keep(kept.unionByName(_best(seeking, live, block).where(F.col("sim") >= stop)), f"best{turn}")
        scratch.drop(f"live{turn - 1}", f"best{turn - 1}", f"larger{turn}", f"left{turn}", f"ends{turn}")
    tops = members
    if ended:
        # Each cluster went into one other, so following the parents ends at the last one; their ways are halved in each pass.
        way = reduce(DataFrame.unionByName, ended).select("grp", F.col("gone").alias("cid"), F.col("cid").alias("to"))
        step = 0
        while True:
            step += 1
            further = way.select("grp", F.col("cid").alias("to"), F.col("to").alias("next"))
            moved = scratch.keep(way.join(further.hint("merge"), ["grp", "to"], "left").select("grp", "cid", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), f"way{step}")
            way = moved.select("grp", "cid", "to")
            if moved.where("moved").isEmpty():
                break
            scratch.drop(f"way{step - 1}")
        tops = scratch.keep(members.join(way.hint("merge"), ["grp", "cid"], "left").select("grp", "id", F.coalesce("to", "cid").alias("cid")), "tops")
    sizes = tops.groupBy("grp", "cid").agg(F.count(F.lit(1)).alias("n"))
    large = numbered(sizes.where(F.col("n") >= min_size).select("grp", "cid"), "grp", "cid", scratch, "large")
    out = tops.join(large.hint("merge"), ["grp", "cid"], "left")
    return out.select(F.col("grp").alias(group), F.col("id").alias(id_col), F.coalesce("number", F.lit(-1)).cast("long").alias("cluster"))
