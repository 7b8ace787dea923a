"""Choices among an item's frames that depend on the choices before."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.plans.shared import Scratch


def keep_changed(rows: DataFrame, group: str, order: str, bits: str, least: int = 8) -> DataFrame:
    """``group, order, kept``: a frame is kept when it differs from the last kept one in ``least`` bits."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, kept, last = pdf.sort_values(order), [], None
        for value in pdf[bits]:
            new = last is None or (int(value) ^ last).bit_count() >= least
            kept.append(new)
            last = int(value) if new else last
        return pd.DataFrame({group: pdf[group], order: pdf[order], "kept": kept})

    kinds = dict(rows.dtypes)
    return rows.select(group, order, bits).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {order} {kinds[order]}, kept boolean")


#: Why a frame was chosen, by class of priority.
REASONS = ("ends", "severity", "density", "spread")


def _spread_small(rows: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """The rest of each group's choice, group by group."""

    def run(key: tuple, frames: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        frames = frames.sort_values("frame")
        have = before["at"].dropna().to_numpy()
        times, picked = frames["at"].to_numpy(), []
        gap = np.min(np.abs(times[:, None] - have[None]), axis=1) if len(have) else np.full(len(times), np.iinfo(np.int64).max)
        for _ in range(min(k - len(before), len(times))):
            far = int(gap.argmax())  # the first of equals
            picked.append(far)
            gap = np.where(np.arange(len(gap)) == far, -1, np.minimum(gap, np.abs(times - times[far])))
            gap[picked] = -1
        return frames.iloc[picked][["grp", "frame", "at"]]

    kinds = dict(rows.dtypes)
    return rows.groupBy("grp").cogroup(chosen.groupBy("grp")).applyInPandas(run, f"grp {kinds['grp']}, frame {kinds['frame']}, at long")


def _spread_large(rows: DataFrame, chosen: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """The same in rounds: each row's gap to what its group has, and the widest gap of each group."""
    have = scratch.keep(chosen.groupBy("grp").agg(F.collect_list(F.struct("frame", "at")).alias("have")), "have0")  # k at most
    for turn in range(1, k + 1):
        open_groups = have.where(F.size("have") < k)
        met = rows.join(open_groups, "grp").where(~F.exists("have", lambda h: h["frame"] == F.col("frame")))
        gap = F.array_min(F.transform(F.filter("have", lambda h: h["at"].isNotNull()), lambda h: F.abs(F.col("at") - h["at"])))
        widest = F.struct(F.coalesce(gap, F.lit((1 << 63) - 1)).alias("gap"), (-F.col("frame")).alias("first"), F.col("at").alias("at"))
        next_ = met.groupBy("grp").agg(F.max(widest).alias("x"))  # one row a group from each task
        if next_.isEmpty():
            break
        picked = next_.select("grp", F.array(F.struct((-F.col("x.first")).alias("frame"), F.col("x.at").alias("at"))).alias("new"))
        have = scratch.keep(have.join(picked, "grp", "left").select("grp", F.concat("have", F.coalesce("new", F.array().cast(have.schema["have"].dataType))).alias("have")), f"have{turn}")
        scratch.drop(f"have{turn - 1}")
    new = have.select("grp", F.explode("have").alias("h")).select("grp", "h.frame", "h.at")
    return new.join(chosen.select("grp", "frame"), ["grp", "frame"], "left_anti")


def choose_frames(rows: DataFrame, group: str, frame: str, time: str, k: int = 12, severity: Column | None = None, density: Column | None = None, at_once: int = 20_000) -> DataFrame:
    """``group, frame, time, reason`` of at most ``k`` frames of each group.

    The first and the last frame come first, then those with a ``severity`` (0
    is the gravest), then those with the greatest positive ``density``; what is
    still open goes to whatever is farthest in time from all chosen. The lesser
    frame number wins a tie. Frame numbers are whole numbers, unique in a group;
    a frame without a time is chosen by priority only; rows without a group or
    a frame number are left out. Groups of more than ``at_once`` frames are
    spread over the cluster in ``k`` rounds, with the same result.
    """
    scratch = Scratch(rows.sparkSession, "frames")
    named = rows.select(F.col(group).alias("grp"), F.col(frame).cast("long").alias("frame"), F.col(time).cast("long").alias("at"), (F.lit(None) if severity is None else severity).cast("long").alias("severity"), (F.lit(0) if density is None else density).cast("double").alias("density"))
    named = scratch.keep(named.where("grp IS NOT NULL AND frame IS NOT NULL"), "rows")
    ends = scratch.keep(named.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("lo"), F.max("frame").alias("hi")), "ends")
    marked = named.join(ends, "grp")
    kind = F.when(F.col("frame").isin(F.col("lo"), F.col("hi")), 0).when(F.col("severity").isNotNull(), 1).when(F.col("density") > 0, 2)
    order = F.when(kind == 1, F.col("severity").cast("double")).when(kind == 2, -F.col("density")).otherwise(F.lit(0.0))
    first = Window.partitionBy("grp").orderBy("kind", "order", "frame")  # Spark limits ranks before the shuffle
    chosen = marked.where(kind.isNotNull()).select("grp", "frame", "at", kind.alias("kind"), order.alias("order")).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k)
    chosen = scratch.keep(chosen.select("grp", "frame", "at", "kind"), "chosen")
    left = ends.join(chosen.groupBy("grp").agg(F.count(F.lit(1)).alias("have")), "grp").where((F.col("have") < k) & (F.col("have") < F.col("n")))
    left = scratch.keep(left.select("grp", (F.col("n") > at_once).alias("large")), "left")
    rest = named.where("at IS NOT NULL").join(chosen.select("grp", "frame"), ["grp", "frame"], "left_anti").select("grp", "frame", "at")

    def of(large: bool) -> list[DataFrame]:
        return [x.join(left.where(F.col("large") == large), "grp", "left_semi") for x in (rest, chosen.select("grp", "frame", "at"))]

    spread = _spread_small(*of(False), k)
    if not left.where("large").isEmpty():
        wide, before = of(True)
        spread = spread.unionByName(_spread_large(scratch.keep(wide, "wide"), before, k, scratch))
    out = chosen.unionByName(spread.withColumn("kind", F.lit(3)))
    return out.select(F.col("grp").alias(group), F.col("frame").alias(frame), F.col("at").alias(time), F.element_at(F.array(*map(F.lit, REASONS)), F.col("kind") + 1).alias("reason"))
