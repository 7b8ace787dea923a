"""Polled sources: live or backfill, change feed, corroboration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions.identity import snapshot_hash


def is_live(published: Column, activated: Column, now: Column, lookback_days: int = 30) -> Column:
    """Whether an item is news: published after activation and within the look-back; never without a date."""
    fresh = (published > activated) & (published >= now - F.expr(f"INTERVAL {lookback_days} DAY"))
    return F.coalesce(fresh, F.lit(False))


def with_activation(items: DataFrame, source: str, published: str) -> DataFrame:
    """Items with their source's activation: the first quarter of what it has published."""
    at = items.groupBy(source).agg(F.percentile(F.unix_micros(F.col(published).cast("timestamp")), 0.25).alias("__at"))
    return items.join(at, source).withColumn("activated_at", F.timestamp_micros(F.floor("__at")).cast("timestamp_ntz")).drop("__at")


def changes(observations: DataFrame, resource: str, order: list[str], fields: list[str]) -> DataFrame:
    """``created`` for a resource's first snapshot and ``updated`` where its hash changes."""
    w = Window.partitionBy(resource).orderBy(*order)
    rows = observations.withColumn("content_hash", snapshot_hash(*[F.col(f) for f in fields]))
    rows = rows.withColumn("previous_hash", F.lag("content_hash").over(w))
    kind = F.when(F.col("previous_hash").isNull(), F.lit("created")).when(F.col("previous_hash") != F.col("content_hash"), F.lit("updated"))
    return rows.withColumn("change_type", kind).where(F.col("change_type").isNotNull())


def prior_count(rows: DataFrame, group: list[str], order: list[str]) -> Column:
    """Rows of the group that came before."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.count(F.lit(1)).over(w)


def refreshes(observations: DataFrame, resource: list[str], at: str, order: str, content: Column, forget: str) -> DataFrame:
    """``new`` for a resource not seen for longer than ``forget``, ``refresh`` where its content differs from the last seen; nothing else is told."""
    w = Window.partitionBy(*resource).orderBy(at, order)
    rows = observations.withColumn("__now", content).withColumn("__last", F.lag("__now").over(w)).withColumn("__seen", F.lag(at).over(w))
    fresh = F.col("__seen").isNull() | (F.col(at) - F.col("__seen") > F.expr(f"INTERVAL {forget}"))
    kind = F.when(fresh, F.lit("new")).when(~F.col("__last").eqNullSafe(F.col("__now")), F.lit("refresh"))
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").drop("__now", "__last", "__seen")
