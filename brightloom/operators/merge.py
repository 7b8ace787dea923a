"""Upserts on plain tables: old and new rows merged by key with a rule for each column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States by rank; a rejected entry stays rejected.
STATUS_RANK = {"candidate": 0, "needs_review": 1, "approved": 2, "rejected": 3}


def status_rank(x: Column) -> Column:
    rank = F.lit(-1)
    for name, value in STATUS_RANK.items():
        rank = F.when(x == name, value).otherwise(rank)
    return rank


def merge_into(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """``old`` with ``new`` merged in.

    ``rules[column]`` is one of ``new``, ``old``, ``max``, ``min``,
    ``coalesce_old``, ``coalesce_new`` and ``status``. Several new rows of one
    key are folded by the same rules; both sides meet in one aggregation, which
    combines on the map side.
    """
    rows = old.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    folded = {
        "new": lambda c: F.max_by(c, "__side"),
        "old": lambda c: F.min_by(c, "__side"),
        "max": F.max,
        "min": F.min,
        "coalesce_old": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__side"))),
        "coalesce_new": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__side"))),
        "status": lambda c: F.max_by(c, status_rank(F.col(c))),
    }
    return rows.groupBy(*keys).agg(*[folded[how](c).alias(c) for c, how in rules.items()])


def patch(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the columns that a sparse change sets; a null leaves a column as it is."""
    names = [c for c in changes.columns if c != key]
    own = changes.withColumnsRenamed({c: f"__{c}" for c in names})
    joined = rows.join(own, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in rows.columns])


def replace_children(rows: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in ``new`` replaced by the new ones."""
    return rows.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def insert_missing(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and those new ones whose key is not there yet, once each."""
    return rows.unionByName(new.join(rows, keys, "left_anti").dropDuplicates(keys))


def delete_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among those deleted; a null key is never deleted."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def replace_rows(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with those of the same key replaced by the new ones; of several new ones of a key, one."""
    return rows.join(new, keys, "left_anti").unionByName(new.dropDuplicates(keys))
