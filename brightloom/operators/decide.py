"""Folds whose order matters: first-seen representatives, and overrides of which the first wins a field."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def alike(a: str, b: str) -> bool:
    """Whether two keys without blanks say about the same.

    Keys of fewer than five characters must be equal. Of others, three fifths of
    the longer one's length must be characters of the shorter one that the
    longer one has as well; where the shorter one has fewer than twenty, the
    longer one may be twice as long at most.
    """
    if a == b:
        return True
    short, long = sorted((a, b), key=len)
    if len(short) < 5:
        return False
    held = set(long)
    if sum(c in held for c in short) < 0.6 * len(long):
        return False
    return len(short) >= 20 or len(long) - len(short) <= 0.5 * len(long)


def first_seen(rows: DataFrame, group: str, position: str, key: Column, score: Column, text: Column, match: Callable[[str, str], bool] = alike) -> DataFrame:
    """``group, place, position, key, text, score, rows``: what stands for the rows of each group, in order of first sight.

    In order of position, a row belongs to the first representative whose key
    matches its own, and else becomes one. A representative keeps the key and
    position that it was first seen with, and shows the text of its best row
    (the first of equals); ``rows`` counts what belongs to it. Rows with equal
    keys are one before the fold, which then holds no more than a group's
    representatives at a time. Null positions come first, null keys are empty,
    rows without a group are left out.
    """
    named = rows.select(F.col(group).alias("grp"), F.col(position).cast("long").alias("position"), F.coalesce(key, F.lit("")).alias("key"), F.coalesce(score.cast("double"), F.lit(0.0)).alias("score"), F.coalesce(text, F.lit("")).alias("text")).where("grp IS NOT NULL")
    # Equal keys meet the same representative: of theirs the first place and the best row count.
    best = F.struct((-F.col("score")).alias("least"), F.coalesce("position", F.lit(-(1 << 62))).alias("at"), F.col("text").alias("text"))
    once = named.groupBy("grp", "key").agg(F.min(F.coalesce("position", F.lit(-(1 << 62)))).alias("position"), F.min(best).alias("b"), F.count(F.lit(1)).alias("n"))
    once = once.select("grp", "position", "key", (-F.col("b.least")).alias("score"), F.col("b.at").alias("at"), F.col("b.text").alias("text"), "n")
    kind = dict(once.dtypes)["grp"]
    columns = ["grp", "place", "position", "key", "text", "score", "rows"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, []

        def told() -> pd.DataFrame:
            return pd.DataFrame([(current, place, h["position"], h["key"], h["text"], h["score"], h["n"]) for place, h in enumerate(held)], columns=columns)

        for batch in batches:
            for row in batch.to_dict("records"):
                if held and row["grp"] != current:
                    yield told()
                    held = []
                current = row["grp"]
                found = next((h for h in held if match(row["key"], h["key"])), None)
                if found is None:
                    held.append(row)
                    continue
                found["n"] += row["n"]
                if (-row["score"], row["at"]) < (-found["score"], found["at"]):
                    found.update(score=row["score"], at=row["at"], text=row["text"])
        if held:
            yield told()

    ordered = once.repartition("grp").sortWithinPartitions("grp", "position", "key")
    found = ordered.mapInPandas(fold, f"grp {kind}, place long, position long, key string, text string, score double, rows long")
    return found.withColumn("position", F.when(F.col("position") > -(1 << 62), F.col("position"))).withColumnRenamed("grp", group)


def overridden(base: DataFrame, id_col: str, fields: list[str], changes: DataFrame) -> DataFrame:
    """``base`` with ``fields`` as the changes have them, and ``applied``, the rules that changed something.

    ``changes(id, priority, rule, field, value)``: of the changes of a field the
    one with the least priority wins (then the first rule by name); what it says
    replaces the base's value unless it says the same or nothing. ``applied``
    are the rules that replaced a value, by priority. Values are strings; ids
    without a change, and changes of no known field, change nothing. The base
    has one row an id.
    """
    wins = changes.where(F.col("field").isin(fields) & F.col("value").isNotNull() & F.col("rule").isNotNull())
    first = wins.groupBy("id", "field").agg(F.min(F.struct("priority", "rule", "value")).alias("w"))
    wide = first.groupBy(F.col("id").alias("__id")).agg(*[F.max(F.when(F.col("field") == f, F.col("w"))).alias(f"w_{f}") for f in fields])
    rows = base.join(wide, base[id_col] == wide["__id"], "left")
    replaced = {f: F.col(f"w_{f}.value").isNotNull() & ~F.col(f"w_{f}.value").eqNullSafe(F.col(f)) for f in fields}
    used = F.array_compact(F.array(*[F.when(replaced[f], F.struct(F.col(f"w_{f}.priority").alias("p"), F.col(f"w_{f}.rule").alias("r"))) for f in fields]))
    keep = [F.col(c) for c in base.columns if c not in fields]
    return rows.select(*keep, *[F.when(replaced[f], F.col(f"w_{f}.value")).otherwise(F.col(f)).alias(f) for f in fields], F.transform(F.array_sort(F.array_distinct(used)), lambda x: x["r"]).alias("applied"))


def in_first_order(triggers: DataFrame, id_col: str, order: list[str], label: str) -> DataFrame:
    """``id, labels``: each row's different labels in order of first sight."""
    first = triggers.where(F.col(label).isNotNull()).groupBy(id_col, label).agg(F.min(F.struct(*order)).alias("o"))
    return first.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("o", label))).alias("x")).select(id_col, F.col(f"x.{label}").alias("labels"))
