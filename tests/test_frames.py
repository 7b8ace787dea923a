"""Choice of frames: rounds over large groups against the task-wise way, and odd tables."""

import random

import pytest
from pyspark.sql import functions as F

from brightloom.operators import frames as P

SCHEMA = "item string, frame long, at long, severity int, chars int"


def chosen(spark, rows, **how):
    table = spark.createDataFrame(rows, SCHEMA)
    got = P.choose_frames(table, "item", "frame", "at", severity=F.col("severity"), density=F.col("chars"), **how)
    assert got.columns == ["item", "frame", "at", "reason"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("k", [1, 2, 5, 12])
def test_rounds_equal_the_choice_in_a_task(spark, k):
    rng = random.Random(k)
    rows = []
    for item in "abcde":
        for frame in range(rng.choice([1, 4, 13, 60])):
            rows.append((item, frame, rng.choice([None, frame * 10, rng.randint(0, 300)]), rng.choice([None] * 8 + [0, 1, 2]), rng.choice([None, 0, 0, 0, 0, 7, 9])))
    small = chosen(spark, rows, k=k)
    assert chosen(spark, rows, k=k, at_once=0) == small
    sizes = {}
    for r in small:
        sizes[r[0]] = sizes.get(r[0], 0) + 1
    assert max(sizes.values()) <= k


def test_order_of_reasons(spark):
    rows = [("a", i, i * 100, None, 0) for i in range(20)]
    rows[4], rows[5], rows[6], rows[7] = ("a", 4, 400, 1, 0), ("a", 5, 500, 0, 50), ("a", 6, 600, None, 30), ("a", 7, 700, None, 40)
    reasons = {r[1]: r[3] for r in chosen(spark, rows, k=7)}
    assert reasons == {0: "ends", 19: "ends", 5: "severity", 4: "severity", 7: "density", 6: "density", 13: "spread"}
    assert {r[1] for r in chosen(spark, rows, k=3)} == {0, 19, 5}


def test_odd_tables(spark):
    assert chosen(spark, []) == []
    rows = [(None, 1, 1, 0, 0), ("a", None, 1, 0, 0), ("b", 3, None, None, None), ("c", 1, 5, None, 1), ("c", 2, 5, None, 1), ("c", 3, 5, None, 0), ("c", 4, 5, None, 0)]
    for at_once in (0, 100):
        assert chosen(spark, rows, k=3, at_once=at_once) == [("b", 3, None, "ends"), ("c", 1, 5, "ends"), ("c", 2, 5, "density"), ("c", 4, 5, "ends")]
        assert len(chosen(spark, rows, k=12, at_once=at_once)) == 5
