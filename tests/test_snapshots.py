"""Versions of keyed tables: what readers see, what failed writes leave, which buckets are written."""

import random

import pytest
from pyspark.sql import functions as F

from brightloom.operators.live_index import LiveIndex
from brightloom.sources.snapshots import KeyedTable, TakenVersion

SCHEMA = "item long, frame int, v string"


def rows(spark, *some):
    return spark.createDataFrame(list(some), SCHEMA)


def held(table, version=None):
    return sorted((tuple(r) for r in table.read(version).collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    made = KeyedTable(spark, f"file://{tmp_path}/t")
    made.create(rows(spark, *[(i, f, f"{i}.{f}") for i in range(20) for f in range(3)]), ["item", "frame"], ["item"], 8)
    return made


def test_upsert_and_cascade(spark, table):
    assert len(held(table)) == 60 and table.versions() == [0]
    assert table.apply(rows(spark, (3, 1, "new"), (3, 9, "more"), (50, 0, "far")), rows(spark, (4, 0, None)), ["item"]) == 1
    want = {(i, f): f"{i}.{f}" for i in range(20) for f in range(3) if i != 4} | {(3, 1): "new", (3, 9): "more", (50, 0): "far"}
    assert held(table) == sorted(((*k, v) for k, v in want.items()), key=str)
    # A parent that goes and comes again in one change.
    table.apply(rows(spark, (5, 7, "again")), rows(spark, (5, 0, None)), ["item"])
    assert [r for r in held(table) if r[0] == 5] == [(5, 7, "again")]


def test_only_buckets_concerned_are_written(spark, table):
    before = table.manifest()["folders"]
    table.apply(rows(spark, (3, 1, "new")))
    after = table.manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1


def test_a_reader_keeps_its_version(spark, table):
    old = table.read()
    table.apply(deletes=rows(spark, *[(i, 0, None) for i in range(20)]), by=["item"])
    assert old.count() == 60 and table.read().count() == 0 and table.read(0).count() == 60
    table.apply(rows(spark, (1, 1, "x")))
    assert held(table) == [(1, 1, "x")] and table.versions() == [0, 1, 2]


def test_a_failed_write_leaves_nothing(spark, table):
    folders = lambda: sorted(s.getPath().getName() for s in table.files.listStatus(table._place(f"{table.path}/data")))
    before, there = held(table), folders()
    broken = rows(spark, (1, 1, "x"), (2, 2, "y")).withColumn("v", F.when(F.col("item") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no"):
        table.apply(broken)
    assert held(table) == before and table.versions() == [0] and folders() == there


def test_two_writers(spark, table, monkeypatch):
    other = KeyedTable(spark, table.path)
    stale = table.manifest()
    table.apply(rows(spark, (1, 1, "first")))
    monkeypatch.setattr(other, "manifest", lambda version=None: stale)
    with pytest.raises(TakenVersion):
        other.apply(rows(spark, (1, 1, "second")))
    assert (1, 1, "first") in held(table) and table.versions() == [0, 1]
    with pytest.raises(TakenVersion):
        table.apply(rows(spark, (1, 1, "third")), read_at=0)
    with pytest.raises(TakenVersion):
        table.create(rows(spark, (1, 1, "x")), ["item"])


def test_odd_changes(spark, table):
    assert table.apply(rows(spark).limit(0)) == 0 and table.apply() == 0
    table.apply(rows(spark, (None, None, "n"), (1, None, "m"), (2, 0, "a"), (2, 0, "b"), (2, 0, None)))
    got = {r[:2]: r[2] for r in held(table)}
    assert (got[None, None], got[1, None], got[2, 0]) == ("n", "m", "b") and len(got) == 62
    table.apply(rows(spark, (None, None, "o")), rows(spark, (1, None, None)), ["item", "frame"])
    got = {r[:2]: r[2] for r in held(table)}
    assert got[None, None] == "o" and (1, None) not in got and len(got) == 61
    table.apply(spark.createDataFrame([(7, 7, "ignored", 1)], "item long, frame int, w string, x int"))
    assert (7, 7, None) in held(table) and table.read().columns == ["item", "frame", "v"]
    with pytest.raises(ValueError):
        table.apply(deletes=rows(spark, (1, 1, "x")), by=["frame"])


def test_vacuum(spark, table):
    for n in range(3):
        table.apply(rows(spark, *[(i, 0, f"{n}") for i in range(0, 20, 3)]))
    now = held(table)
    assert table.vacuum(2) > 0 and table.versions() == [2, 3] and held(table) == now and len(held(table, 2)) == 60
    table.vacuum()
    assert held(table) == now and table.vacuum() == 0


def test_an_empty_table_and_a_missing_one(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/e")
    with pytest.raises(FileNotFoundError):
        table.read()
    table.create(rows(spark).limit(0), ["item"])
    assert table.read().collect() == [] and table.apply(rows(spark, (1, 2, "x"))) == 1 and held(table) == [(1, 2, "x")]


def test_an_index_that_follows(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(40)}"
    docs = {i: " ".join(word() for _ in range(rng.randint(0, 12))) for i in range(60)}
    make = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")
    index = LiveIndex(spark, f"file://{tmp_path}/a")
    index.create(make(docs), buckets=16)
    before = index.postings.manifest()["folders"]
    index.update(make({1: "w1 brand new", 99: "w1 w2"}))
    touched = sum(before.get(b) != f for b, f in index.postings.manifest()["folders"].items())
    assert 0 < touched < 16
    index.update(make({2: None, 3: "", 99: "w3"}))
    now = {k: t for k, t in {**docs, 1: "w1 brand new", 3: "", 99: "w3"}.items() if k != 2}
    fresh = LiveIndex(spark, f"file://{tmp_path}/b")
    fresh.create(make(now), buckets=4)
    for terms in (["w1", "w3"], ["brand"], ["none"]):
        want = {r.id: pytest.approx(r.score) for r in fresh.scores(terms).collect()}
        assert {r.id: r.score for r in index.scores(terms).collect()} == want


def test_a_large_bucket_is_several_tasks(spark, tmp_path):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        table = KeyedTable(spark, f"file://{tmp_path}/hot")
        many = spark.range(1000).select(F.lit(7).cast("long").alias("item"), F.col("id").cast("int").alias("frame"), F.lit("old").alias("v"))
        table.create(many, ["item", "frame"], ["item"], 8)
        table.apply(many.where("frame < 10").withColumn("v", F.lit("new")), many.where("frame BETWEEN 5 AND 19"))
    finally:
        spark.conf.set(setting, before)
    (folder,) = table.manifest()["folders"].values()
    assert len([s for s in table.files.listStatus(table._place(folder)) if s.getPath().getName().endswith(".parquet")]) > 1
    assert [(r.frame, r.v) for r in table.read().orderBy("frame").collect()] == [(f, "new" if f < 10 else "old") for f in range(1000) if f < 10 or f > 19]
