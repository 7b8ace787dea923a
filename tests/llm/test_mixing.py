import re

import numpy as np
import pytest

from brightloom.llm import mixing as M
from brightloom.plans.shared import Scratch


def test_water_fill():
    assert M.water_fill([10, 10], [1, 3]) == [5.0, 15.0]
    assert M.water_fill([10, 90], [9, 1]) == [30.0, 70.0]
    assert M.water_fill([0, 0], [1, 2]) == [0.0, 0.0]
    assert M.water_fill([], []) == []
    t = M.water_fill([1, 2, 3, 100, 50], [1, 2, 3, 1, 2])
    assert sum(t) == pytest.approx(156) and all(x <= 3 * s for x, s in zip(t, [1, 2, 3, 100, 50]))


def test_pivot_keeps_words_and_expectations():
    sizes = np.array([90, 40, 30, 20, 10, 5, 3, 1])
    p = np.array([0.3, 0.5, 0.2, 0.9, 0.4, 0.6, 0.1, 0.7])
    mean, rng = np.zeros(8), np.random.default_rng(1)
    for trial in range(3000):
        keys = rng.integers(-(1 << 62), 1 << 62, 8)
        q = M.pivot(M.settle_large(p, sizes, keys, 0), sizes, keys, 0)
        assert abs((q * sizes).sum() - (p * sizes).sum()) < 1e-6
        assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 1 and (q >= -1e-9).all() and (q <= 1 + 1e-9).all()
        mean += q / 3000
    assert np.abs(mean - p).max() < 0.04


def test_targets_are_met(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 37)), f"s{i % 5}") for i in range(2000)] + [(5000, None, "s1"), (5001, "", None), (5002, "a b c", None), (None, "x y", "s2"), (7, "two rows", "s0"), (7, "two rows", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = M.mixing_plan(docs).toPandas()
    assert len(plan) == len(rows) and (plan["copies"] <= 3).all()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(order, M.water_fill([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))])))
    assert sorted(set(plan["target"].round(6))) == sorted({round(v, 6) for v in want.values()})
    source = {i: s for i, _, s in rows}
    plan["source"] = [source[None if i != i else i] or "" for i in plan["doc_id"]]
    for name, group in plan.groupby("source"):
        assert abs((group["copies"] * group["size"]).sum() - want[name or None]) <= 37
    again = M.mixing_plan(docs.repartition(7)).toPandas()
    key = ["doc_id", "text_sha256", "nth", "copies"]
    assert plan[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_a_reduction_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 8)
    monkeypatch.setattr(M, "FAN_IN", 3)
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i % 9)), "ab"[i % 2]) for i in range(300)], "doc_id long, text string, source string")
    plan = M.mixing_plan(docs).toPandas()
    for target, group in plan.groupby("target"):
        assert abs((group["copies"] * group["size"]).sum() - target) <= 9


def test_rows_come_as_often_as_planned(spark):
    docs = spark.createDataFrame([(i, "a b", "st"[i % 2], i) for i in range(40)], "doc_id long, text string, source string, copies int")
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == M.mixing_plan(docs).agg({"copies": "sum"}).first()[0]
    assert M.mix(docs.limit(0)).collect() == [] and M.mixing_plan(docs.limit(0)).collect() == []


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(5)
    names = [f"host{i:04d}" for i in range(3000)] + ["é", "Z", "", None]
    sizes = [int(x) for x in rng.integers(0, 10, len(names) - 1) ** 4] + [900_000]
    order = sorted(range(len(names)), key=lambda i: (names[i] is None, (names[i] or "").encode()))
    want = M.water_fill([sizes[i] for i in order], [1 + k % 3 for k in range(len(order))])
    table = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long").repartition(5)
    got = {r.source: (r.place, r.target) for r in M.source_targets(table, Scratch(spark, "test")).collect()}
    for place, (i, target) in enumerate(zip(order, want)):
        assert got[names[i]][0] == place and got[names[i]][1] == pytest.approx(target, rel=1e-9, abs=1e-6)
    assert M.source_targets(table.limit(0), Scratch(spark, "test")).collect() == []


def test_query_against_plain_counts(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in M.op4_mixing(spark, sf).collect()}
    assert set(got) == set(docs)
    totals = {}
    for source, size in docs.values():
        totals[source] = totals.get(source, 0) + size
    order = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + [None] * (None in totals)
    # Targets by halving: the unit at which the capped shares come to all words.
    low, high = 0.0, 3.0 * sum(totals.values())
    for _ in range(200):
        unit = (low + high) / 2
        low, high = (unit, high) if sum(min((1 + i % 3) * unit, 3 * totals[s]) for i, s in enumerate(order)) < sum(totals.values()) else (low, unit)
    for i, s in enumerate(order):
        mine = [got[d] for d, (source, _) in docs.items() if source == s]
        target = min((1 + i % 3) * high, 3 * totals[s])
        assert all(r.target == pytest.approx(target, rel=1e-6) and r.source_size == totals[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= max(r.size for r in mine)
    for d, (_, size) in docs.items():
        assert got[d].size == size and got[d].taken <= 3 * size and (got[d].taken % size == 0 if size else got[d].taken == 0)
