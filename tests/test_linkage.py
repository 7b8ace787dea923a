"""Average linkage by rounds against the plain version."""

import numpy as np
import pytest

from brightloom.operators import cluster as C
from brightloom.operators import linkage as L

SF = "/root/testdata/sf0.001"


def table(spark, vectors, group="a"):
    rows = [(group, i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "label string, vec_id long, embedding array<double>")


def plain(vectors, stop, size=3):
    return C.average_linkage(np.asarray(vectors, float), stop, size).tolist()


@pytest.mark.parametrize("stop,block", [(0.1, 16), (0.35, 4096)])
def test_given_vectors(spark, stop, block):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").where("label < 4")
    want = {tuple(r) for r in C.cluster_groups(rows, "label", stop=stop).collect()}
    assert {tuple(r) for r in L.linked_clusters(rows, "label", "vec_id", stop, 3, block).collect()} == want


def test_families_copies_and_chains(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(9, 12))
    vectors = [c + rng.normal(size=12) * rng.uniform(0.05, 0.9) for c in centres for _ in range(9)]
    vectors += [vectors[3] * 2.0, vectors[3], vectors[40], vectors[40] * 0.5]  # copies, up to length
    got = {r.vec_id: r.cluster for r in L.linked_clusters(table(spark, vectors), "label", "vec_id", 0.75, 3, 20).collect()}
    assert [got[i] for i in range(len(vectors))] == plain(vectors, 0.75)


def test_zero_vectors_single_vectors_and_no_rows(spark):
    vectors = [[0, 0], [0, 0], [0, 0], [1, 0], [1, 0], [1, 0], [0, 1]]
    got = {r.vec_id: r.cluster for r in L.linked_clusters(table(spark, vectors), "label", "vec_id", 0.5, 3).collect()}
    assert got == {0: -1, 1: -1, 2: -1, 3: 0, 4: 0, 5: 0, 6: -1}
    assert L.linked_clusters(table(spark, [[1, 2]]).limit(0), "label", "vec_id", 0.5, 3).collect() == []


def test_small_and_large_groups_together(spark):
    rng = np.random.default_rng(2)
    many = np.repeat(rng.normal(size=(4, 6)), 10, axis=0) + rng.normal(size=(40, 6)) * 0.2
    few = many[:9]
    rows = table(spark, many, "large").unionByName(table(spark, few, "small")).unionByName(table(spark, few[:4], None))
    got = {(r.label, r.vec_id): r.cluster for r in C.cluster_groups(rows, "label", at_once=20).collect()}
    for label, vectors in (("large", many), ("small", few), (None, few[:4])):
        assert [got[label, i] for i in range(len(vectors))] == plain(vectors, 0.75)


def test_places_in_groups(spark):
    rows = spark.createDataFrame([(k % 3, k) for k in range(50)], "g int, k long").repartition(7)
    found = {(r.g, r.k): r.number for r in L.numbered(rows, "g", "k", L.Scratch(spark, "t"), "n").collect()}
    assert found == {(k % 3, k): k // 3 for k in range(50)}


def test_rounds_end_in_one_task(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(90, 16))
    rows = table(spark, vectors).unionByName(table(spark, vectors[:70], "b"))
    seen = []
    best = L._best
    monkeypatch.setattr(L, "_best", lambda seeking, live, block: seen.append(1) or best(seeking, live, block))
    got = {(r.label, r.vec_id): r.cluster for r in L.linked_clusters(rows, "label", "vec_id", 0.1, 3, 16, at_once=60).collect()}
    for label, own in (("a", vectors), ("b", vectors[:70])):
        assert [got[label, i] for i in range(len(own))] == plain(own, 0.1)
    assert len(seen) <= 4
