import math
import pathlib
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from brightloom.llm import lexical_search as L
from brightloom.plans.shared import BATCH_ROWS

SF = "/root/testdata/sf0.001"


def plain_terms(text):
    out, run = [], ""
    for c in (text or "") + " ":
        if c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" or ord(c) > 0x7F:
            run += c.lower() if c <= "Z" else c
        elif run:
            out.append(run)
            run = ""
    return out


def brute(docs, items, k=20):
    """Scores of all documents by the formula, best first; one row a hit."""
    held = [(key, Counter(plain_terms(t))) for key, t in docs if plain_terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    rows = []
    for item, text in set(items):
        found = []
        for key, tf in held:
            m = 75 + (25 * sum(tf.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in plain_terms(text) if t in tf)
            if score > 0:
                found.append((-score, key is None, key, score))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        rows += [(item, i, key, score) for i, (_, _, key, score) in enumerate(found[:k], 1)]
    return Counter(rows)


def searched(spark, tmp_path, docs, items, **how):
    path = str(tmp_path / f"index{random.random()}")
    L.write_index(docs, path, shard_bytes=how.pop("shard_bytes", L.SHARD_BYTES))
    return Counter(map(tuple, L.search(spark, path, items, **how).collect()))


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = L.op12_lexical_search(spark, SF)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == Counter(con.execute(L.ORACLE_SQL["op12_lexical_search"]).fetchall())


def test_many_shards_and_blocks_equal_brute_force(spark, tmp_path):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert searched(spark, tmp_path, docs.repartition(3), items, shard_bytes=20_000, items_at_once=7) == want


def test_odd_tables(spark, tmp_path):
    rows = [(1, "A b\x00c"), (2, None), (3, ""), (4, "..."), (5, "a b c"), (5, "a b c"), (None, "a é"), (7, "É é " * 50_000), (0, "a b c"), (9, "x9 X9")]
    docs = spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id long, text string, term string, item long")
    asked = [(1, "a a B"), (1, "a a B"), (2, None), (3, "unknown"), (None, "é x9"), (4, "É!c"), (4, "x9")]
    items = spark.createDataFrame([(*r, 2) for r in asked], "item_id long, text string, score int")
    for size in (1, 12, 1 << 20):
        assert searched(spark, tmp_path, docs, items, shard_bytes=size, k=3) == brute(rows, asked, 3)


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert not searched(spark, tmp_path, docs, items)
    assert not searched(spark, tmp_path, docs.unionByName(spark.createDataFrame([(1, "a")], docs.schema)), items.limit(0))


def test_string_ids(spark, tmp_path):
    docs = spark.createDataFrame([("b", "q"), ("a", "q"), ("c", "r")], "doc_id string, text string")
    found = searched(spark, tmp_path, docs, spark.createDataFrame([("i", "q")], "item_id string, text string"))
    assert sorted((r[1], r[2]) for r in found) == [(1, "a"), (2, "b")]


@pytest.mark.parametrize("seed", range(5))
def test_max_score_gives_the_best_of_all_scores(seed):
    rng = np.random.default_rng(seed)
    n, k = 200, 5
    shard = L._Lists.__new__(L._Lists)
    shard.size, shard.lists = n, {}
    total = np.zeros(n, np.int64)
    item = []
    for term in range(12):
        at = np.sort(rng.choice(n, rng.integers(1, n), replace=False)).astype(np.int32)
        scores = rng.integers(1, 4 if term % 2 else 40, len(at))
        times = int(rng.integers(1, 3))
        shard.lists[term] = (int(scores.max()), at, scores)
        item.append((term, times))
        total[at] += times * scores
    order = rng.permutation(n)
    best = np.lexsort((order, -total))[:k]
    for threshold in (1, int(total[best[-1]])):
        at, found, raised = L.max_score(shard, item, order, k, threshold)
        assert at.tolist() == best.tolist() and found.tolist() == total[best].tolist() and raised == total[best[-1]]
    assert L.max_score(shard, item, order, k, int(total.max()) + 1)[0].size == 0


def test_nonessential_lists_are_probed_for_few_documents(monkeypatch):
    n, k = 1000, 2
    shard = L._Lists.__new__(L._Lists)
    shard.size = n
    shard.lists = {0: (100, np.array([3, 7, 9], np.int32), np.array([90, 100, 95])), 1: (5, np.arange(n, dtype=np.int32), np.full(n, 5))}
    probed = []
    true = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *x, **y: probed.append(len(v)) or true(a, v, *x, **y))
    at, scores, _ = L.max_score(shard, [(0, 1), (1, 1)], np.arange(n), k, 1)
    assert at.tolist() == [7, 9] and scores.tolist() == [105, 100] and probed == [3]


def test_terms():
    for t in ["", "a-b_c", "É x", "ÀB 9\x7fz", "\x00q r"]:
        assert [x.decode() for x in L.terms_of(t.encode())] == plain_terms(t)
    assert L.terms_of(None) == []


def test_memory_does_not_grow_with_the_shards_of_a_file(spark, tmp_path, monkeypatch):
    """A file of many shards has row groups of a few, and a worker gets one shard at a time."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(2000))) for i in range(60)], "doc_id long, text string").coalesce(1)
    monkeypatch.setitem(L.INDEX_OPTIONS, "parquet.block.size", str(1 << 16))
    searched_by = L._searched

    def watched(*how):
        run = searched_by(*how)

        def one_at_a_time(batches):
            def counted():
                for batch in batches:
                    assert batch.num_rows == 1
                    yield batch

            return run(counted())

        return one_at_a_time

    monkeypatch.setattr(L, "_searched", watched)
    path = str(tmp_path / "index")
    L.write_index(docs, path, shard_bytes=10_000)
    groups = [f.metadata for f in map(pq.ParquetFile, pathlib.Path(path).glob("*.parquet"))]
    assert sum(g.num_rows for g in groups) == 60 and sum(g.num_row_groups for g in groups) > 10
    items = spark.createDataFrame([(1, docs.first().text[:50])], "item_id long, text string")
    assert Counter(map(tuple, L.search(spark, path, items).collect())) == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert spark.conf.get(BATCH_ROWS) == "10000"
