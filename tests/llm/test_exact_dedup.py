import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from brightloom.llm import exact_dedup as exact
from brightloom.llm.exact_dedup import ORACLE_SQL, exact_dedup, exact_groups, op1_exact_dedup

SF = "/root/testdata/sf0.001"


def check(docs, rows):
    groups = {}
    for i, t in docs:
        groups.setdefault(t or "", []).append(i)
    assert len(rows) == len(docs)
    kept = {}
    for r in rows:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256 and r.doc_id in groups[t])
        ids = [i for i in groups[text] if i is not None]
        assert r.keep_id == (max(ids) if ids else None) and r.group_size == len(groups[text])
        kept[text] = kept.get(text, 0) + r.kept
    assert set(kept.values()) == {1}


def test_groups_of_texts(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 1, 7, 8, 9, 16, 17, 40, 41, 64, 333)]
    near = [b[:-1] + "c" for b in base if b] + [b + "a" for b in base] + ["c" + b[1:] for b in base if b]
    docs = [(i, t) for i, t in enumerate(base + near + base + [base[-1]] * 9 + ["é" * 30, "é" * 30])]
    docs += [(500, None), (501, ""), (None, base[3]), (None, "only null"), (7000, "same row"), (7000, "same row")]
    rng.shuffle(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    check(docs, exact_groups(table, block_bytes=8).collect())
    check(docs, exact_groups(table).collect())


def test_names_are_identities(spark):
    docs = spark.createDataFrame([(i, "ab" * (i % 5)) for i in range(20)], "doc_id long, text string")
    rows = exact_groups(docs, block_bytes=2).collect()
    assert len({(r.height, r.name) for r in rows}) == len({r.text_sha256 for r in rows}) == 5


def test_rows_stay_as_they_were(spark):
    docs = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "y", 2), (2, "a", "y", 2), (3, None, None, 3)], "doc_id long, text string, name string, kept int")
    rows = exact_dedup(docs)
    assert rows.columns == docs.columns
    assert sorted(tuple(r) for r in rows.collect()) == sorted([(2, "a", "y", 2), (3, None, None, 3)])
    assert exact_dedup(docs.limit(0)).collect() == []


def test_a_text_of_many_blocks(spark):
    long = "x" * 100_001
    rows = exact_groups(spark.createDataFrame([(1, long), (2, long), (3, long[:-1] + "y")], "doc_id long, text string"), block_bytes=64).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows} == {1: (2, 2), 2: (2, 2), 3: (3, 1)}


def test_names_are_sort_positions_however_rows_are_dealt(spark):
    texts = ["".join(random.Random(i).choice("ab") for _ in range(i % 23)) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    named = lambda df: {(r.doc_id, r.height, r.name) for r in exact_groups(df, block_bytes=8).collect()}
    first = named(docs.coalesce(1))
    assert named(docs.repartition(5)) == first
    blocks = sorted({t[i : i + 8] for t in texts for i in range(0, max(1, len(t)), 8)})
    assert {(d, n) for d, h, n in first if h == 0} == {(i, blocks.index(t)) for i, t in enumerate(texts) if len(t) <= 8}


def test_blocks_of_a_hot_prefix_keep_their_order(spark, monkeypatch):
    texts = ["".join(random.Random(i).choice("ab") for _ in range(i % 41)) for i in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    named = lambda: {(r.doc_id, r.height, r.name) for r in exact_groups(docs, block_bytes=16).collect()}
    first = named()
    monkeypatch.setattr(exact, "PREFIX", 2)
    monkeypatch.setattr(exact, "HOT", 3)
    assert named() == first


def test_blocks_that_share_a_digest_stay_apart(spark):
    texts = ["".join(random.Random(i).choice("abc") for _ in range(i % 31)) for i in range(90)] * 2
    docs = list(enumerate(texts))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    clashing = lambda block: F.substring(F.sha2(block, 256), 1, 1)  # noqa: E731  one of 16
    rows = exact_groups(table, block_bytes=8, digest=clashing)
    check(docs, rows.collect())
    assert {(r.doc_id, r.height, r.name) for r in rows.collect()} == {(r.doc_id, r.height, r.name) for r in exact_groups(table, block_bytes=8).collect()}


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({ORACLE_SQL['op1_exact_dedup']}) ORDER BY ALL").fetchall()
    assert sorted(tuple(r) for r in op1_exact_dedup(spark, SF).collect()) == want
