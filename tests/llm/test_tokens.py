import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from brightloom.llm import packing as K
from brightloom.llm import token_store as S
from brightloom.llm.tokens import Encoder, default_tokenizer, encoder
from brightloom.plans.shared import Scratch

HARD = ["", "  ", "a\n\nb", "It's we'll O'Neil'S x'", "naïve Straße ŒUVRE İstanbul Ǆ", "<|endoftext|>abc <|startoftext|>", "é café ́x", "日本語 12345 ½ ²", "a\x1cb\x85c\xa0d e", "😀👍🏽 ok", "ΣΑΣ ΟΔΟΣ", "a\tb\r\nc", "ſ K Å", "x" * 50_000]


def plain(text):
    return encoder(default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(spark):
    own = Encoder(default_tokenizer())
    texts = HARD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in texts:
        assert own.encode(t or "").tolist() == plain(t), t[:50]


def test_every_latin_character_in_a_word():
    own = Encoder(default_tokenizer())
    for c in map(chr, range(0xA1, 0x250)):
        for t in (f"{c}li", f"a{c}b", f"so {c}{c} x{c} 1{c}"):
            assert own.encode(t).tolist() == plain(t), hex(ord(c))


def test_store_round_trip(spark):
    texts = [(i, t) for i, t in enumerate(HARD)] + [(50, None), (51, HARD[-1]), (52, "word " * 30_000), (None, "null id"), (52, "word " * 30_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, root string").repartition(3)
    out = Scratch(spark, "test").path("store")
    S.write_store(docs, out)
    rows = sorted(S.read_store(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i))
    text, start = dict(texts), 0
    for r in rows:
        want = np.array(plain(text[r.doc_id]) + [1], "<u4")
        assert r.start == start and r.n_tokens == len(want) and bytes(r.ids) == want.tobytes()
        start += len(want)
    sums = {(r.start, r.n_tokens, r.ids_crc32) for r in S.checksums(spark, out).collect()}
    assert sums == {(r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in rows}
    chunks = spark.read.parquet(f"{out}/chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count()
    assert spark.read.parquet(f"{out}/manifest").where("level = 0").agg({"count": "sum"}).first()[0] == len(texts)


def test_cuts_follow_content_and_have_a_longest():
    ids = np.random.default_rng(1).integers(0, 49_000, 40_000).astype(np.uint32)
    ends = S.cut_points(ids)
    assert ends[-1] == len(ids) and max(np.diff([0, *ends])) <= S.MAX_CHUNK
    shifted = [e - 7 for e in S.cut_points(np.concatenate([np.arange(7, dtype=np.uint32), ids]))]
    assert len(set(ends) & set(shifted)) > 0.9 * len(ends)
    assert max(np.diff([0, *S.cut_points(np.zeros(100_000, np.uint32))])) <= S.MAX_CHUNK


def test_a_damaged_chunk_is_noticed(spark):
    out = Scratch(spark, "test").path("store")
    S.write_store(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), out)
    chunks = spark.read.parquet(f"{out}/chunks")
    bad = Scratch(spark, "test").path("bad")
    chunks.selectExpr("chunk_id", "n_ids", "unhex('00000000') AS payload").write.parquet(f"{bad}/chunks")
    for table in ("recipes", "manifest"):
        spark.read.parquet(f"{out}/{table}").write.parquet(f"{bad}/{table}")
    with pytest.raises(Exception, match="address"):
        S.checksums(spark, bad)
    gone = Scratch(spark, "test").path("gone")
    chunks.limit(0).write.parquet(f"{gone}/chunks")
    for table in ("recipes", "manifest"):
        spark.read.parquet(f"{out}/{table}").write.parquet(f"{gone}/{table}")
    with pytest.raises(Exception, match="address"):
        S.checksums(spark, gone)


def test_a_recipe_that_was_changed_or_removed_is_noticed(spark):
    out = Scratch(spark, "test").path("store")
    S.write_store(spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string"), out)
    S.verify_manifest(spark, out)
    recipes = spark.read.parquet(f"{out}/recipes")
    for change in (recipes.where("doc_id <> 3"), recipes.withColumn("doc_id", F.col("doc_id") + 1), recipes.withColumn("start", F.col("start") + 1), recipes.unionByName(recipes.where("doc_id = 1"))):
        bad = Scratch(spark, "test").path("bad")
        change.write.parquet(f"{bad}/recipes")
        spark.read.parquet(f"{out}/manifest").write.parquet(f"{bad}/manifest")
        spark.read.parquet(f"{out}/chunks").write.parquet(f"{bad}/chunks")
        with pytest.raises(ValueError, match="manifest"):
            S.read_store(spark, bad)


def test_recipes_stand_in_order_over_files(spark):
    out = Scratch(spark, "test").path("store")
    docs = spark.createDataFrame([((i * 7919) % 4001, f"text {i}") for i in range(4000)], "doc_id long, text string").repartition(7)
    size = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        S.write_store(docs, out)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", size)
    files = sorted({r.f for r in spark.read.parquet(f"{out}/recipes").select(F.input_file_name().alias("f")).collect()})
    assert len(files) > 1
    ids = [i for f in files for i in pq.read_table(f.removeprefix("file://"), columns=["doc_id"]).column(0).to_pylist()]
    assert ids == sorted(ids) and len(ids) == 4000


def whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return sorted((r.doc_id, r.text) for r in rows)


def test_op9_equals_the_library_over_the_table(spark):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in S.op9_token_store(spark, "/root/testdata/sf0.001").collect()}
    start = 0
    for doc, text in whole_table(spark):
        want = np.array(plain(text) + [1], "<u4")
        assert got.pop(doc) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert not got


def test_op5_pieces_make_up_the_librarys_ids(spark):
    pieces = {}
    rows = K.op5_packing(spark, "/root/testdata/sf0.001").collect()
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for doc, text in whole_table(spark):
        ids, at = np.array(plain(text) + [2], "<u4"), 0
        for r in sorted(pieces.pop(doc), key=lambda r: r.start):
            part = ids[at : at + r.length]
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = Scratch(spark, "test").path("store")
    S.write_store(docs, out)
    assert S.checksums(spark, out).collect() == []
    assert K.pack(docs).collect() == []


def check_packing(rows, texts, window=4096):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        want = np.array(plain(texts[doc]) + [2], "<u4").tobytes()
        pieces = sorted(pieces, key=lambda r: r.start)
        assert b"".join(bytes(p.ids) for p in pieces) == want and {p.doc_tokens for p in pieces} == {len(want) // 4}
        assert [p.start for p in pieces] == [sum(len(q.ids) // 4 for q in pieces[:i]) for i in range(len(pieces))]
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += len(p.ids) // 4
        assert at == window or at & (at - 1) == 0


def test_packing_loses_nothing_and_pads_nothing(spark):
    texts = dict(enumerate(HARD)) | {50: None, 52: "word " * 30_000, None: "null id"}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, term1 int")
    check_packing(K.pack(docs).collect(), texts)
    check_packing(K.pack(docs, shard_tokens=3000).collect(), texts)


def test_packing_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_packing(K.pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_bm25_scores_and_neighbours():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 40, rng.integers(5, 60)).astype(np.uint16) for _ in range(30)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=40)
    idf = np.log1p((30 - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = float(np.mean([len(d) for d in docs]))
    index = K.Index(docs, idf, mean)
    for seed in (0, 7):
        want = [sum(idf[t] * (n := (d == t).sum()) * (K.K1 + 1) / (n + K.K1 * (1 - K.B + K.B * len(d) / mean)) for t in np.unique(docs[seed])) for d in docs]
        np.testing.assert_allclose(index.query(seed), want, rtol=1e-4)
    order = list(K.fill_order(docs, idf, mean, window=100))
    assert sorted(order) == list(range(30))
    scores = index.query(order[0])
    assert scores[order[1]] == max(s for i, s in enumerate(scores) if i != order[0])
