import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom import catalog, tools
from brightloom.functions import scoring as S
from brightloom.functions import text as X
from brightloom.functions import vectors as V
from brightloom.functions.embed import HashEmbedder, embed_column
from brightloom.operators import cluster, dedup, frames, merge
from brightloom.operators import retrieval as R
from brightloom.operators.components import connected_components
from brightloom.operators.polls import is_live
from brightloom.plans.sqlguard import NotReadOnly, check, guarded


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_expressions(spark):
    assert one(spark, X.normalize_name(F.lit("  Foo & Bar's!  "))) == "foo bar s"
    assert one(spark, X.canonical_text(F.lit("Foo & Bar"))) == "foo and bar"
    assert one(spark, X.slug(F.lit("--"))) == "campaign"
    assert one(spark, X.brand_display(F.lit("acme® BIG  co"))) == "Acme BIG Co"
    assert one(spark, X.product_family(F.lit("2024 Wrangler '23 4xe"))) == "Wrangler 4xe"
    assert one(spark, X.strip_prefix_words(F.lit("acme the sale"), F.lit("acme"))) == "sale"
    assert one(spark, X.ngrams(F.array(*map(F.lit, "abcab")), 2)) == ["a b", "b c", "c a"]
    assert one(spark, X.ngrams(F.array(F.lit("a"), F.lit("b")), 2)) == ["a", "b"]
    assert one(spark, X.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    # Whole tokens only: "car" is not in "healthcare".
    rows = spark.createDataFrame([("a red-car drives",), ("healthcare",), ("cardiologist",), (None,)], "t string")
    assert rows.where(X.loose_match([F.col("t")], ["car"])).count() == 1


def test_vectors_and_bits(spark):
    v = lambda *x: F.array(*[F.lit(float(a)) for a in x])
    assert one(spark, V.cosine(v(10, 0), v(1, 0))) == 1.0
    assert one(spark, V.cosine(v(0, 0), v(1, 0))) == 0.0
    assert one(spark, V.hamming_hex(F.lit("f" * 16), F.lit("0" * 16))) == 64
    assert one(spark, V.hamming_hex(F.lit("f" * 16), F.lit("0" * 8))) is None


def test_scores(spark):
    assert one(spark, S.similarity_verdict(F.lit(0.96), F.lit(True), F.lit(True))) == "near_duplicate"
    assert one(spark, S.similarity_verdict(F.lit(0.96), F.lit(False), F.lit(True))) == "related"
    assert one(spark, S.likelihood(F.lit(True), F.lit(30))) == 1.0
    assert one(spark, S.likelihood(F.lit(True), F.lit(600))) == 0.25
    assert one(spark, S.iso_week_key(F.lit("2027-01-01").cast("timestamp"))) == "2026-w53"
    day = lambda d: F.lit(d).cast("timestamp")
    assert one(spark, is_live(day("2026-06-09"), day("2026-06-01"), day("2026-06-10")))
    assert not one(spark, is_live(day("2026-05-01"), day("2026-06-01"), day("2026-06-10")))
    assert not one(spark, is_live(F.lit(None).cast("timestamp"), day("2026-06-01"), day("2026-06-10")))


def test_average_linkage():
    angles = np.radians([10.0, 200.0, 14.0, 205.0, 12.0, 90.0, 7.0])
    v = np.stack([np.cos(angles), np.sin(angles)], axis=1) * np.arange(1, 8)[:, None]
    assert cluster.average_linkage(v, 0.9, 3).tolist() == [0, -1, 0, -1, 0, -1, 0]
    assert cluster.average_linkage(v, 0.9, 2).tolist() == [0, 1, 0, 1, 0, -1, 0]


def test_mean_similarity_equals_pairs(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(12, 4))
    rows = spark.createDataFrame([(i, i % 3, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, label int, embedding array<float>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for r in cluster.mean_similarity(rows, "label", 4).collect():
        rest = [unit[r.vec_id] @ unit[j] for j in range(12) if j % 3 == r.label and j != r.vec_id]
        assert abs(r.similarity - np.mean(rest)) < 1e-6


def test_frames(spark):
    rows = spark.createDataFrame([("a", i, b) for i, b in enumerate([0, 1, 255, 254, 0])], "item string, frame long, bits long")
    kept = {r.frame: r.kept for r in frames.keep_changed(rows, "item", "frame", "bits", 8).collect()}
    assert kept == {0: True, 1: False, 2: True, 3: False, 4: True}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 0, 201: 200}
    assert connected_components(edges.limit(0)).collect() == []


def test_merge(spark):
    old = spark.createDataFrame([(1, "a", 0.5, "rejected"), (2, None, 0.1, "candidate")], "k long, name string, confidence double, status string")
    new = spark.createDataFrame([(1, "A", 0.3, "approved"), (2, "B", 0.9, "approved"), (3, "C", 0.2, "candidate")], old.schema)
    rules = {"name": "coalesce_old", "confidence": "max", "status": "status"}
    got = {r.k: (r.name, r.confidence, r.status) for r in merge.merge_into(old, new, ["k"], rules).collect()}
    assert got == {1: ("a", 0.5, "rejected"), 2: ("B", 0.9, "approved"), 3: ("C", 0.2, "candidate")}
    assert merge.insert_missing(old, new, ["k"]).count() == 3
    assert merge.replace_children(old, new.where("k = 1"), "k").where("k = 1").first().name == "A"


@pytest.mark.parametrize(
    "bad",
    [
        "DROP TABLE x", "SELECT 1; SELECT 2", "", "WITH a AS (SELECT 1) DELETE FROM a", "EXPLAIN SELECT 1", "SET x = 1",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT reflect('java.lang.System', 'lineSeparator')", "SELECT input_file_name()",
        "SELECT * FROM parquet.`/tmp`", "SELECT * FROM nowhere", "SELECT * FROM default.t", "SELECT (SELECT max(x) FROM csv.`/etc/passwd`) AS y", "SELECT 1 WHERE EXISTS (SELECT * FROM text.`/etc/passwd`)",
        "SELECT 1 WHERE 1 IN (SELECT id FROM json.`/tmp/x`)", "WITH a AS (SELECT * FROM text.`/etc/passwd`) SELECT * FROM a", "SELECT * FROM range(3) ORDER BY java_method('a', 'b')",
        "SELECT sum(id) OVER w FROM t_five WINDOW w AS (ORDER BY java_method('java.lang.System', 'getProperty', 'user.home'))", "SELECT sum(id) OVER (PARTITION BY reflect('a', 'b')) FROM t_five",
        "SELECT sum(id) OVER w FROM t_five WINDOW w AS (PARTITION BY (SELECT max(x) FROM csv.`/etc/passwd`))", "WITH `parquet./root/testdata/sf0.001/region.parquet` AS (SELECT 1) SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`",
        "WITH a AS (SELECT 1), b AS (WITH c AS (SELECT * FROM text.`/etc/passwd`) SELECT * FROM c) SELECT * FROM a", "SELECT * FROM VALUES (java_method('a', 'b')) AS t(x)", "SELECT * FROM t_five PIVOT (max(reflect('a', 'b')) FOR id IN (1, 2))",
        "SELECT * FROM t_five LATERAL VIEW explode(array(reflect('a', 'b'))) t AS x", "SELECT id FROM t_five GROUP BY GROUPING SETS ((reflect('a', 'b')), ())", "SELECT * FROM t_five JOIN t_five u ON reflect('a', 'b') = 'c'",
        "SELECT * FROM t_five, LATERAL (SELECT * FROM json.`/tmp/x`)", "SELECT * FROM IDENTIFIER('parquet.`/tmp`')", "SELECT system.builtin.java_method('a', 'b')", "WITH RECURSIVE a AS (SELECT 1 AS x UNION ALL SELECT x + 1 FROM text.`/x`) SELECT * FROM a",
        "SELECT * FROM t_five TABLESAMPLE (1 ROWS) JOIN orc.`/tmp/x`", "SELECT transform(array(1), x -> reflect('a', 'b', x))", "INSERT INTO t SELECT 1", "SELECT * FROM a_table_function(1)",
    ],
)
def test_guard_refuses(spark, bad):
    spark.range(5).createOrReplaceTempView("t_five")
    with pytest.raises(NotReadOnly):
        check(spark, bad)


def test_guard_allows(spark):
    assert guarded(spark, "SELECT 'drop; it' AS x, replace('a', 'a', 'b') AS y;").first().y == "b"
    assert guarded(spark, "SELECT * FROM range(100)", 10).count() == 11
    spark.range(5).createOrReplaceTempView("t_five")
    assert guarded(spark, "SELECT id FROM t_five ORDER BY id DESC -- the last").first().id == 4
    others = [
        "SELECT sum(id) OVER w AS s FROM t_five WINDOW w AS (PARTITION BY id % 2 ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)", "SELECT CASE WHEN id BETWEEN 1 AND 2 THEN 'a' WHEN id IN (3, 4) THEN 'b' END AS x, -id, NOT (id = 1 OR id IS NULL), CAST(id AS string) FROM t_five",
        "SELECT x.a, filter(array(1, 2), y -> y > 1), map['k'] FROM (SELECT named_struct('a', id) AS x, from_json('{}', 'map<string,int>') AS map FROM t_five)", "SELECT id % 2 AS k, count(DISTINCT id) FROM t_five GROUP BY ROLLUP (id % 2) ORDER BY 1",
        "SELECT * FROM t_five LATERAL VIEW explode(array(1, 2)) t AS x WHERE id LIKE '1%'", "SELECT * FROM VALUES (1, 'a') AS t(x, y)", "SELECT a.id FROM t_five a LEFT JOIN t_five b ON a.id = b.id + 1 WHERE b.id IS NULL",
        "SELECT * FROM t_five, LATERAL (SELECT id + 1 AS n)", "SELECT id FROM t_five WHERE id > (SELECT avg(id) FROM t_five) EXCEPT SELECT 4", "SELECT trim(both ' ' FROM ' a ') AS t, extract(year FROM date '2020-01-01') AS y, current_date IS NOT NULL AS d",
    ]
    for sql in others:
        guarded(spark, sql).collect()
    nested = "WITH a AS (SELECT id, id % 2 AS k FROM T_Five), b AS (SELECT k, count(*) AS n FROM a GROUP BY k HAVING n > 1) SELECT b.k, n, row_number() OVER (ORDER BY n) AS r FROM b JOIN a USING (k) WHERE n IN (SELECT n FROM b) AND EXISTS (SELECT 1 FROM a) UNION ALL SELECT 1, (SELECT max(id) FROM a), 0"
    assert guarded(spark, nested).count() == 6


def test_tools_and_embeddings(spark):
    docs = spark.createDataFrame([(1, "red car"), (2, "blue car car"), (3, "tree")], "doc_id long, text string")
    docs.createOrReplaceTempView("t_docs")
    assert [r.doc_id for r in tools.TOOLS["search_text"](spark, "t_docs", "Car").collect()] == [2, 1]
    assert tools.TOOLS["count_rows"](spark, "t_docs", doc_id=1).first().n == 1
    assert tools.schema_summary(spark).where("view = 't_docs'").count() == 2
    vectors = docs.select(F.col("doc_id").alias("vec_id"), embed_column(HashEmbedder(16), F.col("text")).alias("embedding"))
    assert vectors.where(F.size("embedding") == 16).count() == 3
    same = vectors.collect()
    assert HashEmbedder(16).embed(["tree"])[0] == pytest.approx(same[2].embedding, abs=1e-6)


def test_hybrid_tool_and_vector_timing(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame([(1, "red car"), (2, "blue car car"), (3, "tree")], "doc_id long, text string").write.parquet(path)
    assert [(r.id, r.source) for r in tools.TOOLS["hybrid"](spark, path, "tree car").collect()][0] == (3, "keyword")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 30)], "id long, embedding array<double>")
    both = tools.TOOLS["hybrid"](spark, path, "tree", vectors, [3.0, 1.0], 4).collect()
    assert both[0].source == "keyword+vector" and both[0].id == 3 and len(both) == 4
    with pytest.raises(ValueError):
        tools.TOOLS["hybrid"](spark, path, " ")
    told = tools.TOOLS["time_vectors"](spark, vectors, f"file://{tmp_path}/v", 5).first()
    assert (told.vectors, told.dim, told.k) == (29, 2, 5) and told.insert_ms > 0 and told.search_ms > 0


def test_an_index_that_documents_changed_in(spark, tmp_path):
    docs = [(1, "red car car"), (2, "blue car"), (3, "red red tree"), (4, "")]
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    R.write_postings(table(docs), f"{tmp_path}/a")
    changed = [(2, "red boat"), (3, None), (9, "car")]
    R.replace_postings(spark, f"{tmp_path}/a", table(changed), f"{tmp_path}/b")
    now = [(i, t) for i, t in {**dict(docs), **dict(changed)}.items() if t is not None]
    for terms in (["red", "car"], ["boat"], ["none"]):
        want = {r.doc_id: pytest.approx(r.score, rel=1e-9) for r in R.bm25(table(now), terms).collect()}
        assert {r.id: r.score for r in R.bm25_indexed(spark, f"{tmp_path}/b", terms).collect()} == want


def test_close_hashes_meet_in_any_bands(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    hashes = base + [b ^ sum(1 << int(i) for i in rng.choice(63, size=n, replace=False)) for b, n in zip(base, [1, 2, 3, 4, 5, 6] * 10)] + base[:5]
    rows = spark.createDataFrame([(i, f"{h:016x}") for i, h in enumerate(hashes)] + [(900, None)], "id long, h string")
    got = {r.id: (r.class_id, r.links) for r in dedup.hash_classes(rows, "id", "h", 4).collect()}
    kinds = set(hashes)
    for i, h in enumerate(hashes):
        assert got[i] == (hashes.index(h), sum(0 < (h ^ o).bit_count() <= 4 for o in kinds))
    assert got[900] == (None, None)


def _texts(spark, rows):
    return spark.createDataFrame([(i, "s", len(t), t) for i, t in enumerate(rows)], "doc_id long, source string, n_chars long, text string")


def test_texts_meet_at_rare_bigrams_only(spark, tmp_path, monkeypatch):
    # Of 200 texts with 30 bigrams in common and 31 of their own, two are alike.
    common = " ".join(f"w{k:02d}" for k in range(31))
    rows = [common + " " + " ".join(f"x{i:03d}y{k:02d}" for k in range(30)) for i in range(200)] + [common + " " + " ".join(f"x007y{k:02d}" for k in range(29)) + " x007y99"]
    met = []
    keep = dedup.Scratch.keep
    monkeypatch.setattr(dedup.Scratch, "keep", lambda self, df, name, *a: (lambda kept: met.append(kept.count()) or kept if name == "met" else kept)(keep(self, df, name, *a)))
    _, pairs = dedup.text_classes(_texts(spark, rows), "source")
    assert [(r.left, r.right) for r in pairs.collect()] == [(7, 200)]
    assert met == [1]


def test_texts_without_words_link_without_pairs(spark):
    texts = ["!?", "??", "!?", "-" * 10, "-" * 40, "", "a"]
    members, pairs = dedup.text_classes(_texts(spark, texts), "source", fold=False)
    assert {r.doc_id: r.class_id for r in members.collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6}
    assert pairs.count() == 0
    assert {r.class_id: r.links for r in dedup.wordless_links(members).collect()} == {0: 3, 1: 3, 3: 3, 4: 0, 5: 3}


def test_suggestions_are_reviewed_without_rows_of_their_own(spark):
    plan = catalog.QUERIES["suggestion_review"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_close_hashes_are_counted_in_their_buckets(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BUCKET", 16)
    monkeypatch.setattr(dedup, "STRIP", 4)
    rng = np.random.default_rng(5)
    centres = [0, (1 << 64) - 1, *(int(x) for x in rng.integers(0, 1 << 63, 3))]
    hashes = {c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centres for _ in range(40)}
    rows = spark.createDataFrame([(f"{h:016x}",) for h in hashes] * 2 + [(None,), ("none",)], "h string")
    counted = dedup.link_counts(rows, "h", 4)
    assert "Join" not in counted._jdf.queryExecution().optimizedPlan().toString()
    want = {h: sum(0 < (h ^ o).bit_count() <= 4 for o in hashes) for h in hashes}
    assert {r.bits % (1 << 64): r.links for r in counted.collect()} == {h: n for h, n in want.items() if n}


def test_texts_are_counted_by_verdict(spark, tmp_path):
    words = [f"w{k}" for k in range(40)]
    near, other = " ".join([*words[:39], "w99"]), " ".join(f"v{k}" for k in range(40))
    texts = [" ".join(words), near, " ".join(words), near.replace("w99", "w9999999"), other, "!?", "??", "a b", other, other, other, None]
    rows = [(i, None if i == 8 else "s", None if i == 9 else 3 * len(t or "") if i == 10 else len(t or ""), t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, source string, n_chars long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["post_text_dup"](spark, str(tmp_path))
    # Those of unknown source or length have a row, and nothing to be compared with.
    want = {0: (0, 2, 2, 1), 1: (1, 2, 2, 1), 2: (0, 2, 2, 1), 3: (3, 2, 2, 1), 4: (4, 0, 0, 3), 5: (5, 2, 2, 1), 6: (6, 2, 2, 1), 7: (7, 0, 0, 3), 8: (8, 0, 0, 0), 9: (9, 0, 0, 0), 10: (10, 0, 0, 0), 11: (11, 2, 2, 1)}
    assert {r.doc_id: (r.class_id, r.links, r.exact_links, r.different_links) for r in got.collect()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    told = con.execute(catalog.ORACLE_SQL["post_text_dup"]).fetchall()
    assert {r[0]: r[1:] for r in told} == want
