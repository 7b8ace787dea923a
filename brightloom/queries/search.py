"""Search queries: BM25, phrases, loose tokens, nearest vectors, fusion, reranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brightloom.functions import text as X
from brightloom.functions import vectors as V
from brightloom.operators import retrieval as R
from brightloom.queries.registry import Registry, table

registry = Registry()
TERMS = ["worthless", "idiot", "token"]
PREFIXES = ["worth", "idi"]

_BM25 = """
    tokens AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    counts AS (SELECT doc_id, len(w) AS len, list_count(list_filter(w, lambda x: x = 'worthless')) AS a,
                      list_count(list_filter(w, lambda x: x = 'idiot')) AS b, list_count(list_filter(w, lambda x: x = 'token')) AS c FROM tokens),
    st AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (c > 0) AS dc FROM counts),
    bm AS (SELECT doc_id,
                  ln((n - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / mean))
                + ln((n - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / mean))
                + ln((n - dc + 0.5) / (dc + 0.5) + 1) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len / mean)) AS score
           FROM counts, st WHERE a > 0 OR b > 0 OR c > 0)"""
_COS = """
    q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
    cosines AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q, q)) AS similarity FROM embeddings, q)"""


def _scores(spark, sf_dir):
    return R.bm25_indexed(spark, R.open_index(spark, f"{sf_dir}/documents.parquet"), TERMS).withColumnRenamed("id", "doc_id")


@registry.query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm WHERE score >= 0.40 * (SELECT max(score) FROM bm) ORDER BY bm.score DESC, doc_id LIMIT 20")
def keyword_bm25_topk(spark, sf_dir):
    """Best documents for fixed terms, at 0.40 of the best score or more."""
    hits = R.relative_cut(_scores(spark, sf_dir))
    return R.top_k(hits, 20, F.col("score").desc(), "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@registry.query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm")
def keyword_bm25_indexed(spark, sf_dir):
    """Scores of all documents that have one of the terms, from a written index."""
    return _scores(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


@registry.query("""
    WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    h AS (SELECT doc_id, contains(' ' || array_to_string(w, ' ') || ' ', ' of the ') AS phrase_hit,
                 len(list_filter(w, lambda x: starts_with(x, 'worth'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'idi'))) > 0 AS prefix_hit FROM t)
    SELECT * FROM h WHERE phrase_hit OR prefix_hit""")
def keyword_phrase_prefix(spark, sf_dir):
    """Documents with a phrase, or with a token for each prefix."""
    return R.phrase_or_prefix(table(spark, sf_dir, "documents"), ["of", "the"], PREFIXES).select("doc_id", "phrase_hit", "prefix_hit")


@registry.query("""
    SELECT p_partkey, p_name FROM part
    WHERE contains(' ' || lower(translate(coalesce(p_name, ''), '_-/.,:;()[]', '           ')) || ' ', ' red ')
       OR contains(' ' || lower(translate(coalesce(p_type, ''), '_-/.,:;()[]', '           ')) || ' ', ' red ')
       OR contains(' ' || lower(translate(coalesce(p_name, ''), '_-/.,:;()[]', '           ')) || ' ', ' ring ')
       OR contains(' ' || lower(translate(coalesce(p_type, ''), '_-/.,:;()[]', '           ')) || ' ', ' ring ')""")
def loose_like_filter(spark, sf_dir):
    """Rows with one of several terms as a whole token in one of several columns."""
    part = table(spark, sf_dir, "part")
    return part.where(X.loose_match([part["p_name"], part["p_type"]], ["red", "ring"])).select("p_partkey", "p_name")


#: Groups of terms that stand for each other in a search.
ALIASES = {"metal": ["standard", "economy", "promo"], "vehicle": ["car", "truck", "suv"]}


def expand_terms(query: str) -> list[str]:
    """A query's own text and, for a trigger among its words, the terms of the group; first mention first."""
    found = [query.lower(), *[t for trigger, group in ALIASES.items() if trigger == query.lower() or (" " in trigger and trigger in query.lower()) for t in group]]
    return list(dict.fromkeys(found))


@registry.query("""
    SELECT p_partkey, p_type, 1.0::DOUBLE AS score FROM part
    WHERE regexp_matches(' ' || lower(p_type) || ' ', ' (metal|standard|economy|promo) ')""")
def alias_expanded_search(spark, sf_dir):
    """Search with a query's aliases; every hit scores 1."""
    part = table(spark, sf_dir, "part")
    return part.where(X.loose_match([part["p_type"]], expand_terms("metal"))).select("p_partkey", "p_type", F.lit(1.0).alias("score"))


@registry.query("""
    SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda z: (z[1] - z[2]) ** 2))), 6) AS distance
    FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
    ORDER BY sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda z: (z[1] - z[2]) ** 2))), vec_id LIMIT 10""")
def knn_l2_topk(spark, sf_dir):
    """Ten nearest vectors by Euclidean distance."""
    e = table(spark, sf_dir, "embeddings")
    return R.nearest(e, R.seed_vector(e, 0), 10).select("vec_id", F.round("distance", 6).alias("distance"))


@registry.query(f"WITH {_COS} SELECT vec_id, round(similarity, 6) AS similarity FROM cosines WHERE vec_id <> 0 AND similarity >= 0.20")
def knn_cosine_floor(spark, sf_dir):
    """All vectors at or above a cosine floor, the seed left out."""
    e = table(spark, sf_dir, "embeddings")
    s = e.where("vec_id <> 0").crossJoin(F.broadcast(R.seed_vector(e, 0))).select("vec_id", V.cosine(F.col("embedding"), F.col("q")).alias("similarity"))  # one query row
    return s.where("similarity >= 0.20").select("vec_id", F.round("similarity", 6).alias("similarity"))


@registry.query(f"WITH {_COS} SELECT vec_id, label, round(similarity, 6) AS similarity FROM cosines WHERE vec_id <> 0 ORDER BY cosines.similarity DESC, vec_id LIMIT 10")
def seed_similarity(spark, sf_dir):
    """The ten vectors most similar to a seed."""
    e = table(spark, sf_dir, "embeddings")
    hits = R.nearest(e.where("vec_id <> 0"), R.seed_vector(e, 0), 10, metric="cosine")
    return hits.join(e.select("vec_id", "label"), "vec_id").select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@registry.query(f"""WITH {_COS}, f AS (SELECT vec_id // 8 AS item, vec_id, 1 - similarity AS distance FROM cosines),
    r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY distance, vec_id) AS n FROM f)
    SELECT item, round(min(distance), 6) AS distance, string_agg(vec_id::VARCHAR, ',' ORDER BY n) FILTER (n <= 3) AS frames FROM r GROUP BY item""")
def frame_hits_grouped(spark, sf_dir):
    """Vectors as frames of an item: least distance and the three best frames of each item."""
    e = table(spark, sf_dir, "embeddings")
    f = e.crossJoin(F.broadcast(R.seed_vector(e, 0))).select(F.expr("vec_id div 8").alias("item"), "vec_id", (1 - V.cosine(F.col("embedding"), F.col("q"))).alias("distance"))  # one query row
    frames = F.slice(F.sort_array(F.collect_list(F.struct("distance", "vec_id"))), 1, 3)
    return f.groupBy("item").agg(F.round(F.min("distance"), 6).alias("distance"), F.array_join(F.transform(frames, lambda x: x["vec_id"].cast("string")), ",").alias("frames"))


_FUSED = f"""{_BM25}, {_COS},
    l1 AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 50)),
    l2 AS (SELECT vec_id AS id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM (SELECT * FROM cosines ORDER BY similarity DESC, vec_id LIMIT 50)),
    fused AS (SELECT id, sum(1.0 / (60 + rank)) AS rrf FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY id)"""


def _fused(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    lexical = R.top_k(_scores(spark, sf_dir), 50, F.col("score").desc(), "doc_id")
    near = R.nearest(e, R.seed_vector(e, 0), 50, metric="cosine")
    return R.fuse(R.ranked(lexical, F.col("score").desc(), "doc_id"), R.ranked(near, F.col("similarity").desc(), "vec_id"))


@registry.query(f"WITH {_FUSED} SELECT id, round(rrf, 9) AS rrf FROM fused")
def rrf_fusion(spark, sf_dir):
    """Fusion of a lexical and a vector list by reciprocal ranks."""
    return _fused(spark, sf_dir).select("id", F.round("rrf", 9).alias("rrf"))


_EVIDENCE = """CASE WHEN n > 0 THEN base * (1 + n / 3.0) + 0.05 * n ELSE base * 0.6 END"""
_COUNTED = """len(list_filter(w, lambda x: starts_with(x, 'worthless'))) > 0 AS h1, len(list_filter(w, lambda x: starts_with(x, 'idiot'))) > 0 AS h2, len(list_filter(w, lambda x: starts_with(x, 'token'))) > 0 AS h3"""


@registry.query(f"""WITH {_FUSED},
    e AS (SELECT id, rrf * 20 AS base, lang, source, {_COUNTED} FROM fused JOIN documents d ON d.doc_id = id JOIN tokens USING (doc_id)),
    s AS (SELECT id AS doc_id, lang, source, base, h1::INT + h2::INT + h3::INT AS n FROM e)
    SELECT doc_id, lang, source, round({_EVIDENCE}, 6) AS score FROM s ORDER BY {_EVIDENCE} DESC, doc_id LIMIT 10""")
def hybrid_search(spark, sf_dir):
    """Flagship: lexical and vector lists fused, reranked by evidence, with their documents."""
    docs = table(spark, sf_dir, "documents")
    hits = docs.join(F.broadcast(_fused(spark, sf_dir)), docs["doc_id"] == F.col("id"))  # at most 100 hits
    scored = hits.select("doc_id", "lang", "source", R.evidence_score(F.col("rrf") * 20, X.tokens(F.col("text")), TERMS).alias("score"))
    return R.top_k(scored, 10, F.col("score").desc(), "doc_id").select("doc_id", "lang", "source", F.round("score", 6).alias("score"))


@registry.query(f"""WITH {_BM25}, e AS (SELECT doc_id, score AS base, {_COUNTED} FROM bm JOIN tokens USING (doc_id)),
    s AS (SELECT doc_id, base, h1::INT + h2::INT + h3::INT AS n FROM e)
    SELECT doc_id, n::BIGINT AS matched, round({_EVIDENCE}, 6) AS score FROM s""")
def rerank_evidence(spark, sf_dir):
    """Lexical hits rescored by the query tokens that their text begins words with."""
    docs = table(spark, sf_dir, "documents")
    hits = R.bm25(docs, TERMS).join(docs.select("doc_id", X.tokens(F.col("text")).alias("w")), "doc_id")
    matched = sum(F.when(F.exists("w", R._starts(t)), 1).otherwise(0) for t in TERMS)
    return hits.select("doc_id", matched.cast("long").alias("matched"), F.round(R.evidence_score(F.col("score"), F.col("w"), TERMS), 6).alias("score"))


#: Words of a query that narrow the search to some categories.
INTENTS = {"spanish": ["es"], "german": ["de"], "french": ["fr"], "european": ["de", "fr", "es"]}


@registry.query(f"WITH {_BM25} SELECT doc_id, lang FROM bm JOIN documents USING (doc_id) WHERE lang IN ('de', 'fr', 'es')")
def intent_filter(spark, sf_dir):
    """Hits of the categories that a query's words ask for; all hits where none does."""
    docs = table(spark, sf_dir, "documents")
    allowed = sorted({c for w in "worthless european token".split() for c in INTENTS.get(w, [])})
    hits = R.bm25(docs, TERMS).join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", "lang")
    return hits.where(F.col("lang").isin(allowed)) if allowed else hits


@registry.query("""
    WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id IN (0, 1)),
    s AS (SELECT vec_id, max(list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q, q))) AS score FROM embeddings, q GROUP BY vec_id)
    SELECT vec_id, round(score, 4) AS score FROM s WHERE score >= 0.15""")
def min_score_filter(spark, sf_dir):
    """Vectors whose best cosine over several query vectors reaches a floor."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id IN (0, 1)").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("qs"))  # two vectors in one row
    s = e.crossJoin(F.broadcast(queries)).select("vec_id", F.array_max(F.transform("qs", lambda q: V.cosine(F.col("embedding"), q["embedding"]))).alias("score"))
    return s.where("score >= 0.15").select("vec_id", F.round("score", 4).alias("score"))


@registry.query("""
    WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)
    SELECT o_orderkey, o_orderstatus, l_partkey, l_linenumber FROM orders LEFT JOIN r ON l_orderkey = o_orderkey AND n = 1""")
def hydrate_thumbnail(spark, sf_dir):
    """Rows with the first of their children by a two-key order."""
    lines = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_quantity").desc(), "l_linenumber", "l_partkey", "l_suppkey")
    first = lines.withColumn("n", F.row_number().over(w)).where("n = 1").select("l_orderkey", "l_partkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders")
    return orders.join(first, orders["o_orderkey"] == first["l_orderkey"], "left").select("o_orderkey", "o_orderstatus", "l_partkey", "l_linenumber")
