"""The search engine's modes over the given tables, and queries said in other ways.

The queries are the items of ``benchmark``: their first words as text, the item
of the same number as seed, and that item's vector and the next one's as the
vectors of two variants. Items of the visual modes are eight vectors each.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brightloom.functions import text as X
from brightloom.operators import retrieval as R
from brightloom.operators import search_engine as S
from brightloom.queries.registry import Registry, table

registry = Registry()
WORDS = 3


def _variants(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    own = items.select(F.col("item_id").alias("qid"), F.array_join(F.slice(X.tokens(F.col("text")), 1, WORDS), " ").alias("text"), F.explode(F.array(F.lit(0), F.lit(1))).alias("nth"))
    # The second way to ask has a word less and the next vector; every fifth query has no vector.
    own = own.withColumn("text", F.when(F.col("nth") == 0, F.col("text")).otherwise(F.regexp_extract("text", "^([a-z0-9]+ )(.*)$", 2)))
    key = F.when(F.col("qid") % 5 != 4, F.col("qid") + F.col("nth"))
    return own.withColumn("key", key).join(vectors, F.col("key") == F.col("vec_id"), "left").select("qid", "nth", "text", F.when(F.col("nth") == 0, F.col("vec_id")).alias("seed"), F.col("embedding").alias("vector"))


def _engine(spark, sf_dir, mode):
    e = table(spark, sf_dir, "embeddings")
    frames = e.where("vec_id % 3 < 2").select(F.expr("vec_id div 8").alias("id"), (F.col("vec_id") % 8).alias("frame"), "embedding")
    index = None if mode in S.BY_VECTORS else R.open_index(spark, f"{sf_dir}/documents.parquet")
    return S.SearchEngine(spark, index, e.select(F.col("vec_id").alias("id"), "embedding"), frames, S.Knobs(visual_least=40))


def _run(spark, sf_dir, mode, allowed=None):
    hits = _engine(spark, sf_dir, mode).search(_variants(spark, sf_dir), mode, allowed)
    return hits.select(*[F.round(c, 6).alias(c) if c in ("score", "rrf", "fts_score", "vec_distance") else F.col(c) for c in hits.columns])


_WORDS = f"""
    base AS (SELECT item_id AS qid, list_slice(regexp_extract_all(lower(text), '[a-z0-9]+'), 1, {WORDS}) AS w FROM benchmark),
    variants AS (SELECT qid, 0 AS nth, w, CASE WHEN qid % 5 <> 4 THEN qid END AS key FROM base UNION ALL SELECT qid, 1, w[2:], CASE WHEN qid % 5 <> 4 THEN qid + 1 END FROM base),
    asked AS (SELECT DISTINCT qid, nth, unnest(w) AS word FROM variants),
    tokens AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM tokens),
    post AS (SELECT id, term, count(*) AS tf, any_value(size) AS size FROM (SELECT id, len(w) AS size, unnest(w) AS term FROM tokens) GROUP BY id, term),
    df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    bm AS (SELECT qid, id, round(max(s), 9) AS fts_score FROM (SELECT qid, nth, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS s
           FROM asked JOIN post ON word = post.term JOIN df USING (term), st GROUP BY qid, nth, id) GROUP BY qid, id),
    begun AS (SELECT qid, id, count(DISTINCT word) AS matched FROM (SELECT * FROM asked WHERE nth = 0) JOIN (SELECT DISTINCT word AS stem, id FROM (SELECT DISTINCT word FROM asked) JOIN post ON starts_with(term, word)) ON stem = word GROUP BY qid, id),
    size AS (SELECT qid, count(*) AS of FROM asked WHERE nth = 0 GROUP BY qid),
    cut AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fts_score DESC, id) AS fts_rank FROM (SELECT *, max(fts_score) OVER (PARTITION BY qid) AS best FROM bm) WHERE fts_score >= 0.40 * best)"""
_VECTORS = """
    emb AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT qid, nth, vec_id AS seed, e AS v FROM variants JOIN emb ON key = vec_id),
    cosines AS (SELECT qid, nth, vec_id AS id, round(list_dot_product(e, v) / sqrt(list_dot_product(e, e) * list_dot_product(v, v)), 9) AS similarity FROM q, emb),
    seeds AS (SELECT qid, seed AS id FROM q WHERE nth = 0),
    best AS (SELECT qid, id, max(similarity) AS similarity FROM cosines ANTI JOIN seeds USING (qid, id) GROUP BY qid, id),
    near AS (SELECT *, 1 - similarity AS vec_distance, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS vec_rank FROM best)"""
_VISUAL = """
    shots AS (SELECT qid, nth, id // 8 AS id, id % 8 AS frame, similarity, row_number() OVER (PARTITION BY qid, nth ORDER BY similarity DESC, id // 8, id % 8) AS n FROM cosines WHERE id % 3 < 2),
    seen AS (SELECT qid, id, max(similarity) AS similarity FROM (SELECT * FROM shots WHERE n <= 320) ANTI JOIN seeds USING (qid, id) GROUP BY qid, id),
    view AS (SELECT *, 1 - similarity AS vec_distance, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS vec_rank FROM seen WHERE similarity >= 0.05)"""
_NULLS = {"score": "NULL::DOUBLE", "rrf": "NULL::DOUBLE", "fts_rank": "NULL::INTEGER", "fts_score": "NULL::DOUBLE", "vec_rank": "NULL::INTEGER", "vec_distance": "NULL::DOUBLE"}
_FUSE = "coalesce(1.0::DOUBLE / (60 + fts_rank), 0) + coalesce(1.0::DOUBLE / (60 + vec_rank), 0) AS rrf"
_EVIDENCE = "CASE WHEN coalesce(matched, 0) > 0 THEN {0} * (1 + matched / of) + 0.05 * matched ELSE {0} * 0.6 END"


def _top(of: str, order: str, **columns: str) -> str:
    """SQL of the engine's columns for the ten best rows of ``of``."""
    told = {**_NULLS, **{c: c for c in columns if not columns[c]}, **{c: x for c, x in columns.items() if x}}
    numbers = ", ".join(f"round({x}, 6) AS {c}" if c in ("score", "rrf", "fts_score", "vec_distance") else f"({x})::INTEGER AS {c}" for c, x in told.items() if c != "source")
    return f"SELECT * FROM (SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY {order}, id))::INTEGER AS rank, id, {told['source']} AS source, {numbers} FROM {of}) WHERE rank <= 10"


@registry.query(f"WITH {_WORDS} {_top('(SELECT * FROM cut WHERE fts_rank <= 80)', 'fts_rank', source="'keyword'", score='fts_score', fts_rank='', fts_score='')}")
def engine_keyword(spark, sf_dir):
    """Keyword mode for every query: whole words, from two fifths of the best score on."""
    return _run(spark, sf_dir, "keyword")


@registry.query(f"WITH {_WORDS}, {_VECTORS} {_top('(SELECT * FROM near WHERE vec_rank <= 80 AND similarity >= 0.20)', 'vec_rank', source="'text_vector'", score='similarity', vec_rank='', vec_distance='')}")
def engine_text(spark, sf_dir):
    """Text mode: the nearest vectors of the better variant, the seed left out, from a floor on."""
    return _run(spark, sf_dir, "text")


@registry.query(f"WITH {_WORDS}, {_VECTORS}, {_VISUAL} {_top('view', 'vec_rank', source="'visual_frame'", score='similarity', vec_rank='', vec_distance='')}")
def engine_visual(spark, sf_dir):
    """Visual mode: items by their nearest frame of any variant."""
    return _run(spark, sf_dir, "visual")


_HYBRID = f"""
    fused AS (SELECT qid, id, fts_rank, fts_score, vec_rank, vec_distance, similarity, {_FUSE} FROM (SELECT * FROM cut WHERE fts_rank <= 40) FULL JOIN (SELECT * FROM near WHERE vec_rank <= 40) USING (qid, id)),
    taken AS (SELECT *, CASE WHEN fts_rank IS NULL THEN similarity END AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, fts_rank NULLS LAST, id) AS first FROM fused) WHERE first <= 10 AND (fts_rank IS NOT NULL OR similarity >= 0.20))"""
_SOURCE = "CASE WHEN fts_rank IS NOT NULL AND vec_rank IS NOT NULL THEN '{0}' WHEN fts_rank IS NOT NULL THEN 'keyword' ELSE '{1}' END"


@registry.query(f"""WITH {_WORDS}, {_VECTORS}, {_HYBRID},
    words AS (SELECT qid, id, fts_rank, fts_score, {_EVIDENCE.format('fts_score')} AS score FROM cut JOIN documents ON doc_id = id LEFT JOIN begun USING (qid, id) JOIN size USING (qid) WHERE fts_rank <= 80 AND lang IN ('de', 'fr', 'es')),
    joined AS (SELECT *, score AS ord, 'keyword' AS source FROM words UNION ALL BY NAME SELECT taken.*, rrf AS ord, {_SOURCE.format('keyword+vector', 'text_vector')} AS source FROM taken JOIN documents ON doc_id = id WHERE lang IN ('de', 'fr', 'es') AND qid NOT IN (SELECT qid FROM words))
    {_top('joined', 'ord DESC, fts_rank NULLS LAST', source='source', score='', rrf='', fts_rank='', fts_score='', vec_rank='', vec_distance='')}""")
def engine_hybrid(spark, sf_dir):
    """Hybrid mode among three languages: keywords first, reranked; both lists fused where no keyword hit is left."""
    allowed = table(spark, sf_dir, "documents").where("lang IN ('de', 'fr', 'es')").select(F.col("doc_id").alias("id"))
    return _run(spark, sf_dir, "hybrid", allowed)


@registry.query(f"""WITH {_WORDS}, {_VECTORS}, {_VISUAL},
    fused AS (SELECT qid, id, fts_rank, fts_score, vec_rank, vec_distance, {_FUSE} FROM (SELECT * FROM cut WHERE fts_rank <= 80) FULL JOIN view USING (qid, id)),
    hits AS (SELECT fused.*, {_EVIDENCE.format('rrf')} AS score, {_SOURCE.format('keyword+visual', 'visual_text')} AS source FROM fused LEFT JOIN begun USING (qid, id) LEFT JOIN size USING (qid))
    {_top('hits', 'score DESC', source='source', score='', rrf='', fts_rank='', fts_score='', vec_rank='', vec_distance='')}""")
def engine_visual_hybrid(spark, sf_dir):
    """Visual hybrid mode: the lexical and the visual list fused and reranked."""
    return _run(spark, sf_dir, "visual_hybrid")


@registry.query(f"""WITH {_WORDS}, {_VECTORS}, {_HYBRID},
    joined AS (SELECT taken.*, {_SOURCE.format('keyword+vector', 'text_vector')} AS source FROM taken WHERE qid IN (SELECT qid FROM q) UNION ALL BY NAME SELECT qid, id, fts_rank, fts_score, fts_score AS score, 'keyword' AS source FROM cut WHERE fts_rank <= 10 AND qid NOT IN (SELECT qid FROM q))
    {_top('joined', 'rrf DESC NULLS LAST, fts_rank NULLS LAST', source='source', score='', rrf='', fts_rank='', fts_score='', vec_rank='', vec_distance='')}""")
def engine_tool(spark, sf_dir):
    """What an assistant's search returns: both lists fused with a floor, keywords alone for queries without a vector."""
    return _run(spark, sf_dir, "tool")


_ALIASES = ", ".join(f"({i}, '{t}', {j}, '{x}')" for i, (t, others) in enumerate(S.VISUAL_ALIASES.items()) for j, x in enumerate(others))
_COLOUR = rf"\b({'|'.join(S.COLOURS)})\s+([a-z0-9_-]+)\b"
_FORMS = ", ".join("(" + f"{j}, " + " || ' ' || ".join({"colour": "c", "thing": "t"}.get(p, f"'{p}'") for p in form) + ")" for j, form in enumerate(S.COLOUR_FORMS))


@registry.query(rf"""
    WITH names AS (SELECT DISTINCT p_name || CASE WHEN p_size % 4 = 0 THEN ' price' WHEN p_size % 4 = 1 THEN ' in a  car' ELSE '' END AS said FROM part), own AS (SELECT said, trim(regexp_replace(said, '\s+', ' ', 'g')) AS t FROM names),
    aliases(place, trigger, nth, text) AS (VALUES {_ALIASES}),
    things AS (SELECT said, unnest(regexp_extract_all(t, '(?i){_COLOUR}', 1)) AS c, unnest(regexp_extract_all(t, '(?i){_COLOUR}', 2)) AS t, unnest(range(len(regexp_extract_all(t, '(?i){_COLOUR}', 1)))) AS place FROM own),
    every AS (SELECT said, 0 AS kind, 0 AS place, 0 AS nth, t AS text FROM own
        UNION ALL SELECT said, 1, place, nth, text FROM own, aliases WHERE contains(lower(t), trigger) OR len(list_filter(string_split(trigger, ' '), lambda x: NOT list_contains(regexp_extract_all(lower(t), '[a-z0-9]+'), x))) = 0
        UNION ALL SELECT said, 2, place, f.nth, f.text FROM things, LATERAL (VALUES {_FORMS}) f(nth, text)),
    once AS (SELECT said, arg_min(text, (kind, place, nth)) AS text, min((kind, place, nth)) AS ord FROM every GROUP BY said, lower(text))
    SELECT said AS q, (row_number() OVER (PARTITION BY said ORDER BY ord) - 1)::INTEGER AS nth, text AS variant FROM once QUALIFY row_number() OVER (PARTITION BY said ORDER BY ord) <= 6""")
def visual_query_variants(spark, sf_dir):
    """Other ways to say what a picture of a part shows: names of its words and of its colour."""
    size = F.col("p_size") % 4
    said = F.concat("p_name", F.when(size == 0, F.lit(" price")).when(size == 1, F.lit(" in a  car")).otherwise(F.lit("")))
    names = table(spark, sf_dir, "part").select(said.alias("qid")).distinct().withColumn("text", F.col("qid"))
    return S.expand_queries(names, S.alias_table(spark, S.VISUAL_ALIASES)).select(F.col("qid").alias("q"), "nth", F.col("text").alias("variant"))
