"""Duplicates, similarity, clusters, rules and extraction over documents, vectors, pages and conversations."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.functions import scoring as S
from brightloom.functions import text as X
from brightloom.functions import vectors as V
from brightloom.functions.text import OFFER_VALUE, OFFER_WORDS
from brightloom.operators import cluster, dedup, frames, weighted_dup
from brightloom.operators.fingerprints import decided, hex_bits, majority, votes_together, word_hashes, word_votes
from brightloom.plans.shared import Scratch
from brightloom.queries.registry import Registry, hashed_sql, table
from brightloom.sources.pages import page_text_links

registry = Registry()
DIM = 64
BROADCAST_GRAMS = 500_000  # shingles of reference items that are sent to every task


@registry.query("""
    SELECT doc_id, sha256(text) AS content_hash, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents""")
def exact_dup_hash(spark, sf_dir):
    """Every document's content hash and the first document that has it."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    first = rows.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"))
    return rows.join(first, "content_hash").select("doc_id", "content_hash", "first_id")


_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"


_HAM = "bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo))"
NEAR_BITS = 4


@registry.query(f"""
    WITH {hashed_sql(1, 'r')}, d AS (SELECT hi, lo, min(doc_id) AS class_id FROM r GROUP BY hi, lo),
    n AS (SELECT a.hi, a.lo, count(*) AS links FROM d a JOIN d b ON (a.hi <> b.hi OR a.lo <> b.lo) AND {_HAM} <= {NEAR_BITS} GROUP BY a.hi, a.lo)
    SELECT documents.doc_id, class_id, CASE WHEN class_id IS NOT NULL THEN coalesce(links, 0) END AS links FROM documents LEFT JOIN r USING (doc_id) LEFT JOIN d USING (hi, lo) LEFT JOIN n USING (hi, lo)""")
def near_dup_phash(spark, sf_dir):
    """Each document's class of equal hashes and the number of classes within four differing bits, by bands."""
    docs = table(spark, sf_dir, "documents")
    hashed = Scratch(spark, "hashes").keep(word_hashes(docs, "doc_id", "text").select(F.col("id").alias("doc_id"), "h"), "h")
    return dedup.hash_classes(docs.select("doc_id").join(hashed, "doc_id", "left"), "doc_id", "h", NEAR_BITS)


@registry.query(f"""
    WITH {hashed_sql(1, 'd')}, q AS (SELECT hi, lo FROM d WHERE doc_id = 0)
    SELECT a.doc_id, ({_HAM})::BIGINT AS distance FROM d a, q b WHERE a.doc_id <> 0 ORDER BY 2, 1 LIMIT 1""")
def nearest_hamming(spark, sf_dir):
    """The document whose hash is nearest to a given one's."""
    d = word_hashes(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "h")
    q = word_hashes(table(spark, sf_dir, "documents").where("doc_id = 0"), "doc_id", "text").select(F.col("h").alias("q"))
    rows = d.where("doc_id <> 0").crossJoin(F.broadcast(q)).select("doc_id", V.hamming_hex(F.col("h"), F.col("q")).cast("long").alias("distance"))  # one query row
    return rows.orderBy("distance", "doc_id").limit(1)


@registry.query(f"""
    WITH {hashed_sql(1, 'd')}, b AS (SELECT source, i AS bit, CASE WHEN i >= 32 THEN (hi >> (i - 32)) & 1 ELSE (lo >> i) & 1 END AS v FROM d JOIN documents USING (doc_id), range(64) r(i))
    SELECT source, bit::BIGINT AS bit, 2 * sum(v) >= count(*) AS is_set FROM b GROUP BY source, bit""")
def mean_phash_bits(spark, sf_dir):
    """Majority vote over all bits of a group's hashes; half of the votes set a bit."""
    docs = table(spark, sf_dir, "documents")
    rows = word_hashes(docs, "doc_id", "text").withColumnRenamed("id", "doc_id").join(docs.select("doc_id", "source"), "doc_id")
    votes = majority(rows.select("source", hex_bits(F.col("h")).alias("bits")), ["source"], "bits", at_least=True)
    return votes.select("source", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"), hex_bits(F.col("h")).alias("bits")).select("source", F.col("bit").cast("long").alias("bit"), (F.getbit("bits", F.col("bit")) == 1).alias("is_set"))


_VALUE = OFFER_VALUE.replace("'", "''")
_SAID = "replace(lower(concat_ws(' ', text, transcript)), chr(10), ' ')"
_OFFER = ", ".join(f"'{w}'" for w in OFFER_WORDS)
_TERMS = f"""list_distinct(list_concat(list_transform(regexp_extract_all({_SAID}, '{_VALUE}'), lambda v: 'value:' || regexp_replace(v, '\\s+', '', 'g')), list_concat(
    list_transform(list_filter(sw, lambda x: x IN ({_OFFER})), lambda x: 'term:' || x),
    list_transform(list_filter(list_transform(list_filter(range(1, len(sw) + 1), lambda i: sw[i] IN ({_OFFER})), lambda i: sw[greatest(i - 2, 1):least(i + 2, len(sw))]), lambda c: len(c) >= 2), lambda c: 'context:' || array_to_string(c, ' ')))))"""


def _dup_items(spark, sf_dir):
    """Documents as items: stretches of words as frames, characters as duration, the reply of a conversation as transcript."""
    docs = table(spark, sf_dir, "documents")
    # Counted once: the votes of the stretches together are those of the text.
    counted = Scratch(spark, "votes").keep(word_votes(docs, "doc_id", "text", 10), "votes")
    frames = decided(counted, ["id", "part"]).groupBy(F.col("id").alias("doc_id")).agg(F.collect_list(F.struct(F.col("part").alias("number"), F.col("h").alias("hash"))).alias("frames"))  # ten at most
    mean = decided(votes_together(counted, ["id"]), ["id"]).select(F.col("id").alias("doc_id"), F.col("h").alias("mean_hash"))
    reply = table(spark, sf_dir, "conversations").where("turn = 1").groupBy(F.col("conv_id").alias("doc_id")).agg(F.max("text").alias("transcript"))
    rows = docs.select("doc_id", F.col("n_chars").alias("duration"), "text").join(frames, "doc_id", "left").join(mean, "doc_id", "left").join(reply, "doc_id", "left")
    return rows


@registry.query(f"""
    WITH {hashed_sql(10, 'f')}, {hashed_sql(1, 'm')},
    i AS (SELECT doc_id, n_chars AS duration, coalesce(text, '') AS text, coalesce(reply, '') AS transcript FROM documents LEFT JOIN (SELECT conv_id AS doc_id, max(text) AS reply FROM conversations WHERE turn = 1 GROUP BY 1) USING (doc_id)),
    c AS (SELECT min(doc_id) AS class_id, count(*) AS copies, duration, text, transcript FROM i GROUP BY duration, text, transcript),
    x AS (SELECT a.doc_id AS l, b.doc_id AS r, count(*) FILTER ({_HAM} <= 6) AS close FROM f a JOIN f b ON a.part = b.part AND a.doc_id < b.doc_id WHERE a.doc_id IN (SELECT class_id FROM c) AND b.doc_id IN (SELECT class_id FROM c) GROUP BY 1, 2),
    n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY 1),
    near AS (SELECT l, r, close / least(p.n, q.n) AS frames FROM x JOIN n p ON p.doc_id = l JOIN n q ON q.doc_id = r JOIN m a ON a.doc_id = l JOIN m b ON b.doc_id = r WHERE close / least(p.n, q.n) >= 0.9 AND {_HAM} <= 16),
    w AS (SELECT class_id, duration, t AS tw, s AS trw, {_TERMS} AS terms, length(regexp_replace(concat_ws(' ', text, transcript), '[[:space:]]+', '', 'g')) AS chars
          FROM (SELECT *, {_TOK} AS t, {_TOK.replace('text', 'transcript')} AS s, {_TOK.replace('text', "concat_ws(' ', text, transcript)")} AS sw FROM c)),
    g AS (SELECT *, {{grams_t}} AS gt, {{grams_s}} AS gs FROM w),
    p AS (SELECT l, r, frames, {{jac_t}} AS text, {{jac_s}} AS transcript, {{jac_c}} AS terms, least(a.chars, b.chars) >= 80 AS enough FROM near JOIN g a ON a.class_id = l JOIN g b ON b.class_id = r WHERE abs(a.duration - b.duration) <= 1500),
    v AS (SELECT l, r, 0.4::DOUBLE * frames + 0.3::DOUBLE * text + 0.15::DOUBLE * transcript + 0.15::DOUBLE * terms AS score,
          CASE WHEN enough AND text >= 0.9 AND transcript >= 0.88 AND terms >= 0.82 THEN 'exact_duplicate' WHEN enough AND terms < 0.82 THEN 'same_campaign_different_offer' WHEN enough AND (text >= 0.9 OR transcript >= 0.88) THEN 'near_duplicate' END AS verdict FROM p),
    e AS (SELECT l AS class_id, r AS other, score, verdict FROM v WHERE verdict IS NOT NULL UNION ALL SELECT r, l, score, verdict FROM v WHERE verdict IS NOT NULL),
    b AS (SELECT class_id, count(*) OVER (PARTITION BY class_id) AS links, other, score, verdict FROM e QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY verdict <> 'exact_duplicate', round(score, 9) DESC, other) = 1)
    SELECT i.doc_id, class_id, copies, coalesce(links, 0) AS links, other AS best_id, verdict, round(score, 6) AS score FROM i JOIN c ON i.duration IS NOT DISTINCT FROM c.duration AND i.text = c.text AND i.transcript = c.transcript LEFT JOIN b USING (class_id)""".format(
    **{f"grams_{k}": f"list_distinct(CASE WHEN len({w}) <= 2 THEN {w} ELSE list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]) END)" for k, w in (("t", "tw"), ("s", "trw"))},
    **{f"jac_{k}": f"CASE WHEN len(a.{c}) + len(b.{c}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.{c}, b.{c}))::DOUBLE / len(list_distinct(list_concat(a.{c}, b.{c}))) END" for k, c in (("t", "gt"), ("s", "gs"), ("c", "terms"))},
))
def weighted_duplicates(spark, sf_dir):
    """Each document's class, how many other classes duplicate it on frames, text, transcript and terms, and the best of them."""
    found = weighted_dup.weighted_duplicates(_dup_items(spark, sf_dir), "doc_id")
    return found.select(F.col("id").alias("doc_id"), "class_id", "copies", "links", "best_id", "verdict", F.round("score", 6).alias("score"))


_GRAMS = "list_distinct(CASE WHEN len(w) <= 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)"
_JAC = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"
_SIG = "list_distinct(list_filter(w, lambda x: regexp_matches(x, '[0-9]') OR x IN ('free','off','save','apr','month','down','lease','deal','token','password')))"


@registry.query(f"""
    WITH t AS (SELECT doc_id, source, n_chars, coalesce(text, '') AS text, {_TOK} AS w FROM documents),
    k AS (SELECT *, text AS same FROM t), c AS (SELECT source, n_chars, same, min(doc_id) AS class_id, any_value(w) AS w FROM k GROUP BY ALL),
    g AS (SELECT class_id, source, n_chars, {_GRAMS} AS grams, {_SIG} AS sig FROM c),
    p AS (SELECT l.class_id AS l, r.class_id AS r, {_JAC.format('l.grams', 'r.grams')} AS a, {_JAC.format('l.sig', 'r.sig')} AS b
          FROM g l JOIN g r ON l.source = r.source AND l.class_id < r.class_id AND abs(l.n_chars - r.n_chars) <= 20),
    e AS (SELECT l AS class_id, a, b FROM p UNION ALL SELECT r, a, b FROM p),
    n AS (SELECT class_id, count(*) FILTER (a >= 0.9) AS links, count(*) FILTER (a >= 0.9 AND b >= 0.82) AS exact, count(*) FILTER (a < 0.9) AS different FROM e GROUP BY 1)
    SELECT k.doc_id, class_id, coalesce(links, 0) AS links, coalesce(exact, 0) AS exact_links, coalesce(different, 0) AS different_links
    FROM k JOIN c ON k.source IS NOT DISTINCT FROM c.source AND k.n_chars IS NOT DISTINCT FROM c.n_chars AND k.same = c.same LEFT JOIN n USING (class_id)""")
def post_text_dup(spark, sf_dir):
    """Each document's class of equal texts, and the classes of close length in its source by verdict: how many share nine tenths of its bigrams, how many of these have the same terms, and how many are different."""
    members, p = dedup.text_classes(table(spark, sf_dir, "documents"), "source", fold=False)
    scratch = Scratch(spark, "pairs")
    members, p = scratch.keep(members, "members"), scratch.keep(p, "pairs")
    ends = p.select(F.col("left").alias("class_id"), "signature_similarity").unionAll(p.select("right", "signature_similarity"))
    links = ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("signature_similarity") >= 0.82).alias("exact_links"))
    # Texts without words are alike in both.
    links = links.unionByName(dedup.wordless_links(members).select("class_id", "links", F.col("links").alias("exact_links")))
    # What is compared and not linked is different, so those pairs need not be made.
    links = dedup.close_classes(members).join(links, "class_id", "left")
    counted = [F.coalesce(c, F.lit(0)).alias(c) for c in ("links", "exact_links")] + [(F.coalesce("others", F.lit(0)) - F.coalesce("links", F.lit(0))).alias("different_links")]
    return members.join(links, "class_id", "left").select("doc_id", "class_id", *counted)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of word sequences; order-dependent, so no built-in expression."""
    return pd.Series([1.0 if x == y else SequenceMatcher(None, (x or "").split(), (y or "").split(), autojunk=False).ratio() for x, y in zip(a, b)], dtype=float)


@registry.query()
def post_text_dup_difflib(spark, sf_dir):
    """Pairs of classes with four fifths of their bigrams in common, compared by matching sequences of whole texts."""
    docs = table(spark, sf_dir, "documents")
    _, pairs = dedup.text_classes(docs, "source", least=(4, 5))
    text = docs.select("doc_id", "text")
    l, r = text.withColumnsRenamed({"doc_id": "left", "text": "lt"}), text.withColumnsRenamed({"doc_id": "right", "text": "rt"})
    rows = pairs.join(l, "left").join(r, "right")
    return rows.select("left", "right", F.greatest(sequence_ratio("lt", "rt"), "text_similarity").alias("similarity"))


@registry.query(f"""
    WITH d AS (SELECT doc_id, unnest({_GRAMS.replace('2', '3').replace("|| ' ' || w[i + 1]", "|| ' ' || w[i + 1] || ' ' || w[i + 2]").replace('range(1, len(w))', 'range(1, len(w) - 1)')}) AS g FROM (SELECT doc_id, {_TOK} AS w FROM documents)),
    b AS (SELECT item_id, unnest({_GRAMS.replace('2', '3').replace("|| ' ' || w[i + 1]", "|| ' ' || w[i + 1] || ' ' || w[i + 2]").replace('range(1, len(w))', 'range(1, len(w) - 1)')}) AS g FROM (SELECT item_id, {_TOK} AS w FROM benchmark)),
    n AS (SELECT item_id, count(*) AS total FROM b GROUP BY 1)
    SELECT doc_id, item_id, count(*) AS common, round(count(*) / any_value(total), 6) AS share FROM d JOIN b USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id""".replace("w[i + 3]", "w[i + 2]"))
def benchmark_overlap(spark, sf_dir):
    """Share of a reference item's three-word shingles that a document has."""
    def grams(name, key):
        words = table(spark, sf_dir, name).select(key, X.tokens(F.col("text")).alias("w"))
        return words.select(key, F.explode(X.ngrams(F.col("w"), 3)).alias("g"))

    d, b = grams("documents", "doc_id"), grams("benchmark", "item_id")
    total = b.groupBy("item_id").agg(F.count(F.lit(1)).alias("total"))
    # A set of items that is small goes to the documents, whose counts then combine where they lie.
    small = b.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    common = d.join(F.broadcast(b) if small else b, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("common"))
    return common.join(total, "item_id").select("doc_id", "item_id", "common", F.round(F.col("common") / F.col("total"), 6).alias("share"))


_PAIRS = """pairs AS (SELECT a.label, a.vec_id AS l, b.vec_id AS r, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS c
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)"""


@registry.query(f"WITH {_PAIRS} SELECT label, count(*) // 2 AS pairs, round(avg(c), 6) AS mean FROM pairs GROUP BY label")
def pairwise_cluster_mean(spark, sf_dir):
    """Mean cosine over all pairs of each group."""
    s = cluster.mean_similarity(table(spark, sf_dir, "embeddings"), "label", DIM)
    return s.groupBy("label").agg(F.floor(F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).cast("long").alias("pairs"), F.round(F.avg("similarity"), 6).alias("mean"))


@registry.query(f"WITH {_PAIRS} SELECT l AS vec_id, round(avg(c), 6) AS similarity FROM pairs GROUP BY l")
def member_similarity(spark, sf_dir):
    """Mean cosine of each member to the rest of its group."""
    return cluster.mean_similarity(table(spark, sf_dir, "embeddings"), "label", DIM).select("vec_id", F.round("similarity", 6).alias("similarity"))


@registry.query("SELECT label, (i - 1)::BIGINT AS pos, round(avg(embedding[i]::DOUBLE), 6) AS value FROM embeddings, range(1, 65) r(i) GROUP BY label, i")
def mean_pool_vectors(spark, sf_dir):
    """The element-wise mean of each group's vectors."""
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(*[F.avg(F.col("embedding")[i].cast("double")).alias(f"m{i}") for i in range(DIM)])
    pooled = rows.select("label", F.posexplode(F.array(*[f"m{i}" for i in range(DIM)])).alias("pos", "value"))
    return pooled.select("label", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@registry.query()
def avg_linkage_clusters(spark, sf_dir):
    """Average-linkage clusters within each label, at a low similarity since the vectors are noise."""
    return cluster.cluster_groups(table(spark, sf_dir, "embeddings"), "label", stop=0.1)


@registry.query()
def frame_retention(spark, sf_dir):
    """Frames kept because they differ from the last kept frame of their item."""
    signs = F.aggregate(F.slice("embedding", 1, 32), F.lit(0).cast("long"), lambda s, x: s * 2 + F.when(x > 0, 1).otherwise(0))
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("item"), (F.col("vec_id") % 8).alias("frame"), signs.alias("bits"))
    return frames.keep_changed(rows, "item", "frame", "bits", 14)


def _moments(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "props", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


@registry.query()
def evidence_frame_select(spark, sf_dir):
    """At most five moments of each user, spread over time."""
    return frames.choose_frames(_moments(spark, sf_dir), "user_id", "event_id", "at", 5).select("user_id", "at")


@registry.query()
def evidence_by_priority(spark, sf_dir):
    """At most twelve moments of each user: the ends, great errors, large purchases by the length of their notes, then the widest gaps."""
    rows = _moments(spark, sf_dir)
    severity = F.when(F.col("event_type") == "error", F.when(F.col("value") > 120, 0).when(F.col("value") > 60, 1))
    density = F.when((F.col("event_type") == "purchase") & (F.col("value") > 120), F.length("props"))
    return frames.choose_frames(rows, "user_id", "event_id", "at", 12, severity, density)


@registry.query("""
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS qid, e AS q FROM v WHERE vec_id = 3),
    s AS (SELECT vec_id, list_dot_product(e, q) / sqrt(list_dot_product(e, e) * list_dot_product(q, q)) AS c FROM v, q WHERE vec_id <> qid),
    d AS (SELECT s.vec_id, c, a.source = b.source AS sb, a.lang = b.lang AS sl FROM s JOIN documents a ON a.doc_id = s.vec_id JOIN documents b ON b.doc_id = 3)
    SELECT vec_id AS doc_id, round(c, 6) AS overall, CASE WHEN c >= 0.95 AND sb THEN 'near_duplicate' WHEN c >= 0.75 AND sb AND sl THEN 'same_campaign' WHEN c >= 0.75 AND sb THEN 'same_brand_related'
           WHEN c >= 0.70 THEN 'related' ELSE 'different' END AS verdict, array_to_string(list_filter([CASE WHEN NOT sb THEN 'source' END, CASE WHEN NOT sl THEN 'lang' END], lambda x: x IS NOT NULL), ',') AS differs
    FROM d ORDER BY d.c DESC, vec_id LIMIT 5""")
def related_docs_verdict(spark, sf_dir):
    """The five items related to a given one, their differences and a verdict."""
    e, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    q = e.where("vec_id = 3").select(F.col("embedding").alias("q"))
    one = docs.where("doc_id = 3").select(F.col("source").alias("s0"), F.col("lang").alias("l0"))
    c = e.where("vec_id <> 3").crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("doc_id"), V.cosine(F.col("embedding"), F.col("q")).alias("c"))  # one query row
    rows = c.join(docs, "doc_id").crossJoin(F.broadcast(one)).orderBy(F.col("c").desc(), "doc_id").limit(5)
    sb, sl = F.col("source") == F.col("s0"), F.col("lang") == F.col("l0")
    differs = F.array_join(F.array_compact(F.array(F.when(~sb, F.lit("source")), F.when(~sl, F.lit("lang")))), ",")
    return rows.select("doc_id", F.round("c", 6).alias("overall"), S.similarity_verdict(F.col("c"), sb, sl).alias("verdict"), differs.alias("differs"))


@registry.query("""
    WITH p AS (SELECT a.doc_id AS l, b.doc_id AS r, a.lang AS al, b.lang AS bl, a.source AS "as", b.source AS bs, a.n_chars AS an, b.n_chars AS bn FROM documents a JOIN documents b ON a.doc_id = 1 AND b.doc_id = 2)
    SELECT 'lang' AS field, al AS left_value, bl AS right_value FROM p WHERE al <> bl UNION ALL SELECT 'source', "as", bs FROM p WHERE "as" <> bs UNION ALL SELECT 'n_chars', an::VARCHAR, bn::VARCHAR FROM p WHERE an <> bn""")
def compare_pair(spark, sf_dir):
    """The fields in which two items differ."""
    d = table(spark, sf_dir, "documents")
    one = lambda key, p: d.where(F.col("doc_id") == key).select(*[F.col(c).cast("string").alias(p + c) for c in ("lang", "source", "n_chars")])
    pair = one(1, "l_").crossJoin(F.broadcast(one(2, "r_")))  # one row each
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col("l_" + c).alias("left_value"), F.col("r_" + c).alias("right_value")) for c in ("lang", "source", "n_chars")])
    return pair.select(F.inline(F.filter(fields, lambda x: ~x["left_value"].eqNullSafe(x["right_value"]))))


#: The rules of the rule engine: id, kind, pattern, label, severity.
RULES = [
    ("r01", "keyword", "idiot", "toxic", "high"), ("r02", "keyword", "worthless", "toxic", "high"), ("r03", "keyword", "clown", "toxic", "medium"),
    ("r04", "regex", "token = \"[0-9a-f]+\"", "secret", "high"), ("r05", "regex", "[0-9]{16}", "payment", "high"), ("r06", "regex", "[a-z.0-9]+@[a-z0-9.]+", "contact", "medium"),
    ("r07", "keyword", "license", "legal", "low"), ("r08", "keyword", "copyright", "legal", "low"), ("r09", "regex", "[+]1 [(][0-9]{3}[)]", "contact", "medium"), ("r10", "keyword", "!!", "shouting", "low"),
]
_RULE_VALUES = ", ".join("('{}', '{}', '{}', '{}', '{}')".format(*(x.replace("'", "''") for x in r)) for r in RULES)
_HITS = f"""rules(rule_id, kind, pattern, label, severity) AS (VALUES {_RULE_VALUES}),
    hits AS (SELECT doc_id, rule_id, label, severity FROM documents, rules WHERE CASE WHEN kind = 'keyword' THEN contains(lower(text), lower(pattern)) ELSE regexp_matches(lower(text), pattern) END)"""


def _rule_hits(spark, sf_dir):
    # The rules are a fixed short list: their tests are columns of one scan.
    low = F.lower("text")
    tests = F.array(*[F.when(F.contains(low, F.lit(p.lower())) if kind == "keyword" else F.regexp_like(low, F.lit(p)), F.struct(F.lit(r).alias("rule_id"), F.lit(label).alias("label"), F.lit(sev).alias("severity"))) for r, kind, p, label, sev in RULES])
    return table(spark, sf_dir, "documents").select("doc_id", F.array_compact(tests).alias("hits"))


@registry.query(f"WITH {_HITS} SELECT * FROM hits")
def rule_triggers(spark, sf_dir):
    """One row for every rule that fires on a document."""
    return _rule_hits(spark, sf_dir).select("doc_id", F.inline("hits"))


@registry.query(f"""WITH {_HITS}, f AS (SELECT doc_id, label, min(rule_id) AS first_rule FROM hits GROUP BY 1, 2) SELECT doc_id, string_agg(label, ',' ORDER BY first_rule) AS labels FROM f GROUP BY doc_id""")
def risk_labels_ordered(spark, sf_dir):
    """Distinct labels of each document in the rules' order."""
    rows = _rule_hits(spark, sf_dir).where(F.size("hits") > 0)
    return rows.select("doc_id", F.array_join(F.array_distinct(F.transform("hits", lambda h: h["label"])), ",").alias("labels"))


@registry.query("""
    SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) AS value, 'email' AS kind FROM documents
    UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}')), 'phone' FROM documents
    UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^ <>"]+')), 'url' FROM documents""")
def extract_urls_phones_codes(spark, sf_dir):
    """Addresses, phone numbers and links in each document, from one scan."""
    found = [F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), _tagged(k)) for k, p in (("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"), ("phone", "[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}"), ("url", 'https?://[^ <>"]+'))]
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(F.concat(*found)))


def _tagged(kind):
    return lambda v: F.struct(v.alias("value"), F.lit(kind).alias("kind"))


@registry.query("""
    WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+-[0-9]+|[0-9]{3,}')) AS raw FROM documents)
    SELECT doc_id, raw, try_cast(regexp_replace(raw, '[^0-9]', '', 'g') AS DOUBLE) AS amount, CASE WHEN contains(raw, '-') THEN 'range' ELSE 'plain' END AS family FROM n""")
def extract_prices_offers(spark, sf_dir):
    """Numbers as amounts with their family."""
    n = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+-[0-9]+|[0-9]{3,}"), F.lit(0))).alias("raw"))
    amount = F.regexp_replace("raw", "[^0-9]", "").try_cast("double")
    return n.select("doc_id", "raw", amount.alias("amount"), F.when(F.contains("raw", F.lit("-")), F.lit("range")).otherwise(F.lit("plain")).alias("family"))


@registry.query("""
    WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) AS v FROM documents),
    r AS (SELECT regexp_replace(lower(v), '[0-9]+', '#', 'g') AS family, v, doc_id, row_number() OVER (PARTITION BY regexp_replace(lower(v), '[0-9]+', '#', 'g') ORDER BY length(v) DESC, v, doc_id) AS n FROM n)
    SELECT family, v AS best, doc_id FROM r WHERE n = 1""")
def offer_family_dedupe(spark, sf_dir):
    """Of each family of mentions the longest one."""
    n = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"), F.lit(0))).alias("v"))
    rows = n.withColumn("family", F.regexp_replace(F.lower("v"), "[0-9]+", "#"))
    best = rows.groupBy("family").agg(F.min(F.struct((-F.length("v")).alias("n"), "v", "doc_id")).alias("b"))
    return best.select("family", F.col("b.v").alias("best"), F.col("b.doc_id").alias("doc_id"))


@registry.query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS transcript, count(*) AS turns FROM conversations GROUP BY conv_id")
def transcript_concat(spark, sf_dir):
    """Turns of a conversation joined in order."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["text"]), " ").alias("transcript"), F.count(F.lit(1)).alias("turns"))


@registry.query("""
    WITH m AS (SELECT conv_id, count(*) AS items, sum(length(text)) AS chars, max(length(text)) AS densest FROM conversations GROUP BY conv_id)
    SELECT conv_id, items, chars::BIGINT AS chars, densest, CASE WHEN (items > 4)::INT + (chars > 1400)::INT + (densest > 600)::INT >= 2 THEN 'complex' ELSE 'simple' END AS level FROM m""")
def complexity_metrics(spark, sf_dir):
    """Size measures of each conversation and a level from them."""
    m = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("items"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).cast("long").alias("densest"))
    points = sum(F.when(c, 1).otherwise(0) for c in (F.col("items") > 4, F.col("chars") > 1400, F.col("densest") > 600))
    return m.select("*", F.when(points >= 2, F.lit("complex")).otherwise(F.lit("simple")).alias("level"))


@registry.query(f"""
    WITH t AS (SELECT doc_id, {_TOK} AS w FROM documents), p AS (SELECT doc_id, w, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] IN ('idiot', 'worthless'))) AS i FROM t)
    SELECT doc_id, i::BIGINT AS pos, array_to_string(list_slice(w, greatest(i - 2, 1), i + 2), ' ') AS context FROM p""")
def context_windows(spark, sf_dir):
    """Two words on either side of every keyword."""
    rows = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("w")).where(F.arrays_overlap("w", F.array(F.lit("idiot"), F.lit("worthless"))))
    at = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.get("w", i - 1).isin("idiot", "worthless"))
    rows = rows.select("doc_id", "w", F.explode(at).alias("i"))
    begin = F.greatest(F.col("i") - 2, F.lit(1))
    return rows.select("doc_id", F.col("i").cast("long").alias("pos"), F.array_join(F.slice("w", begin, F.col("i") + 3 - begin), " ").alias("context"))


@registry.query("""
    WITH b AS (SELECT doc_id, [n_chars % 97, n_chars % 31, n_chars % 97 + 40, n_chars % 31 + 4 + n_chars % 13] AS box FROM documents)
    SELECT doc_id, box[4] - box[2] AS height, box[3] - box[1] AS width, box[4] - box[2] < 10 AS fine_print FROM b""")
def fine_print_split(spark, sf_dir):
    """Boxes whose height marks them as fine print."""
    n = F.col("n_chars")
    box = F.array(n % 97, n % 31, n % 97 + 40, n % 31 + 4 + n % 13)
    even, odd = F.filter("box", lambda v, i: i % 2 == 0), F.filter("box", lambda v, i: i % 2 == 1)
    rows = table(spark, sf_dir, "documents").select("doc_id", box.alias("box"))
    return rows.select("doc_id", (F.array_max(odd) - F.array_min(odd)).alias("height"), (F.array_max(even) - F.array_min(even)).alias("width"), (F.array_max(odd) - F.array_min(odd) < 10).alias("fine_print"))


@registry.query()
def html_text_links(spark, sf_dir):
    """Title, visible text and links of every page."""
    return page_text_links(table(spark, sf_dir, "pages"))


@registry.query("""
    SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="'))::BIGINT AS links,
           regexp_extract(url, '^https?://([^/?]+)', 1) AS host, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')) AS normal_url FROM pages""")
def page_outline(spark, sf_dir):
    """Title, number of links, host and normal address of every page by expressions alone."""
    normal = F.lower(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", ""))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit('<a href="')).cast("long").alias("links"),
        F.regexp_extract("url", "^https?://([^/?]+)", 1).alias("host"), normal.alias("normal_url"),
    )


@registry.query(f"""
    WITH d AS (SELECT doc_id, lang, list_distinct({_TOK}) AS w FROM documents), q AS (SELECT list_distinct({_TOK}) AS q FROM benchmark WHERE item_id = 0),
    s AS (SELECT doc_id, len(list_intersect(w, q)) AS c, len(w) AS n, len(q) AS m FROM d, q)
    SELECT doc_id, round(CASE WHEN c = 0 THEN 0.0 ELSE 2.0 * c / (n + m) END, 6) AS f1 FROM s""")
def rubric_score(spark, sf_dir):
    """Token F1 of every document against a reference text."""
    q = table(spark, sf_dir, "benchmark").where("item_id = 0").select(F.array_distinct(X.tokens(F.col("text"))).alias("q"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(X.tokens(F.col("text"))).alias("w")).crossJoin(F.broadcast(q))  # one reference row
    f1 = 2.0 * F.size(F.array_intersect("w", "q")) / (F.size("w") + F.size("q"))
    return rows.select("doc_id", F.round(f1, 6).alias("f1"))


@registry.query("""
    WITH u AS (SELECT user_id, event_id, epoch_ms(ts) AS t FROM events),
    p AS (SELECT a.event_id AS frame_id, b.event_id AS segment_id FROM u a JOIN u b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 600000 AND a.t + 600000 AND a.event_id <> b.event_id)
    SELECT * FROM p""")
def interval_align(spark, sf_dir):
    """Rows of the same key within a time window of each other, both ends included, by time buckets."""
    width = 600_000
    u = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("t"))
    a = u.select("*", F.explode(F.array(*[F.floor(F.col("t") / width) + d for d in (-1, 0, 1)])).alias("bucket")).alias("a")
    b = u.select("*", F.floor(F.col("t") / width).alias("bucket")).alias("b")
    near = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.abs(F.col("a.t") - F.col("b.t")) <= width) & (F.col("a.event_id") != F.col("b.event_id"))
    return a.join(b, near).select(F.col("a.event_id").alias("frame_id"), F.col("b.event_id").alias("segment_id"))


@registry.query()
def embedding_pca3(spark, sf_dir):
    """Vectors projected on their three principal components; a component's sign is free."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    return PCA(k=3, inputCol="v", outputCol="p").fit(rows).transform(rows).select("vec_id", vector_to_array("p").alias("p"))
