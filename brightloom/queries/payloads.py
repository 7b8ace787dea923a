"""Payloads of models and providers: repaired products, merged entities, suggestions, broken JSON, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightloom.functions import repair as R
from brightloom.functions import salvage
from brightloom.operators import campaigns
from brightloom.queries.registry import Registry, table

registry = Registry()

MAKES = ["widget", "bolt", "gear"]
_KEPT = ", ".join(f"'{w}'" for w in R.KEPT_CAPITALS)
_MAKES = ", ".join(f"'{m}'" for m in MAKES)


@registry.query(rf"""
    WITH p AS (SELECT p_partkey, p_brand AS brand, unnest(['20GX4 ' || p_name, p_brand || ' ' || p_name || ' ,', '2024 ' || upper(p_name) || ' AWD', p_name, 'x', 'widget', 'ORPHANS ' || p_name]) AS product,
                      generate_subscripts([1, 2, 3, 4, 5, 6, 7], 1) AS pos FROM part),
    a AS (SELECT *, trim(regexp_replace(trim(regexp_replace(product, ' +([!?.,;:])', '\1', 'g'), ' ,;:-'), '^\s*20[A-Z]{{1,4}}[0-9]{{1,4}}\s+', '', 'i')) AS t FROM p),
    b AS (SELECT *, CASE WHEN starts_with(lower(t), lower(brand) || ' ') THEN trim(substr(t, length(brand) + 2)) ELSE t END AS u FROM a),
    c AS (SELECT *, regexp_extract(u, '^(20[0-9]{{2}}) +(.*)$', 1) AS year, regexp_extract(u, '^(20[0-9]{{2}}) +(.*)$', 2) AS rest FROM b),
    d AS (SELECT p_partkey, brand, pos, trim(CASE WHEN year <> '' THEN year || ' ' || CASE WHEN regexp_full_match(u, '[A-Z\s0-9/()-]+') THEN array_to_string(list_transform(string_split(rest, ' '), lambda w: CASE WHEN upper(w) IN ({_KEPT}) THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ') ELSE rest END ELSE u END, ' ,-') AS v FROM c),
    e AS (SELECT *, regexp_replace(lower(v), '[^a-z0-9]+', '', 'g') AS key FROM d WHERE length(v) >= 2 AND NOT regexp_matches(v, '{R.MERGED_MODELS}')),
    s AS (SELECT *, bool_or(regexp_matches(lower(v), '[a-z0-9]+[^a-z0-9]+[a-z0-9]') AND regexp_matches(lower(v), '(^|[^a-z0-9])[0-9]+($|[^a-z0-9])')) OVER (PARTITION BY p_partkey) AS specific FROM e),
    f AS (SELECT p_partkey, key, arg_min(v, pos) AS v, min(pos) AS pos FROM s WHERE NOT (key IN ({_MAKES}) AND (specific OR contains(regexp_replace(lower(brand), '[^a-z0-9]+', '', 'g'), key))) GROUP BY p_partkey, key)
    SELECT p_partkey, string_agg(v, '|' ORDER BY pos) AS products FROM f GROUP BY p_partkey""")
def product_repair(spark, sf_dir):
    """Names of products as recognised, repaired and each once."""
    n, brand = F.col("p_name"), F.col("p_brand")
    said = F.array(F.concat(F.lit("20GX4 "), n), F.concat(brand, F.lit(" "), n, F.lit(" ,")), F.concat(F.lit("2024 "), F.upper(n), F.lit(" AWD")), n, F.lit("x"), F.lit("widget"), F.concat(F.lit("ORPHANS "), n))
    return R.repaired_products(table(spark, sf_dir, "part"), "p_partkey", said, brand, MAKES).select("p_partkey", F.array_join("products", "|").alias("products"))


def _campaign_items(spark, sf_dir):
    """Parts as items: what they suggest as JSON, every seventh of it cut off, and badges."""
    part = table(spark, sf_dir, "part")
    named = F.struct(F.concat_ws(" ", "p_brand", "p_name").alias("name"), F.when(F.col("p_size") % 5 > 0, F.col("p_size") / 50).alias("confidence"))
    days = F.concat(F.lit("The  "), "p_type", F.lit(" Days -"))
    said = F.concat(F.lit("["), F.to_json(named), F.lit(', "'), days, F.lit('"]'))
    said = F.when(F.col("p_partkey") % 7 == 0, F.left(said, F.length(said) - 3)).otherwise(said)
    badges = F.to_json(F.struct(F.array(F.concat(F.lit("Proud official  partner of "), "p_name"), F.concat(F.lit("New "), "p_type")).alias("badges")))
    return part.select("p_partkey", "p_brand", "p_name", "p_type", "p_size", said.alias("said"), F.when(F.col("p_size") % 3 == 0, badges).alias("badges"))


_SIGNALS = """
    named AS (SELECT p_partkey AS id, p_brand AS brand, p_name AS key, p_brand || ' ' || p_name AS name, CASE WHEN p_size % 5 > 0 THEN p_size / 50 ELSE 1.0 END::DOUBLE AS confidence FROM part WHERE p_partkey % 7 <> 0),
    sure AS (SELECT * FROM named WHERE confidence >= 0.5),
    signals AS (SELECT * FROM sure UNION ALL SELECT p_partkey, p_brand, lower(p_type) || ' days', 'The ' || p_type || ' Days', 1.0 FROM part WHERE p_partkey % 7 <> 0
        UNION ALL SELECT p_partkey, p_brand, p_name, p_name, 0.9 FROM part WHERE p_size % 3 = 0 AND p_partkey NOT IN (SELECT id FROM sure))"""


@registry.query(f"WITH {_SIGNALS} SELECT id, brand, key, name, round(confidence, 6) AS confidence FROM signals")
def campaign_suggestions(spark, sf_dir):
    """Campaigns that an item's JSON suggests with enough confidence, and those that its badges name."""
    found = campaigns.signals(_campaign_items(spark, sf_dir), "p_partkey", "p_brand", F.col("said"), F.col("badges"))
    return found.withColumn("confidence", F.round("confidence", 6))


@registry.query(f"""
    WITH {_SIGNALS}, sold AS (SELECT l_partkey AS id, min(l_shipdate) AS sold_at FROM lineitem GROUP BY 1),
    items AS (SELECT p_partkey AS id, sold_at, p_type AS offer, p_name AS product FROM part LEFT JOIN sold ON id = p_partkey WHERE p_size <> 13),
    r AS (SELECT * FROM signals JOIN items USING (id)), once AS (SELECT DISTINCT brand, key, id, sold_at, offer, product FROM r),
    g AS (SELECT brand, key, count(*) AS n, min(sold_at) AS start, max(sold_at) AS "end", sum(('0x' || substr(md5(id::VARCHAR), 1, 12))::BIGINT) AS mark FROM once GROUP BY 1, 2 HAVING count(*) >= 2),
    k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY brand, n, mark ORDER BY key) = 1),
    called AS (SELECT brand, key, name FROM (SELECT brand, key, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS words, count(*) AS n, round(sum(confidence), 9) AS sure, min(name) AS name FROM r GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY brand, key ORDER BY n DESC, sure DESC, lower(name), name) = 1),
    offers AS (SELECT brand, key, offer FROM once GROUP BY brand, key, offer QUALIFY row_number() OVER (PARTITION BY brand, key ORDER BY count(*) DESC, offer) = 1),
    goods AS (SELECT brand, key, string_agg(product, '|' ORDER BY nth) AS products FROM (SELECT brand, key, product, row_number() OVER (PARTITION BY brand, key ORDER BY count(*) DESC, product) AS nth FROM once GROUP BY brand, key, product) WHERE nth <= 5 GROUP BY 1, 2)
    SELECT brand, key, CASE WHEN starts_with(name, brand) THEN name ELSE brand || ' ' || name END AS name, CASE WHEN starts_with(name, brand) THEN trim(substr(name, length(brand) + 1)) ELSE name END AS theme, n, start, "end", offer, products, mark::VARCHAR AS mark
    FROM k JOIN called USING (brand, key) LEFT JOIN offers USING (brand, key) LEFT JOIN goods USING (brand, key)""")
def campaign_candidates(spark, sf_dir):
    """Campaigns proposed from items that share a signal: names, dates, offer and products in common; assigned items left out."""
    parts = _campaign_items(spark, sf_dir)
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_shipdate").alias("at"))
    items = parts.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("offer"), F.col("p_name").alias("product"), (F.col("p_size") == 13).alias("assigned")).join(sold, "id", "left")
    found = campaigns.candidates(campaigns.signals(parts, "p_partkey", "p_brand", F.col("said"), F.col("badges")), items)
    return found.select("brand", "key", "name", "theme", "n", "start", "end", "offer", F.array_join("products", "|").alias("products"), F.col("items_mark").cast("string").alias("mark"))


def _answers(spark, sf_dir):
    """Every document with its labels as a model would tell it, broken off at a place of its own."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    words = F.slice(F.split("text", r"\s+"), 1, 6)
    told = F.to_json(F.struct("doc_id", F.struct("lang", "source", words.alias("words"), F.struct("quality", "toxic").alias("labels")).alias("meta"), "n_chars", F.array("n_chars", "doc_id").alias("numbers"), F.col("text").alias("summary"), F.lit(True).alias("done")))
    whole = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("Here it is: ```json\n")).otherwise(F.lit("Sure. ")), told, F.when(F.col("doc_id") % 2 == 0, F.lit("\n```")).otherwise(F.lit("")))
    cut = F.pmod(F.xxhash64("doc_id"), F.length("whole")).cast("int") + 1
    # Every third answer is whole, but for a comma that is missing.
    broken = F.when(F.col("doc_id") % 3 == 0, F.replace("whole", F.lit(',"n_chars"'), F.lit('"n_chars"'))).otherwise(F.left("whole", cut))
    return docs.withColumn("whole", whole).select("doc_id", broken.alias("said"))


@registry.query()
def salvaged_json(spark, sf_dir):
    """What can be read of answers that break off: the object as valid JSON, and fields of it."""
    rows = _answers(spark, sf_dir).select("doc_id", salvage.salvaged_json(F.col("said")).alias("json"))
    return rows.select("doc_id", "json", *[salvage.without_placeholder(F.get_json_object("json", f"$.{path}")).alias(path.split(".")[-1]) for path in ("meta.lang", "meta.source", "n_chars", "done")])


@registry.query(r"""
    WITH l AS (SELECT page_id, 'https://l.example/?u=' || replace(replace(replace(replace(url, ':', '%3A'), '/', '%2F'), '?', '%3F'), '#', '%23') || '&h=x' AS link FROM pages)
    SELECT page_id, url_decode(regexp_extract(link, '[?&]u=([^&]*)', 1)) AS target, lower(regexp_extract(url_decode(regexp_extract(link, '[?&]u=([^&]*)', 1)), '^[A-Za-z]+://([^/?#]*)', 1)) AS host FROM l""")
def unwrapped_redirects(spark, sf_dir):
    """Where a provider's redirecting links lead to."""
    escaped = F.col("url")
    for mark, code in ((":", "%3A"), ("/", "%2F"), ("?", "%3F"), ("#", "%23")):
        escaped = F.replace(escaped, F.lit(mark), F.lit(code))
    links = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://l.example/?u="), escaped, F.lit("&h=x")).alias("link"))
    target = F.url_decode(F.parse_url("link", F.lit("QUERY"), F.lit("u")))
    return links.select("page_id", target.alias("target"), F.lower(F.regexp_extract(target, "^[A-Za-z]+://([^/?#]*)", 1)).alias("host"))
