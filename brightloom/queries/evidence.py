"""Evidence, crawl targets, normal forms and guards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brightloom.functions import vectors as V
from brightloom.operators import frontier
from brightloom.operators.fingerprints import word_hashes
from brightloom.plans.shared import Scratch
from brightloom.queries.registry import Registry, hashed_sql, table

registry = Registry()
#: The letters on a telephone keypad and their digits.
KEYPAD = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "22233344455566677778889999")


@registry.query("""
    WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[+]?1? ?[(][0-9]{3}[)] [0-9]{3}-[0-9]{4}')) AS raw FROM documents),
    d AS (SELECT doc_id, raw, regexp_replace(translate(upper(raw), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '22233344455566677778889999'), '[^0-9]', '', 'g') AS digits FROM p)
    SELECT doc_id, raw, CASE WHEN length(digits) = 10 THEN '+1' || digits WHEN length(digits) = 11 AND starts_with(digits, '1') THEN '+' || digits END AS e164 FROM d""")
def phone_keys(spark, sf_dir):
    """Phone numbers in their international form, letters read as a keypad's digits."""
    p = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[+]?1? ?[(][0-9]{3}[)] [0-9]{3}-[0-9]{4}"), F.lit(0))).alias("raw"))
    d = p.withColumn("digits", F.regexp_replace(F.translate(F.upper("raw"), *KEYPAD), "[^0-9]", ""))
    number = F.when(F.length("digits") == 10, F.concat(F.lit("+1"), "digits")).when((F.length("digits") == 11) & F.startswith("digits", F.lit("1")), F.concat(F.lit("+"), "digits"))
    return d.select("doc_id", "raw", number.alias("e164"))


@registry.query("""
    SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
           nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages""")
def url_parts(spark, sf_dir):
    """Host, path and two parameters of every address."""
    part = lambda what: F.coalesce(F.try_parse_url("url", F.lit(what)), F.lit(""))
    query = F.str_to_map(F.coalesce(F.try_parse_url("url", F.lit("QUERY")), F.lit("")), F.lit("&"), F.lit("="))
    return table(spark, sf_dir, "pages").select("page_id", part("HOST").alias("host"), part("PATH").alias("path"), query["page"].alias("page"), query["ref"].alias("ref"))


@registry.query("""
    SELECT 'customer' AS name, count(*) AS total, count(*) FILTER (c_acctbal > 0) AS active FROM customer UNION ALL SELECT 'supplier', count(*), count(*) FILTER (s_acctbal > 0) FROM supplier
    UNION ALL SELECT 'part', count(*), count(*) FILTER (p_size > 10) FROM part""")
def knowledge_stats(spark, sf_dir):
    """Rows and active rows of several tables."""
    parts = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("total"), F.count_if(c).alias("active")).select(F.lit(t).alias("name"), "total", "active") for t, c in (("customer", F.col("c_acctbal") > 0), ("supplier", F.col("s_acctbal") > 0), ("part", F.col("p_size") > 10))]
    return parts[0].union(parts[1]).union(parts[2])


@registry.query("""
    SELECT conv_id, 'joined' AS kind, string_agg(text, ' ' ORDER BY turn) AS text, round(avg(length(text)), 6) AS mean FROM conversations WHERE role = 'user' GROUP BY conv_id HAVING count(*) >= 2
    UNION ALL SELECT conv_id, 'turn', text, length(text)::DOUBLE FROM conversations WHERE role = 'assistant'""")
def evidence_assembly(spark, sf_dir):
    """Items of a frame joined where there are two or more, with the single rows of the other kind."""
    c = table(spark, sf_dir, "conversations")
    turns = F.sort_array(F.collect_list(F.struct("turn", "text")))
    joined = c.where("role = 'user'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(turns, lambda t: t["text"]), " ").alias("text"), F.round(F.avg(F.length("text")), 6).alias("mean"))
    single = c.where("role = 'assistant'").select("conv_id", F.lit("turn").alias("kind"), "text", F.length("text").cast("double").alias("mean"))
    return joined.where("n >= 2").select("conv_id", F.lit("joined").alias("kind"), "text", "mean").unionByName(single)


@registry.query("""
    WITH m AS (SELECT source, avg(n_chars) AS mean, min(n_chars) AS least, count(*) FILTER (n_chars <= 100) AS short, sum(n_chars) AS total FROM documents GROUP BY source)
    SELECT source, CASE WHEN mean < 1500 THEN 'low mean' WHEN least < 20 THEN 'low item' WHEN total > 150000 THEN 'dense' WHEN short >= 10 THEN 'fragments' ELSE 'skip' END AS reason FROM m""")
def parser_gating(spark, sf_dir):
    """Whether a second parser runs, and why: the first reason that holds."""
    m = table(spark, sf_dir, "documents").groupBy("source").agg(F.avg("n_chars").alias("mean"), F.min("n_chars").alias("least"), F.count_if(F.col("n_chars") <= 100).alias("short"), F.sum("n_chars").alias("total"))
    reason = F.when(F.col("mean") < 1500, F.lit("low mean")).when(F.col("least") < 20, F.lit("low item")).when(F.col("total") > 150000, F.lit("dense")).when(F.col("short") >= 10, F.lit("fragments")).otherwise(F.lit("skip"))
    return m.select("source", reason.alias("reason"))


@registry.query("""
    WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages),
    n AS (SELECT page_id, lower(regexp_replace(link, '/+$', '')) AS target, CASE WHEN starts_with(link, 'http') THEN 1 ELSE 0 END AS priority FROM l),
    r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY priority DESC, page_id) AS k FROM n WHERE target NOT IN (SELECT lower(regexp_replace(url, '/+$', '')) FROM pages))
    SELECT target, page_id AS found_on, priority::BIGINT AS priority FROM r WHERE k = 1""")
def crawl_targets(spark, sf_dir):
    """Links to follow: once each, best priority first, none that was crawled already."""
    pages = table(spark, sf_dir, "pages")
    normal = lambda c: F.lower(F.regexp_replace(c, "/+$", ""))
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))
    rows = links.select("page_id", normal("link").alias("target"), F.when(F.startswith("link", F.lit("http")), 1).otherwise(0).cast("long").alias("priority"))
    best = rows.groupBy("target").agg(F.min(F.struct((-F.col("priority")).alias("p"), "page_id")).alias("b"))
    done = pages.select(normal("url").alias("target"))
    return best.join(done, "target", "left_anti").select("target", F.col("b.page_id").alias("found_on"), (-F.col("b.p")).alias("priority"))


_TITLE = "regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[a-z]{{{0},}}')"
_ROUND = """t{1} AS (SELECT entity, target, min(priority) AS priority FROM (SELECT entity, l.target, l.priority FROM f{0} JOIN links l USING (page)) ANTI JOIN a{0} USING (entity, target) GROUP BY 1, 2),
    a{1} AS (SELECT entity, target FROM a{0} UNION SELECT entity, target FROM t{1}), r{1} AS (SELECT entity, page FROM r{0} UNION SELECT entity, page FROM f{0}),
    f{1} AS (SELECT entity, page, {1} AS depth, min(priority) AS priority, arg_min(target, (priority, target)) AS target FROM t{1} JOIN answers USING (target) ANTI JOIN r{1} USING (entity, page) GROUP BY 1, 2)"""


@registry.query(f"""
    WITH answers AS (SELECT DISTINCT page_id AS page, unnest({_TITLE.format(5)}) AS target FROM pages),
    links AS (SELECT page, target, min(priority) AS priority FROM (SELECT page_id AS page, unnest(regexp_extract_all(html, '<a href="/([A-Za-z]+)"', 1)) AS word, CASE WHEN url LIKE 'https%' THEN 1 ELSE 2 END AS priority FROM pages), LATERAL (SELECT lower(word) AS target) GROUP BY 1, 2),
    seen AS (SELECT item_id AS entity, item_id AS page FROM benchmark),
    a1 AS (SELECT entity, target, min(priority) AS priority FROM (SELECT item_id AS entity, unnest(w) AS target, CASE WHEN generate_subscripts(w, 1) <= 3 THEN 0 ELSE 3 END AS priority FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{{5,}}') AS w FROM benchmark)) GROUP BY 1, 2),
    r1 AS (SELECT * FROM seen), f1 AS (SELECT entity, page, 1 AS depth, min(priority) AS priority, arg_min(target, (priority, target)) AS target FROM a1 JOIN answers USING (target) ANTI JOIN r1 USING (entity, page) GROUP BY 1, 2),
    {_ROUND.format(1, 2)}, {_ROUND.format(2, 3)}, {_ROUND.format(3, 4)}
    SELECT entity, page, depth, priority, target FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f4""")
def crawl_rounds(spark, sf_dir):
    """Pages that four rounds reach for each item: words ask for pages by title, and the links of a page ask on."""
    pages = table(spark, sf_dir, "pages")
    title = F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    answers = pages.select(F.col("page_id").alias("page"), F.explode(F.regexp_extract_all(title, F.lit("[a-z]{5,}"), F.lit(0))).alias("target"))
    words = F.explode(F.regexp_extract_all("html", F.lit('<a href="/([A-Za-z]+)"'), F.lit(1)))
    links = pages.select(F.col("page_id").alias("page"), F.when(F.startswith("url", F.lit("https")), 1).otherwise(2).alias("priority"), words.alias("word")).select("page", F.lower("word").alias("target"), "priority")
    items = table(spark, sf_dir, "benchmark")
    asked = items.select(F.col("item_id").alias("entity"), F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("at", "target"))
    seeds = asked.select("entity", "target", F.when(F.col("at") < 3, 0).otherwise(3).alias("priority"))
    seen = items.select(F.col("item_id").alias("entity"), F.col("item_id").alias("page"))
    return frontier.crawl(seeds, answers, links, 4, seen)


@registry.query("""
    SELECT doc_id, instr(lower(text), 'worthless')::BIGINT AS at, substr(text, greatest(instr(lower(text), 'worthless') - 20, 1), 60) AS snippet FROM documents WHERE instr(lower(text), 'worthless') > 0""")
def mention_snippets(spark, sf_dir):
    """Where a name is first mentioned, with the text around it."""
    at = F.instr(F.lower("text"), "worthless")
    return table(spark, sf_dir, "documents").where(at > 0).select("doc_id", at.cast("long").alias("at"), F.substring("text", F.greatest(at - 20, F.lit(1)), F.lit(60)).alias("snippet"))


@registry.query("""
    WITH s AS (SELECT user_id, max(ts) AS last_ts, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN errors > 25 THEN 'circuit_open' WHEN last_ts < TIMESTAMP '2024-01-30' THEN 'stale' ELSE 'fresh' END AS guard FROM s""")
def freshness_guard(spark, sf_dir):
    """The first guard that stops a source's poll."""
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count_if(F.col("event_type") == "error").alias("errors"))
    guard = F.when(F.col("errors") > 25, F.lit("circuit_open")).when(F.col("last_ts") < F.lit("2024-01-30").cast("timestamp_ntz"), F.lit("stale")).otherwise(F.lit("fresh"))
    return s.select("user_id", guard.alias("guard"))


@registry.query(f"""
    WITH {hashed_sql(1, 'f')}, h AS (SELECT doc_id // 8 AS item, doc_id % 8 AS frame, hi, lo FROM f)
    SELECT a.item AS item, round(avg(CASE WHEN bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 24 THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM h a JOIN h b ON b.item = a.item + 1 AND a.frame = b.frame GROUP BY a.item""")
def frame_match_ratio(spark, sf_dir):
    """Share of frames in the same place of two neighbouring items that look alike; a frame is a document's hash."""
    h = word_hashes(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.expr("id div 8").alias("item"), (F.col("id") % 8).alias("frame"), "h")
    h = Scratch(spark, "frames").keep(h, "h")  # both sides are the same hashes
    other = h.select((F.col("item") - 1).alias("item"), "frame", F.col("h").alias("h2"))
    alike = F.when(V.hamming_hex(F.col("h"), F.col("h2")) <= 24, 1.0).otherwise(0.0)
    return h.join(other, ["item", "frame"]).groupBy("item").agg(F.round(F.avg(alike), 6).alias("ratio"))


@registry.query("""
    SELECT l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey) AS r FROM lineitem) WHERE r = 1""")
def dedupe_best(spark, sf_dir):
    """Of every key the row with the greatest score tuple."""
    best = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max(F.struct("l_quantity", "l_extendedprice")).alias("b"))
    return best.select("l_partkey", "l_suppkey", F.col("b.l_quantity").alias("l_quantity"), F.col("b.l_extendedprice").alias("l_extendedprice"))


@registry.query("SELECT p_partkey, '$' || format('{:,.2f}', p_retailprice) AS price FROM part")
def price_labels(spark, sf_dir):
    """Amounts as they are shown."""
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("$"), F.format_number("p_retailprice", 2)).alias("price"))


@registry.query("SELECT user_id, date_trunc('hour', ts) AS run, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def observation_log(spark, sf_dir):
    """One observation for each source and run."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("run")).agg(F.min("event_id").alias("event_id"))


@registry.query("""
    WITH s AS (SELECT user_id, event_type, '{"items":[{"text":"' || event_type || '","value":' || value || '},{"value":1}]}' AS body FROM events WHERE value > 90)
    SELECT user_id, string_agg(DISTINCT json_extract_string(body, '$.items[0].text'), ',' ORDER BY json_extract_string(body, '$.items[0].text')) AS texts, count(*) AS n FROM s GROUP BY user_id""")
def json_values(spark, sf_dir):
    """Texts out of a JSON list whose members may lack them."""
    body = F.concat(F.lit('{"items":[{"text":"'), "event_type", F.lit('","value":'), F.col("value").cast("string"), F.lit('},{"value":1}]}'))
    items = F.from_json(body, "struct<items:array<struct<text:string,value:double>>>")["items"]
    texts = F.filter(F.transform(items, lambda x: x["text"]), lambda t: t.isNotNull())
    rows = table(spark, sf_dir, "events").where("value > 90").select("user_id", texts.alias("t"))
    return rows.groupBy("user_id").agg(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("t")))), ",").alias("texts"), F.count(F.lit(1)).alias("n"))


@registry.query("""
    WITH c AS (SELECT o_custkey AS item, 'order' AS kind, o_orderpriority AS label, o_orderstatus AS state FROM orders UNION SELECT c_custkey, 'customer', c_mktsegment, '' FROM customer),
    r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY kind, label, state) AS k FROM c)
    SELECT item, kind, label, state FROM r WHERE k <= 12""")
def citations(spark, sf_dir):
    """Distinct citations of every item, at most twelve."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), F.lit("order").alias("kind"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("state"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("label"), F.lit("").alias("state"))
    w = Window.partitionBy("item").orderBy("kind", "label", "state")
    return a.union(b).distinct().withColumn("k", F.row_number().over(w)).where("k <= 12").drop("k")
