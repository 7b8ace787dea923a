"""Rules, labels and knowledge folded into decisions; entities of two origins as one."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightloom.functions import merging as M
from brightloom.operators import decide, entities
from brightloom.queries.registry import Registry, table

registry = Registry()

#: Rules over lines: name, pattern, severity, risk.
LINE_RULES = [
    ("secret", r"(?i)(password|passwd|secret|token|api_?key)\S*\s*[:=]", "high", "credentials"),
    ("account", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", "high", "financial"),
    ("contact", r"@[a-z0-9-]+\.|\+[0-9]", "medium", "personal"),
    ("license", r"(?i)licen[cs]e|copyright", "low", "legal"),
    ("number", r"[0-9]{3,}", "low", None),
]
#: What is known: priority, rule, the risk or label that it is for, field, value.
KNOWLEDGE = [
    (10, "leaks", "credentials", "category", "leak"), (20, "money", "financial", "category", "finance"), (20, "money", "financial", "review", "yes"), (30, "people", "personal", "review", "yes"),
    (40, "terms", "legal", "category", "legal"), (5, "toxic", "toxic", "review", "yes"), (50, "poor", "poor", "category", "junk"), (60, "people", "personal", "audience", "some"),
]
SENSITIVE = ("leak", "finance")


def line_triggers(spark, sf_dir):
    """``doc_id, position, rule_no, rule, severity, risk, line`` of every line that a rule finds, by rule and line."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    rules = F.array(*[F.when(F.regexp_like("line", F.lit(p)), F.struct(F.lit(i).alias("rule_no"), F.lit(name).alias("rule"), F.lit(s).alias("severity"), F.lit(risk).alias("risk"))) for i, (name, p, s, risk) in enumerate(LINE_RULES)])
    found = lines.select("doc_id", "n", "line", F.explode(F.array_compact(rules)).alias("r")).select("doc_id", "n", "line", "r.*")
    return found.withColumn("position", F.col("rule_no").cast("long") * (1 << 32) + F.col("n"))


def _evidence(spark, sf_dir):
    triggers = line_triggers(spark, sf_dir)
    key = F.regexp_replace(F.lower("line"), "[^a-z0-9]+", "")
    text = F.trim(F.regexp_replace("line", r"\s+", " "))
    blanks = lambda c, what: F.length(c) - F.length(F.replace(c, F.lit(what)))
    score = F.length(text) + 2 * blanks(text, " ") + 3 * F.floor(blanks(text, ". ") / 2)
    return decide.first_seen(triggers, "doc_id", "position", key, score, text)


@registry.query()
def rule_evidence(spark, sf_dir):
    """What stands for the lines that rules found in each document, first sight first, the fullest text of each."""
    return _evidence(spark, sf_dir).select("doc_id", "place", "key", "text", "rows")


@registry.query()
def final_classification(spark, sf_dir):
    """Labels, rules and knowledge as one decision a document, with its risks, evidence and the rules that applied."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    triggers = line_triggers(spark, sf_dir)
    risks = decide.in_first_order(triggers, "doc_id", ["rule_no", "n"], "risk")
    base = docs.join(risks, "doc_id", "left").select("doc_id", "quality", "toxic", "labels", F.coalesce("source", F.lit("other")).alias("category"), F.when(F.col("toxic") == 1, F.lit("yes")).otherwise(F.lit("no")).alias("review"), F.lit("all").alias("audience"))
    base = base.withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))
    signs = F.concat("labels", F.array_compact(F.array(F.when(F.col("toxic") == 1, F.lit("toxic")), F.when(F.col("quality") == 0, F.lit("poor")))))
    known = spark.createDataFrame(KNOWLEDGE, "priority int, rule string, sign string, field string, value string")
    changes = base.select(F.col("doc_id").alias("id"), F.explode(signs).alias("sign")).join(F.broadcast(known), "sign")  # a fixed short table
    decided = decide.overridden(base, "doc_id", ["category", "review", "audience"], changes)
    shown = _evidence(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("evidence"), F.max_by("text", F.struct("score", -F.col("place"))).alias("shown"))
    rows = decided.join(shown, "doc_id", "left")
    return rows.select(
        "doc_id", "category", "review", "audience", F.array_join("labels", ",").alias("risks"), F.array_join("applied", ",").alias("applied"), F.col("category").isin(*SENSITIVE).alias("sensitive"),
        F.coalesce("evidence", F.lit(0)).alias("evidence"), "shown",
    )


_TOK = "list_filter(string_split_regex(lower({0}), '[ \\t\\n\\r]+'), lambda w: w <> '')"


@registry.query(f"""
    WITH own AS (SELECT o_orderkey AS id, o_orderpriority AS density, list(CASE WHEN l_linenumber % 2 = 1 THEN p_name ELSE p_name || ' ' || p_type END ORDER BY l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN p_name ELSE p_name || ' ' || p_type END) FILTER (l_linenumber <= 2 AND o_orderkey % 3 > 0) AS offers FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
    other AS (SELECT l_orderkey AS id, list(p_name || ' ' || p_type || ' ' || p_brand ORDER BY l_linenumber, p_name || ' ' || p_type || ' ' || p_brand) AS offers, max(l_quantity) AS q, max(l_shipdate) AS ends, min(l_discount) FILTER (l_discount > 0.02) AS apr FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
    j AS (SELECT id, own.offers AS a, other.offers AS b, density, q, ends, apr FROM own JOIN other USING (id)),
    u AS (SELECT *, CASE WHEN a IS NULL THEN b ELSE list_transform(a, lambda x: coalesce(list_filter(b, lambda y: length(y) > length(x) AND list_has_all({_TOK.format('y')}, {_TOK.format('x')}))[1], x)) END AS offers FROM j),
    k AS (SELECT *, list_transform(offers, lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')) AS keys FROM u)
    SELECT id, array_to_string(list_transform(list_filter(range(1, len(offers) + 1), lambda i: list_position(keys, keys[i]) = i), lambda i: offers[i]), '|') AS offers,
           CASE WHEN density = '1-URGENT' OR q > 45 THEN 'high' WHEN density = '3-MEDIUM' OR q > 25 THEN 'medium' WHEN density = '5-LOW' THEN 'low' ELSE 'none' END AS density,
           CASE WHEN id % 2 = 0 THEN 'own' ELSE 'other' END AS financing, CASE WHEN id % 2 = 0 AND id % 4 = 0 THEN 0.01 ELSE apr END AS apr FROM k""")
def merged_entities(spark, sf_dir):
    """What one side tells of an order's parts, filled up and upgraded with what the other side tells: offers, density, terms."""
    orders, lines, part = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    listed = lambda x: F.transform(F.sort_array(F.collect_list(x)), lambda y: y["t"])  # noqa: E731  (an order's lines)
    first = F.when((F.col("l_linenumber") <= 2) & (F.col("l_orderkey") % 3 > 0), F.struct("l_linenumber", F.when(F.col("l_linenumber") % 2 == 1, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_type")).alias("t")))
    sides = rows.groupBy("l_orderkey").agg(
        listed(first).alias("a"), listed(F.struct("l_linenumber", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("t"))).alias("b"), F.max("l_quantity").alias("q"), F.min(F.when(F.col("l_discount") > 0.02, F.col("l_discount"))).alias("apr"),
    )
    rows = orders.join(sides, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("key", F.col("o_orderkey"))
    stated = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("none")
    seen = F.when(F.col("q") > 45, "high").when(F.col("q") > 25, "medium").otherwise("none")
    own = F.struct(F.when(F.col("key") % 2 == 0, F.lit("own")).alias("text"), F.when(F.col("key") % 4 == 0, F.lit(0.01)).alias("apr"))
    other = F.struct(F.lit("other").alias("text"), F.col("apr").alias("apr"))
    rows = rows.select("key", "a", "b", stated.alias("stated"), seen.alias("seen"), M.filled_struct(own, other, "text", ["apr"]).alias("f")).withColumn("offers", M.upgraded_list(F.col("a"), F.col("b")))
    return rows.select(F.col("key").alias("id"), F.array_join(M.once_by_key(F.col("offers")), "|").alias("offers"), M.denser(F.col("stated"), F.col("seen")).alias("density"), F.col("f.text").alias("financing"), F.col("f.apr").alias("apr"))


@registry.query("""
    WITH r AS (SELECT o_orderkey AS id, o_orderkey % 5 = 0 AS cut, o_orderstatus, o_totalprice, o_custkey % 60 AS months, o_orderpriority, c_name, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Builders Inc.' ELSE upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) END AS brand,
           CASE WHEN o_orderstatus <> 'F' THEN 'Deal ' || o_orderpriority END AS promotion,
           CASE WHEN id % 2 = 0 THEN '$' ELSE 'CHF ' END || format('{:,.2f}', o_totalprice) AS prices,
           CASE WHEN id % 3 = 0 THEN c_mktsegment ELSE 'save on ' || c_name END || CASE WHEN NOT cut THEN '|€' || format('{:,.2f}', o_totalprice / 10) || '/mo' || CASE WHEN months > 0 THEN ' ' || months || '-mo' ELSE '' END || CASE WHEN id % 4 > 0 THEN ' ' || (id % 4) || '.5% APR' ELSE '' END ELSE '' END AS offers,
           CASE WHEN cut THEN 0 ELSE 1 END AS evidence FROM r""")
def mapped_entities(spark, sf_dir):
    """Answers about orders read into brand, promotion, prices and offers; every fifth answer breaks off before its terms."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    # Reading an answer costs much more than its row, so orders are dealt out evenly, however few splits their files have.
    rows = orders.repartition("o_orderkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    prices = F.array(F.struct(F.when(key % 2 == 0, "usd").otherwise("CHF").alias("currency"), price.alias("amount")), F.struct(F.lit("USD").alias("currency"), F.lit(0.0).alias("amount")))
    offers = F.array(F.struct(F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("save on "), "c_name")).alias("value"), F.col("c_mktsegment").alias("type")))
    front = F.to_json(F.struct(F.struct(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("®")).alias("name")).alias("brand"), F.when(F.col("o_orderstatus") == "F", "n/a").otherwise(F.concat(F.lit("Deal   "), "o_orderpriority")).alias("promotion"), prices.alias("prices"), offers.alias("offers")))
    terms = F.struct(F.lit("EUR").alias("currency"), (price / 10).alias("monthly"), (F.col("o_custkey") % 60).cast("int").alias("months"), F.when(key % 4 > 0, key % 4 + 0.5).alias("apr"))
    back = F.to_json(F.struct(terms.alias("financing"), F.array(F.struct(F.lit(" ").alias("text"), F.col("o_orderpriority").alias("reason")), F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("reason"))).alias("evidence")))
    whole = F.concat(F.left(front, F.length(front) - 1), F.lit(","), F.substr(back, F.lit(2)))
    said = F.when(key % 5 == 0, F.left(whole, F.length(front) + 8)).otherwise(whole)
    aliases = spark.createDataFrame([("building", "Builders Inc.")], "name string, brand string")
    found = entities.mapped(rows.select(key.alias("id"), said.alias("said")), "id", "said", aliases)
    return found.select("id", "brand", "promotion", F.array_join("prices", "|").alias("prices"), F.array_join("offers", "|").alias("offers"), F.size("evidence").alias("evidence"))
