"""Taxonomy, knowledge rules and the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightloom.functions import text as X
from brightloom.functions.identity import digest_id
from brightloom.operators import merge as M
from brightloom.operators import variants
from brightloom.queries.registry import Registry, table

registry = Registry()


def _tree(spark, sf_dir):
    """Regions, nations and segments as one adjacency list."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    low = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    return top.unionByName(low)


_TREE = "tree AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation)"


@registry.query(f"""WITH RECURSIVE {_TREE}, up(id, above, path, depth) AS (SELECT id, parent, name, 1 FROM tree UNION ALL SELECT up.id, t.parent, t.name || ' > ' || path, depth + 1 FROM up JOIN tree t ON t.id = up.above WHERE depth < 6)
    SELECT id, path, depth::BIGINT AS depth FROM up WHERE above IS NULL""")
def taxonomy_ancestors(spark, sf_dir):
    """Every node's path from its root; a level a join, up to six levels."""
    tree = _tree(spark, sf_dir)
    up = tree.select("id", F.col("parent").alias("at"), F.col("name").alias("path"), F.lit(1).cast("long").alias("depth"))
    above = tree.select(F.col("id").alias("at"), F.col("parent").alias("next"), F.col("name").alias("above"))
    for _ in range(3):
        joined = up.join(above, "at", "left")
        grown = F.when(F.col("above").isNotNull(), F.concat("above", F.lit(" > "), "path")).otherwise(F.col("path"))
        up = joined.select("id", F.col("next").alias("at"), grown.alias("path"), (F.col("depth") + F.col("above").isNotNull().cast("long")).alias("depth"))
    return up.select("id", "path", "depth")


@registry.query("""
    WITH rules AS (SELECT c_nationkey, c_mktsegment AS expected, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2)
    SELECT c_custkey, c_mktsegment, expected FROM customer JOIN rules USING (c_nationkey) WHERE r = 1 AND c_mktsegment IS DISTINCT FROM expected""")
def taxonomy_backfill(spark, sf_dir):
    """Rows that disagree with the rule of their group."""
    customer = table(spark, sf_dir, "customer")
    counts = customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    rules = counts.groupBy("c_nationkey").agg(F.min_by("c_mktsegment", F.struct(-F.col("n"), "c_mktsegment")).alias("expected"))
    rows = customer.join(rules, "c_nationkey")
    return rows.where(~F.col("c_mktsegment").eqNullSafe(F.col("expected"))).select("c_custkey", "c_mktsegment", "expected")


#: Overrides by priority: condition column, value, field set, value set.
OVERRIDES = [(10, "c_mktsegment", "MACHINERY", "tier", "A"), (8, "c_mktsegment", "HOUSEHOLD", "tier", "B"), (5, "c_nationkey", "3", "tier", "C"), (4, "c_nationkey", "3", "region", "X"), (1, "c_nationkey", "4", "region", "Y")]


@registry.query("""
    WITH o(priority, col, val, field, setto) AS (VALUES (10, 'c_mktsegment', 'MACHINERY', 'tier', 'A'), (8, 'c_mktsegment', 'HOUSEHOLD', 'tier', 'B'), (5, 'c_nationkey', '3', 'tier', 'C'), (4, 'c_nationkey', '3', 'region', 'X'), (1, 'c_nationkey', '4', 'region', 'Y')),
    m AS (SELECT c_custkey, field, setto, row_number() OVER (PARTITION BY c_custkey, field ORDER BY priority DESC) AS r FROM customer, o WHERE CASE col WHEN 'c_mktsegment' THEN c_mktsegment = val ELSE c_nationkey::VARCHAR = val END)
    SELECT c_custkey, max(setto) FILTER (field = 'tier') AS tier, max(setto) FILTER (field = 'region') AS region FROM m WHERE r = 1 GROUP BY c_custkey""")
def override_first_match(spark, sf_dir):
    """For each field the value of the first override that matches, by priority."""
    rows = table(spark, sf_dir, "customer")
    fields = {f: F.coalesce(*[F.when(F.col(c).cast("string") == v, F.lit(to)) for _, c, v, g, to in sorted(OVERRIDES, reverse=True) if g == f]) for f in ("tier", "region")}
    return rows.select("c_custkey", *[e.alias(f) for f, e in fields.items()]).where("tier IS NOT NULL OR region IS NOT NULL")


@registry.query("""
    WITH b AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS blob FROM documents),
    r(target, terms, context) AS (VALUES ('abuse', ['idiot', 'worthless', 'clown'], []), ('legal', ['license', 'copyright'], ['rights', 'permission', 'the']), ('secrets', ['token', 'password'], [])),
    m AS (SELECT doc_id, target, len(list_filter(terms, lambda t: contains(blob, ' ' || t || ' ')))::BIGINT AS hits FROM b, r WHERE (len(context) = 0 OR len(list_filter(context, lambda t: contains(blob, ' ' || t || ' '))) > 0))
    SELECT * FROM m WHERE hits > 0""")
def inference_rules_match(spark, sf_dir):
    """Targets whose terms stand in a text as whole words, with one of their context words where they need one."""
    rules = [("abuse", ["idiot", "worthless", "clown"], []), ("legal", ["license", "copyright"], ["rights", "permission", "the"]), ("secrets", ["token", "password"], [])]
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(" "), X.normalize_name(F.col("text")), F.lit(" ")).alias("blob"))

    def has(word):
        return F.when(F.contains("blob", F.lit(f" {word} ")), 1).otherwise(0)

    found = F.array(*[F.struct(F.lit(t).alias("target"), F.when(sum(map(has, context)) > 0 if context else F.lit(True), sum(map(has, terms))).otherwise(0).cast("long").alias("hits")) for t, terms, context in rules])
    return rows.select("doc_id", F.inline(F.filter(found, lambda x: x["hits"] > 0)))


def _products(spark, sf_dir):
    """Products with their brand as observations of an entity graph."""
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    seen = lines.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))
    rows = part.join(seen, part["p_partkey"] == seen["l_partkey"])
    return rows.select("p_brand", "p_name", "p_type", "n", "suppliers", F.least(F.lit(1.0), F.lit(0.5) + F.col("n") / 100).alias("confidence"))


_SEEN = "seen AS (SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1), obs AS (SELECT p_brand, p_name, p_type, n, suppliers, least(1.0, 0.5 + n / 100) AS confidence FROM part JOIN seen ON l_partkey = p_partkey)"


@registry.query(f"""WITH {_SEEN}, nodes AS (SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS normal, max(confidence) AS confidence, count(*) AS observations, sum(n)::BIGINT AS mentions FROM obs GROUP BY 1)
    SELECT 'node_' || substr(sha1('product' || chr(31) || normal), 1, 20) AS node_id, normal, confidence, observations, mentions, CASE WHEN confidence >= 0.88 THEN 'approved' WHEN confidence >= 0.78 THEN 'needs_review' ELSE 'candidate' END AS status FROM nodes""")
def entity_resolution(spark, sf_dir):
    """Observations of products folded into nodes with a deterministic id and a status."""
    rows = _products(spark, sf_dir).withColumn("normal", X.normalize_name(F.col("p_name")))
    nodes = rows.groupBy("normal").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("observations"), F.sum("n").alias("mentions"))
    status = F.when(F.col("confidence") >= 0.88, F.lit("approved")).when(F.col("confidence") >= 0.78, F.lit("needs_review")).otherwise(F.lit("candidate"))
    return nodes.select(digest_id("node_", F.lit("product"), F.col("normal")).alias("node_id"), "normal", "confidence", "observations", "mentions", status.alias("status"))


@registry.query("""
    WITH old AS (SELECT p_partkey AS k, p_name AS name, p_size::DOUBLE / 100 AS confidence, CASE WHEN p_size % 7 = 0 THEN 'rejected' ELSE 'candidate' END AS status FROM part WHERE p_partkey % 2 = 0),
    new AS (SELECT p_partkey AS k, upper(p_name) AS name, p_retailprice / 3000 AS confidence, 'approved' AS status FROM part WHERE p_partkey % 3 = 0)
    SELECT coalesce(n.k, o.k) AS k, coalesce(n.name, o.name) AS name, greatest(o.confidence, n.confidence) AS confidence, CASE WHEN o.status = 'rejected' THEN 'rejected' ELSE coalesce(n.status, o.status) END AS status
    FROM old o FULL JOIN new n ON n.k = o.k""")
def entity_merge_upsert(spark, sf_dir):
    """An upsert with a rule for each column: new name, greatest confidence, rejected stays."""
    part = table(spark, sf_dir, "part")
    old = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), (F.col("p_size").cast("double") / 100).alias("confidence"), F.when(F.col("p_size") % 7 == 0, F.lit("rejected")).otherwise(F.lit("candidate")).alias("status"))
    new = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("k"), F.upper("p_name").alias("name"), (F.col("p_retailprice") / 3000).alias("confidence"), F.lit("approved").alias("status"))
    return M.merge_into(old, new, ["k"], {"name": "coalesce_new", "confidence": "max", "status": "status"})


@registry.query(f"""WITH {_SEEN} SELECT p_brand, count(*) AS products, count(DISTINCT p_type) AS types, count(DISTINCT p_name || '|' || p_type) AS variants, sum(n)::BIGINT AS mentions, count(*) FILTER (suppliers > 3) AS well_supplied FROM obs GROUP BY p_brand""")
def product_summary(spark, sf_dir):
    """Several counts of each brand in one aggregation."""
    return _products(spark, sf_dir).groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("products"), F.count_distinct("p_type").alias("types"), F.count_distinct(F.concat("p_name", F.lit("|"), "p_type")).alias("variants"),
        F.sum("n").alias("mentions"), F.count_if(F.col("suppliers") > 3).alias("well_supplied"),
    )


@registry.query("""
    WITH nodes AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0), parts AS (SELECT p_partkey FROM part WHERE p_size > 25)
    SELECT l_suppkey, l_partkey, count(*) AS weight FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM nodes) AND l_partkey IN (SELECT p_partkey FROM parts) GROUP BY 1, 2""")
def graph_induced_edges(spark, sf_dir):
    """Edges whose two ends are both in a set of nodes."""
    nodes = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    parts = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    edges = table(spark, sf_dir, "lineitem").join(nodes, "l_suppkey", "left_semi").join(parts, "l_partkey", "left_semi")
    return edges.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("weight"))


@registry.query("""
    SELECT l_partkey, l_suppkey AS best_supplier, weight FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS weight, row_number() OVER (PARTITION BY l_partkey ORDER BY sum(l_quantity) DESC, l_suppkey) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1""")
def relation_best(spark, sf_dir):
    """The strongest relation of every node."""
    edges = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("weight"))
    best = edges.groupBy("l_partkey").agg(F.min(F.struct((-F.col("weight")).alias("w"), "l_suppkey")).alias("b"))
    return best.select("l_partkey", F.col("b.l_suppkey").alias("best_supplier"), (-F.col("b.w")).alias("weight"))


@registry.query("""
    WITH best AS (SELECT l_partkey, l_suppkey FROM (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY sum(l_quantity) DESC, l_suppkey) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1)
    SELECT p_partkey, p_brand, s_name AS maker, n_name AS owner FROM part JOIN best ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""")
def two_hop_context(spark, sf_dir):
    """A product's context along two relations: its maker and the maker's owner."""
    best = relation_best(spark, sf_dir)
    part, supplier, nation = (table(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    rows = part.join(best, part["p_partkey"] == best["l_partkey"]).join(supplier, F.col("best_supplier") == supplier["s_suppkey"]).join(nation, F.col("s_nationkey") == nation["n_nationkey"])
    return rows.select("p_partkey", "p_brand", F.col("s_name").alias("maker"), F.col("n_name").alias("owner"))


@registry.query("""
    WITH seed AS (SELECT DISTINCT lower(p_brand) AS k FROM part WHERE p_size < 10), graph AS (SELECT DISTINCT lower(p_brand) AS k FROM part WHERE p_size > 45)
    SELECT coalesce(s.k, g.k) AS brand, CASE WHEN s.k IS NULL THEN 'graph' WHEN g.k IS NULL THEN 'seed' ELSE 'both' END AS origin FROM seed s FULL JOIN graph g ON s.k = g.k""")
def watchlist_merge(spark, sf_dir):
    """Two lists of names merged by key, with where each name comes from."""
    part = table(spark, sf_dir, "part").withColumn("brand", F.lower("p_brand"))
    sides = part.groupBy("brand").agg(F.bool_or(F.col("p_size") < 10).alias("seed"), F.bool_or(F.col("p_size") > 45).alias("graph")).where("seed OR graph")
    return sides.select("brand", F.when(~F.col("seed"), F.lit("graph")).when(~F.col("graph"), F.lit("seed")).otherwise(F.lit("both")).alias("origin"))


@registry.query("""
    WITH n AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS variant FROM part UNION SELECT DISTINCT p_name FROM part),
    j AS (SELECT a.variant, b.variant AS base, row_number() OVER (PARTITION BY a.variant ORDER BY length(b.variant) DESC, b.variant) AS r FROM n a JOIN n b ON starts_with(a.variant, b.variant || ' '))
    SELECT variant, base FROM j WHERE r = 1""")
def variant_collapse(spark, sf_dir):
    """Every variant with the longest other name that begins it; names meet on their first word."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("variant")).union(part.select("p_name")).distinct().withColumn("first", F.split("variant", " ")[0])
    a, b = names.alias("a"), names.alias("b")
    pairs = a.join(b, (F.col("a.first") == F.col("b.first")) & F.startswith(F.col("a.variant"), F.concat(F.col("b.variant"), F.lit(" "))))
    best = pairs.groupBy("a.variant").agg(F.max_by("b.variant", F.struct(F.length("b.variant"), "b.variant")).alias("base"))
    return best.select("variant", "base")


_SPELLED = "string_agg('(?:' || t || CASE WHEN length(t) >= 2 THEN '|' || array_to_string(list_transform(string_split(t, ''), lambda c: c || '[a-z0-9]*'), ' ') ELSE '' END || ')', '(?: [a-z0-9 ]*)? ' ORDER BY i)"


@registry.query(rf"""
    WITH o AS (SELECT p_name || ' ' || lower(p_type) AS name FROM part UNION SELECT p_name FROM part UNION SELECT left(p_name, 1) || left(string_split(p_name, ' ')[2], 1) || ' ' || lower(p_type) FROM part),
    b AS (SELECT name, '(?:^| )' || {_SPELLED} || '(?: |$)' AS found FROM (SELECT name, unnest(string_split(name, ' ')) AS t, generate_subscripts(string_split(name, ' '), 1) AS i FROM o WHERE length(replace(name, ' ', '')) >= 4) GROUP BY name),
    j AS (SELECT o.name, b.name AS base FROM o JOIN b ON length(b.name) < length(o.name) AND len(string_split(b.name, ' ')) < len(string_split(o.name, ' ')) AND regexp_matches(o.name, b.found))
    SELECT name, base FROM j QUALIFY row_number() OVER (PARTITION BY name ORDER BY length(base) DESC, base) = 1""")
def variant_bases(spark, sf_dir):
    """Every name with its longest base, whose words it has in order, spelled out or as initials."""
    part = table(spark, sf_dir, "part")
    kind = F.lower("p_type")
    short = F.concat(F.left("p_name", F.lit(1)), F.left(F.split("p_name", " ")[1], F.lit(1)))
    names = part.select(F.explode(F.array(F.concat_ws(" ", "p_name", kind), F.col("p_name"), F.concat_ws(" ", short, kind))).alias("name"))
    return variants.base_names(names)


@registry.query("""
    WITH e AS (SELECT o_custkey AS node, o_orderkey AS id, 'order' AS kind FROM orders WHERE o_totalprice > 400000 UNION SELECT l_suppkey, l_orderkey, 'line' FROM lineitem WHERE l_quantity >= 50)
    SELECT node, count(*) AS sources FROM e WHERE node < 50 GROUP BY node""")
def provenance_trace(spark, sf_dir):
    """Sources that mention a node on either side, as a union instead of an OR-join."""
    a = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"))
    b = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_suppkey").alias("node"), F.col("l_orderkey").alias("id"), F.lit("line").alias("kind"))
    return a.union(b).where("node < 50").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("sources"))


@registry.query("""
    WITH l AS (SELECT o_custkey, o_orderpriority AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
    SELECT o_custkey, value AS learned, 5::BIGINT AS priority, 0.9::DOUBLE AS confidence FROM l WHERE r = 1""")
def learned_rules(spark, sf_dir):
    """The last correction of every key as a rule."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("learned"))
    return last.select("o_custkey", "learned", F.lit(5).cast("long").alias("priority"), F.lit(0.9).alias("confidence"))


@registry.query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN upper(c_name) ELSE c_name END AS c_name, c_acctbal FROM customer""")
def sparse_patch(spark, sf_dir):
    """A table with sparse changes applied."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    changes = rows.where("c_acctbal < 0").select("c_custkey", F.upper("c_name").alias("c_name"))
    return M.patch(rows, changes, "c_custkey")
