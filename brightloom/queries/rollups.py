"""Rollups over customers' orders as campaigns and lines as their members."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brightloom.functions import text as X
from brightloom.queries.registry import Registry, table

registry = Registry()
#: Standard running times in seconds.
RUNTIMES = [6, 10, 15, 20, 30, 45, 60, 90]


@registry.query("""
    SELECT c_custkey, c_name, count(o_orderkey) AS n, round(avg(o_totalprice), 6) AS mean, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""")
def campaign_rollup(spark, sf_dir):
    """Number, mean and range of each parent's children, parents without any included."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    # Children are summed up before the join, so a busy parent sends one row for each task.
    own = orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.avg("o_totalprice").alias("mean"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"))
    rows = customer.join(own, customer["c_custkey"] == own["o_custkey"], "left")
    return rows.select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n"), F.round("mean", 6).alias("mean"), "first_date", "last_date")


@registry.query("""
    SELECT l_orderkey, l_linenumber, o_orderstatus, c_name, p_name FROM lineitem
    LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = l_partkey
    WHERE l_quantity >= 49""")
def campaign_detail(spark, sf_dir):
    """Members with their parents' columns through a chain of left joins."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 49")
    orders, customer, part = (table(spark, sf_dir, t) for t in ("orders", "customer", "part"))
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"], "left").join(customer, F.col("o_custkey") == customer["c_custkey"], "left")
    return rows.join(part, F.col("l_partkey") == part["p_partkey"], "left").select("l_orderkey", "l_linenumber", "o_orderstatus", "c_name", "p_name")


@registry.query("""
    SELECT p_brand, n, round(n / total, 3) AS share FROM (SELECT p_brand, count(*) AS n, sum(count(*)) OVER () AS total FROM part GROUP BY p_brand)
    ORDER BY n DESC, p_brand LIMIT 8""")
def top_counts_share(spark, sf_dir):
    """The most common values with their share of all."""
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    rows = counts.crossJoin(F.broadcast(total)).select("p_brand", "n", F.round(F.col("n") / F.col("total"), 3).alias("share"))  # one row
    return rows.orderBy(F.col("n").desc(), "p_brand").limit(8)


_BUCKET = "list_sort(list_transform([6, 10, 15, 20, 30, 45, 60, 90], lambda s: {'d': abs(p_size * 2 - s), 's': s}))[1]"


@registry.query(f"""
    WITH b AS (SELECT p_partkey, {_BUCKET} AS best FROM part)
    SELECT CASE WHEN best.d <= 2 THEN best.s || 's' ELSE 'other' END AS bucket, count(*) AS n FROM b GROUP BY 1""")
def runtime_buckets(spark, sf_dir):
    """A histogram over the nearest standard running time, within two seconds."""
    seconds = F.col("p_size") * 2
    best = F.array_min(F.transform(F.array(*[F.lit(s) for s in RUNTIMES]), lambda s: F.struct(F.abs(seconds - s).alias("d"), s.alias("s"))))
    bucket = F.when(F.col("best.d") <= 2, F.concat(F.col("best.s").cast("string"), F.lit("s"))).otherwise(F.lit("other"))
    return table(spark, sf_dir, "part").select(best.alias("best")).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@registry.query("""
    WITH v AS (SELECT regexp_replace(p_name, '^[a-z]+ ', '') AS family, p_name, p_type, l_orderkey, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey),
    f AS (SELECT family, count(*) AS mentions, count(DISTINCT l_orderkey) AS orders FROM v GROUP BY family),
    d AS (SELECT family, sum(q) AS amount FROM (SELECT family, l_orderkey, max(l_quantity) AS q FROM v GROUP BY 1, 2) GROUP BY family),
    n AS (SELECT family, string_agg(p_name || ':' || c, ',' ORDER BY c DESC, p_name) AS variants FROM (SELECT family, p_name, count(*) AS c FROM v GROUP BY 1, 2) GROUP BY family)
    SELECT family, mentions, orders, amount, variants FROM f JOIN d USING (family) JOIN n USING (family)""")
def product_families(spark, sf_dir):
    """Families of products: mentions, distinct orders, an amount counted once an order, and variants."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    v = lines.join(part, lines["l_partkey"] == part["p_partkey"]).select(F.regexp_replace("p_name", "^[a-z]+ ", "").alias("family"), "p_name", "l_orderkey", "l_quantity")
    # An order counts once: (family, order) first, then the family.
    once = v.groupBy("family", "l_orderkey").agg(F.max("l_quantity").alias("q"), F.count(F.lit(1)).alias("m"))
    totals = once.groupBy("family").agg(F.sum("m").alias("mentions"), F.count(F.lit(1)).alias("orders"), F.sum("q").alias("amount"))
    names = v.groupBy("family", "p_name").agg(F.count(F.lit(1)).alias("c"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "p_name")))
    variants = names.groupBy("family").agg(F.array_join(F.transform(listed, lambda x: F.concat(x["p_name"], F.lit(":"), (-x["c"]).cast("string"))), ",").alias("variants"))
    return totals.join(variants, "family").select("family", "mentions", "orders", "amount", "variants")


@registry.query("""
    SELECT event_type, count(*) FILTER (value > 50) AS strong, count(*) FILTER (value <= 50) AS weak, max(ts) AS last_ts, min(CASE WHEN value > 50 THEN ts END) AS first_strong,
           count(DISTINCT user_id) AS users, array_to_string(list_sort(list_distinct(list(user_id % 3))), ',') AS kinds FROM events GROUP BY event_type""")
def brand_overview(spark, sf_dir):
    """Flag sums, latest times and distinct members of each group in one pass."""
    kinds = F.array_join(F.transform(F.sort_array(F.collect_set(F.col("user_id") % 3)), lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count_if(F.col("value") > 50).alias("strong"), F.count_if(F.col("value") <= 50).alias("weak"), F.max("ts").alias("last_ts"),
        F.min(F.when(F.col("value") > 50, F.col("ts"))).alias("first_strong"), F.count_distinct("user_id").alias("users"), kinds.alias("kinds"),
    )


@registry.query("""
    SELECT count(*) FILTER (o_orderstatus = 'O') AS queued, count(*) FILTER (o_orderstatus = 'P') AS running, count(*) FILTER (o_orderstatus = 'F') AS done,
           min(CASE WHEN o_orderstatus = 'O' THEN o_orderdate END) AS oldest_queued FROM orders""")
def queue_stats(spark, sf_dir):
    """States of a queue and its oldest waiting entry."""
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").agg(
        F.count_if(s == "O").alias("queued"), F.count_if(s == "P").alias("running"), F.count_if(s == "F").alias("done"), F.min(F.when(s == "O", F.col("o_orderdate"))).alias("oldest_queued")
    )


@registry.query("""
    SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'failed' WHEN bool_or(o_orderstatus IN ('F', 'P')) THEN 'degraded' ELSE 'ok' END AS health,
           count(*) AS runs FROM orders GROUP BY o_custkey""")
def run_health(spark, sf_dir):
    """Health of a source from the states of its runs."""
    s = F.col("o_orderstatus")
    health = F.when(F.bool_and(s == "F"), F.lit("failed")).when(F.bool_or(s.isin("F", "P")), F.lit("degraded")).otherwise(F.lit("ok"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(health.alias("health"), F.count(F.lit(1)).alias("runs"))


@registry.query("""
    SELECT l_suppkey, p_brand AS common_brand, n FROM (
        SELECT l_suppkey, p_brand, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, p_brand) AS r
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) WHERE r = 1 AND n >= 2""")
def common_values(spark, sf_dir):
    """The most common value of each group with at least two supporters."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    counts = lines.join(part, lines["l_partkey"] == part["p_partkey"]).groupBy("l_suppkey", "p_brand").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    w = Window.partitionBy("l_suppkey").orderBy(F.col("n").desc(), "p_brand")
    return counts.withColumn("r", F.row_number().over(w)).where("r = 1").select("l_suppkey", F.col("p_brand").alias("common_brand"), "n")


@registry.query("""
    WITH m AS (SELECT o_orderkey, o_totalprice, o_orderpriority, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey),
    s AS (SELECT c_mktsegment, avg(o_totalprice) AS mean FROM m GROUP BY 1),
    p AS (SELECT c_mktsegment, o_orderpriority AS usual FROM (SELECT c_mktsegment, o_orderpriority, row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, o_orderpriority) AS r FROM m GROUP BY 1, 2) WHERE r = 1)
    SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_totalprice > 1.8 * mean THEN 'value' END, CASE WHEN o_orderpriority <> usual THEN 'priority' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM m JOIN s USING (c_mktsegment) JOIN p USING (c_mktsegment) WHERE o_totalprice > 1.8 * mean""")
def outlier_review(spark, sf_dir):
    """Members that stand out from their group, with the reasons."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    m = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select("o_orderkey", "o_totalprice", "o_orderpriority", "c_mktsegment")
    means = m.groupBy("c_mktsegment").agg(F.avg("o_totalprice").alias("mean"))
    counts = m.groupBy("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    usual = counts.groupBy("c_mktsegment").agg(F.min_by("o_orderpriority", F.struct(-F.col("n"), "o_orderpriority")).alias("usual"))
    rows = m.join(means, "c_mktsegment").join(usual, "c_mktsegment").where(F.col("o_totalprice") > 1.8 * F.col("mean"))
    reasons = F.array_compact(F.array(F.lit("value"), F.when(F.col("o_orderpriority") != F.col("usual"), F.lit("priority"))))
    return rows.select("o_orderkey", F.array_join(reasons, ",").alias("reasons"))


@registry.query("""
    SELECT p_brand, n, round(mean, 6) AS mean, round(100 * mean / max(mean) OVER (), 6) AS relative FROM (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS mean FROM part GROUP BY p_brand)""")
def relative_scores(spark, sf_dir):
    """Averages, each with its percentage of the best."""
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("mean"))
    best = rows.agg(F.max("mean").alias("best"))
    return rows.crossJoin(F.broadcast(best)).select("p_brand", "n", F.round("mean", 6).alias("mean"), F.round(100 * F.col("mean") / F.col("best"), 6).alias("relative"))  # one row


@registry.query("""
    WITH g AS (SELECT event_type, user_id, count(*) AS c, sum(value) AS s FROM events GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY c DESC, s DESC, user_id) AS n FROM g)
    SELECT event_type, user_id AS display FROM r WHERE n = 1""")
def display_mode(spark, sf_dir):
    """The weighted mode of each group: most rows, then most weight, then the least name."""
    g = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("c"), F.sum("value").alias("s"))
    return g.groupBy("event_type").agg(F.min_by("user_id", F.struct(-F.col("c"), -F.col("s"), F.col("user_id"))).alias("display"))


@registry.query("""
    SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS normal, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS compact,
           regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') AS slug, substr(sha1(p_brand || chr(31) || p_name), 1, 16) AS digest FROM part""")
def name_keys(spark, sf_dir):
    """Normal forms and identifiers of names."""
    digest = F.substring(F.sha1(F.concat_ws("\u001f", "p_brand", "p_name").cast("binary")), 1, 16)
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", X.normalize_name(name).alias("normal"), X.compact_key(name).alias("compact"), X.slug(name).alias("slug"), digest.alias("digest"))
