"""Plain SQL surface: set operations, grouping sets, frames, recursion, windows over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brightloom.plans import sqlguard
from brightloom.queries.registry import Registry, table

registry = Registry()


@registry.query("""
    SELECT c_nationkey::BIGINT AS k, 'both' AS side FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT c_nationkey::BIGINT, 'customers only' FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def set_ops(spark, sf_dir):
    """Intersection, difference and union of key sets."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("k"))
    return c.intersect(s).withColumn("side", F.lit("both")).union(c.exceptAll(s).distinct().join(s, "k", "left_anti").withColumn("side", F.lit("customers only")))


@registry.query("""
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus) HAVING count(*) > 100""")
def cube_rollup_having(spark, sf_dir):
    """All grouping sets of two columns, large groups only."""
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity")).where("n > 100")


@registry.query("""
    SELECT event_id, rank() OVER w AS rank, dense_rank() OVER w AS dense, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving,
           lead(event_id) OVER w AS next_id, first_value(event_id) OVER w AS first_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_frames(spark, sf_dir):
    """Ranks, neighbours and a moving average."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("moving"), F.lead("event_id").over(w).alias("next_id"), F.first("event_id").over(w).alias("first_id"))


@registry.query("""
    WITH RECURSIVE up(id, pos, depth) AS (SELECT n_nationkey, n_regionkey, 0 FROM nation UNION ALL SELECT id, pos - 1, depth + 1 FROM up WHERE pos > 0)
    SELECT id::BIGINT AS id, max(depth)::BIGINT AS depth FROM up GROUP BY id""")
def recursive_cte(spark, sf_dir):
    """A walk by recursion."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("brightloom_nation")
    return spark.sql("""
        WITH RECURSIVE up(id, pos, depth) AS (SELECT n_nationkey, n_regionkey, 0 FROM brightloom_nation UNION ALL SELECT id, pos - 1, depth + 1 FROM up WHERE pos > 0)
        SELECT CAST(id AS BIGINT) AS id, CAST(max(depth) AS BIGINT) AS depth FROM up GROUP BY id""")


@registry.query()
def approx_distinct(spark, sf_dir):
    """Approximate distinct counts and quantiles of each group."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median"))


@registry.query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 450000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 51""")
def sql_guarded(spark, sf_dir):
    """A guarded query with its probe for more rows."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("brightloom_orders")
    return sqlguard.guarded(spark, "SELECT o_orderkey, o_totalprice FROM brightloom_orders WHERE o_totalprice > 450000 ORDER BY o_totalprice DESC, o_orderkey;", 50)


@registry.query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS starts, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, sf_dir):
    """Totals by day."""
    w = F.window(F.col("ts"), "1 day")
    return table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("starts"), "event_type", "n", "total")


@registry.query("""
    SELECT starts, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR, time_bucket(INTERVAL 6 HOUR, ts)]) AS starts FROM events) GROUP BY starts""")
def sliding_window(spark, sf_dir):
    """Counts in windows of twelve hours, every six."""
    return table(spark, sf_dir, "events").groupBy(F.window(F.col("ts"), "12 hours", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("starts"), "n")


@registry.query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 4 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, min(ts) AS starts, count(*) AS n FROM s GROUP BY user_id, session""")
def session_window(spark, sf_dir):
    """Sessions that a gap of four hours ends."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window(F.col("ts"), "4 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("starts"), "n")


@registry.query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf_dir):
    """Sums of priced lines by two flags."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"), F.count(F.lit(1)).alias("n"))
