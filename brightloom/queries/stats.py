"""Filters, counts, pages and membership tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brightloom.queries.registry import Registry, table

registry = Registry()


def labelled(labels):
    """Labels as an array of risk names, in order."""
    names = F.array(F.when(F.col("toxic") == 1, F.lit("toxic")), F.when(F.col("quality") == 0, F.lit("low_quality")))
    return labels.select("doc_id", "quality", "toxic", F.array_compact(names).alias("risks"))


@registry.query("""
    SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
    WHERE lower(o_orderstatus) = lower('f') AND o_orderpriority ILIKE '%urgent%' AND o_totalprice >= 1000
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 10""")
def list_filtered_page(spark, sf_dir):
    """A page of rows that pass optional filters, by recency then key."""
    filters = {"o_orderstatus": lambda c: F.lower(c) == F.lower(F.lit("f")), "o_orderpriority": lambda c: F.ilike(c, F.lit("%urgent%")), "o_totalprice": lambda c: c >= 1000}
    rows = table(spark, sf_dir, "orders")
    for column, passes in filters.items():
        rows = rows.where(passes(F.col(column)))
    return rows.orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(10).limit(50).select("o_orderkey", "o_orderdate", "o_totalprice")


@registry.query("""
    SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
    WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1999-01-01', 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51""")
def keyset_page(spark, sf_dir):
    """The page after a cursor, descending, with one row more that tells whether another follows."""
    cursor = F.struct(F.lit("1999-01-01").cast("timestamp_ntz").alias("o_orderdate"), F.lit(5000).cast("long").alias("o_orderkey"))
    rows = table(spark, sf_dir, "orders").where(F.struct("o_orderdate", "o_orderkey") < cursor)
    return rows.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(51).select("o_orderkey", "o_orderdate", "o_totalprice")


@registry.query("""
    SELECT event_id, ts, base64(encode('{"t":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","id":' || event_id || '}')) AS cursor
    FROM events WHERE ts > TIMESTAMP '2024-01-10' OR (ts = TIMESTAMP '2024-01-10' AND event_id > 0) ORDER BY ts, event_id LIMIT 101""")
def change_feed_page(spark, sf_dir):
    """A page of a feed in ascending order, each row with the opaque cursor that continues after it."""
    at = F.lit("2024-01-10").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "events").where((F.col("ts") > at) | ((F.col("ts") == at) & (F.col("event_id") > 0)))
    cursor = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"), F.col("event_id").alias("id")))
    return rows.orderBy("ts", "event_id").limit(101).select("event_id", "ts", F.base64(cursor.cast("binary")).alias("cursor"))


@registry.query("SELECT count(*) AS n FROM events WHERE event_type = 'error' AND value > 5 AND ts >= TIMESTAMP '2024-01-30' - INTERVAL 20 DAY")
def count_filtered(spark, sf_dir):
    """A count under filters, one of them a look-back from a given time."""
    now = F.lit("2024-01-30").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").where((F.col("event_type") == "error") & (F.col("value") > 5) & (F.col("ts") >= now - F.expr("INTERVAL 20 DAY"))).agg(F.count(F.lit(1)).alias("n"))


@registry.query("""
    SELECT source, n FROM (SELECT CASE WHEN n_chars > 500 THEN source END AS source, count(*) AS n FROM documents GROUP BY 1)
    ORDER BY n DESC, source IS NULL, source LIMIT 8""")
def stats_by_dim(spark, sf_dir):
    """The most common values with the null bucket last among equals."""
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("n_chars") > 500, F.col("source")).alias("source"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("source").asc_nulls_last()).limit(8)


@registry.query("""
    SELECT risk, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'low_quality' END], lambda x: x IS NOT NULL)) AS risk
    FROM labels JOIN documents USING (doc_id) WHERE lang = 'en') GROUP BY risk""")
def risk_label_counts(spark, sf_dir):
    """Counts over an exploded array, the filter taken from the parent."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    rows = labelled(table(spark, sf_dir, "labels")).join(docs, "doc_id")
    return rows.select(F.explode("risks").alias("risk")).groupBy("risk").agg(F.count(F.lit(1)).alias("n"))


@registry.query("SELECT o_orderkey FROM orders WHERE contains(',' || replace(o_orderpriority, '-', ',') || ',', ',HIGH,')")
def csv_membership(spark, sf_dir):
    """Rows whose comma-separated list holds a member."""
    members = F.split(F.regexp_replace("o_orderpriority", "-", ","), ",")
    return table(spark, sf_dir, "orders").where(F.array_contains(members, "HIGH")).select("o_orderkey")


@registry.query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def exists_label(spark, sf_dir):
    """Rows for which a label exists."""
    toxic = labelled(table(spark, sf_dir, "labels")).where(F.array_contains("risks", "toxic")).select("doc_id")
    return table(spark, sf_dir, "documents").join(toxic, "doc_id", "left_semi").select("doc_id", "lang")


@registry.query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND instr(o_orderpriority, 'URGENT') > 0)")
def not_exists_lease(spark, sf_dir):
    """Rows without a matching row on the other side."""
    held = table(spark, sf_dir, "orders").where(F.instr("o_orderpriority", "URGENT") > 0).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(held, "c_custkey", "left_anti").select("c_custkey")


@registry.query("""
    SELECT o_orderkey, o_orderpriority FROM orders
    ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 25""")
def enum_ranked_list(spark, sf_dir):
    """The first rows by a ranked status, then value."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return table(spark, sf_dir, "orders").orderBy(rank, F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_orderpriority")


@registry.query("SELECT doc_id, source FROM documents WHERE doc_id = 7")
def point_lookup(spark, sf_dir):
    """One row by its key, the predicate pushed into the scan."""
    return table(spark, sf_dir, "documents").where("doc_id = 7").select("doc_id", "source")


@registry.query("""
    WITH h AS (SELECT * FROM (VALUES (5, 1), (2, 2), (9, 3), (7, 4), (1, 5)) t(doc_id, rank))
    SELECT h.doc_id::BIGINT AS doc_id, rank::BIGINT AS rank FROM h JOIN documents d ON d.doc_id = h.doc_id WHERE lang = 'en' ORDER BY rank LIMIT 3""")
def filter_hits_in_order(spark, sf_dir):
    """Hits of a list that pass a filter, in the list's order."""
    hits = spark.createDataFrame([(5, 1), (2, 2), (9, 3), (7, 4), (1, 5)], "doc_id long, rank long")
    allowed = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return hits.join(allowed, "doc_id", "left_semi").orderBy("rank").limit(3)


@registry.query("""
    SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, min(ts) AS first_ts, max(ts) AS last_ts, date_diff('day', min(ts)::DATE, max(ts)::DATE)::BIGINT AS span_days
    FROM events GROUP BY user_id""")
def date_spans(spark, sf_dir):
    """Number, mean, date range and span of each key's rows."""
    span = F.datediff(F.max("ts"), F.min("ts")).cast("long")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), span.alias("span_days"))


@registry.query("""
    SELECT event_type, k, n FROM (SELECT event_type, k, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, k) AS r
    FROM (SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r <= 3""")
def json_top_values(spark, sf_dir):
    """The three most common values inside a JSON column for each group."""
    k = F.get_json_object("props", "$.k").cast("long")
    counts = table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type").orderBy(F.col("n").desc(), "k")
    return counts.withColumn("r", F.row_number().over(w)).where("r <= 3").select("event_type", "k", "n")
