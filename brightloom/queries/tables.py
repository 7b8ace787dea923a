"""Tables that change: versions of a keyed table, an index that follows its documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightloom.operators.live_index import LiveIndex
from brightloom.plans.shared import Scratch
from brightloom.queries.registry import Registry, table
from brightloom.sources.snapshots import KeyedTable

registry = Registry()
TERMS = ["worthless", "idiot", "token"]


@registry.query("""
    WITH kept AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, 0 AS changed FROM orders WHERE o_orderkey % 7 <> 0 AND o_custkey % 11 <> 0),
    new AS (SELECT o_orderkey, o_custkey, o_totalprice * 2 AS o_totalprice, 'X' AS o_orderstatus, 1 AS changed FROM orders WHERE o_orderkey % 7 = 0)
    SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice, o_orderstatus, changed FROM (SELECT * FROM kept UNION ALL SELECT * FROM new)""")
def versioned_orders(spark, sf_dir):
    """Orders after a change: those of some customers deleted, then every seventh order put in anew at twice its price."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", F.lit(0).alias("changed"))
    kept = KeyedTable(spark, Scratch(spark, "orders").path("table"))
    kept.create(orders, ["o_custkey", "o_orderkey"], ["o_custkey"], 32)
    new = orders.where("o_orderkey % 7 = 0").select("o_orderkey", "o_custkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit("X").alias("o_orderstatus"), F.lit(1).alias("changed"))
    kept.apply(new, orders.where("o_custkey % 11 = 0").select("o_custkey"), ["o_custkey"])
    return kept.read().select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"), "o_orderstatus", "changed")


@registry.query("""
    WITH now AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN text || ' token token' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 4),
    t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM now), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
    p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM t) WHERE term IN ('worthless', 'idiot', 'token') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term)
    SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM p JOIN df USING (term), st GROUP BY doc_id""")
def index_after_changes(spark, sf_dir):
    """Scores from an index after a tenth of the documents was changed and a tenth taken out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = LiveIndex(spark, Scratch(spark, "live").path("index"))
    index.create(docs)
    index.update(docs.where("doc_id % 10 IN (3, 4)").select("doc_id", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit(" token token"))).alias("text")))
    return index.scores(TERMS).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))
