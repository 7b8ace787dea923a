"""Queries by name with arguments, as an agent or a service calls them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.operators import retrieval as R
from brightloom.operators.search_engine import Knobs, SearchEngine
from brightloom.plans.sqlguard import guarded
from brightloom.sources.snapshots import KeyedTable

MAX_ROWS = 50


def count_rows(spark: SparkSession, view: str, **equals) -> DataFrame:
    """Rows of a view with the given values."""
    rows = spark.table(view)
    for column, value in equals.items():
        rows = rows.where(F.col(column) == value)
    return rows.agg(F.count(F.lit(1)).alias("n"))


def aggregate(spark: SparkSession, view: str, by: str, limit: int = 10) -> DataFrame:
    """The most common values of a column and one more than asked for, which tells of others."""
    return spark.table(view).groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(by).asc_nulls_last()).limit(min(limit, MAX_ROWS) + 1)


def search_text(spark: SparkSession, view: str, query: str, k: int = 10) -> DataFrame:
    """Best documents of a view for a query's words."""
    hits = R.bm25(spark.table(view), sorted(set(query.lower().split())))
    return R.top_k(hits, min(k, MAX_ROWS), F.col("score").desc(), "doc_id")


def similar(spark: SparkSession, view: str, seed: int, k: int = 10, floor: float = 0.70) -> DataFrame:
    """Vectors of a view most similar to one of them, at a floor or above."""
    rows = spark.table(view)
    return R.nearest(rows.where(F.col("vec_id") != seed), R.seed_vector(rows, seed), min(k, MAX_ROWS), metric="cosine").where(F.col("similarity") >= floor)


def hybrid(spark: SparkSession, documents: str, query: str, vectors: DataFrame | None = None, vector: list[float] | None = None, k: int = 10) -> DataFrame:
    """Best documents of a table of files for a query, by its index and, where a vector is given, by vectors; words alone otherwise."""
    if not query.strip():
        raise ValueError("a query is required")
    asked = spark.createDataFrame([(0, 0, query, None, vector)], "qid int, nth int, text string, seed long, vector array<double>")
    none = spark.createDataFrame([], "id long, embedding array<double>")
    engine = SearchEngine(spark, R.open_index(spark, documents), none if vectors is None else vectors, knobs=Knobs(k=min(k, MAX_ROWS)))
    return engine.search(asked, "tool").drop("qid")


def time_vectors(spark: SparkSession, vectors: DataFrame, path: str, k: int = 10, queries: int = 5) -> DataFrame:
    """``vectors, dim, k, insert_ms, search_ms``: how long it takes to put ``vectors(id, embedding)`` into a keyed table and to find the ``k`` nearest of some of them."""
    table = KeyedTable(spark, path)
    start = time.perf_counter()
    table.create(vectors.select("id", "embedding"), ["id"])
    insert, rows = time.perf_counter() - start, table.read()
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    seeds = [r.id for r in rows.orderBy("id").limit(queries).collect()]
    start = time.perf_counter()
    for seed in seeds:
        R.nearest(rows, rows.where(F.col("id") == seed).select(F.col("embedding").alias("q")), k, "id").collect()
    each = (time.perf_counter() - start) / max(1, len(seeds))
    return spark.createDataFrame([(n, dim, k, round(1000 * insert, 3), round(1000 * each, 3))], "vectors long, dim int, k int, insert_ms double, search_ms double")


def sql(spark: SparkSession, statement: str, limit: int = MAX_ROWS) -> DataFrame:
    """A read-only statement."""
    return guarded(spark, statement, min(limit, MAX_ROWS))


def schema_summary(spark: SparkSession) -> DataFrame:
    """``view, column, type`` of every registered view."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "view string, column string, type string")


TOOLS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (count_rows, aggregate, search_text, similar, hybrid, time_vectors, sql, schema_summary)}
