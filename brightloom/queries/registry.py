"""Registration of a query with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Register the function under its own name."""

        def add(f: Callable[[SparkSession, str], DataFrame]):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed_sql(parts: int, name: str) -> str:
    """SQL of ``name(doc_id, part, hi, lo)``: the majority bits of the words' MD5 in each of a text's stretches."""
    sums = ", ".join(f"sum(({x} >> {i}) & 1) AS {x}{i}" for x in ("hi", "lo") for i in range(32))
    whole = lambda x: " + ".join(f"CASE WHEN 2 * {x}{i} > n THEN {1 << i}::BIGINT ELSE 0 END" for i in range(32))
    return f"""{name}_words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p, len(w) AS of FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)),
    {name}_votes AS (SELECT doc_id, (p * {parts}) // of AS part, count(*) AS n, {sums} FROM (SELECT *, ('0x' || substr(md5(word), 1, 8))::BIGINT AS hi, ('0x' || substr(md5(word), 9, 8))::BIGINT AS lo FROM {name}_words) GROUP BY 1, 2),
    {name} AS (SELECT doc_id, part, {whole('hi')} AS hi, {whole('lo')} AS lo FROM {name}_votes)"""
