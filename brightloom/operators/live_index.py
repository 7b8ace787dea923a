"""An inverted index that follows its documents: only the term buckets of what changed are written anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions import text as X
from brightloom.operators import retrieval as R
from brightloom.plans.shared import Scratch
from brightloom.sources.snapshots import KeyedTable


class LiveIndex:
    """Postings by term and, for each document, the terms that it has there, as one string."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.postings, self.documents = KeyedTable(spark, f"{path}/postings"), KeyedTable(spark, f"{path}/documents")

    @staticmethod
    def _told(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
        words = docs.select(F.col(id_col).alias("id"), X.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
        rows = words.select("id", F.size("w").cast("long").alias("len"), F.array_join(F.array_distinct("w"), " ").alias("terms"))
        return rows, R.word_counts(docs, id_col, text_col).where(F.col("term") != R.LENGTH_TERM)

    def create(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 64) -> None:
        rows, postings = self._told(docs, id_col, text_col)
        self.postings.create(postings.select("term", "id", "len", "tf"), ["term", "id"], ["term"], buckets)
        self.documents.create(rows, ["id"], buckets=buckets)

    def update(self, changed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Documents as they are now; a null text takes a document out. One row an id.

        Postings that a document had and has no more are told by its stored
        terms, so no bucket is read that holds none of its terms. Postings come
        before documents: an update that fails between can be made again.
        """
        ids = changed.select(F.col(id_col).alias("id"))
        here = changed.where(F.col(text_col).isNotNull())
        rows, postings = self._told(here, id_col, text_col)
        before = self.documents.read().join(ids, "id", "left_semi").select("id", F.explode(F.split("terms", " ")).alias("term")).where("term <> ''")
        scratch = Scratch(self.spark, "before")
        self.postings.apply(postings, scratch.keep(before, "terms"), ["term", "id"])
        scratch.drop_all_but()
        self.documents.apply(rows, ids, ["id"])

    def scores(self, terms: list[str]) -> DataFrame:
        """``id, score`` (BM25) of every document that has one of the terms."""
        stats = self.documents.read().agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))  # one row
        hits = self.postings.read().where(F.col("term").isin(terms))
        often = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row a term
        rows = hits.join(F.broadcast(often), "term").crossJoin(F.broadcast(stats))
        return rows.groupBy("id").agg(F.sum(R.posting_score(*[F.col(c) for c in ("tf", "len", "df", "n", "mean")])).alias("score"))
