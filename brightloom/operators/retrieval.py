"""Lexical and vector retrieval, rank fusion and evidence reranking.

Queries over plain tables are narrow scans followed by a top-k: a text is
tokenised where it lies and only the query's terms are counted, so nothing but
one row of corpus statistics and the top rows of each task is moved. Where many
queries are asked, ``write_postings`` writes an inverted index once, and
``bm25_indexed`` reads the parts of it that hold the query's terms.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from brightloom.functions import text as X
from brightloom.functions import vectors as V
from brightloom.plans.shared import shared_dir

K1, B = 1.2, 0.75
RRF_K = 60


def bm25(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every document that has one of the terms.

    Document frequencies and the mean length are taken over all documents.
    """
    words = docs.select(id_col, X.tokens(F.col(text_col)).alias("w"))
    counts = words.select(id_col, F.size("w").alias("len"), *[F.size(F.filter("w", _equals(t))).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        score = score + idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    hit = F.lit(False)
    for i in range(len(terms)):
        hit = hit | (F.col(f"tf{i}") > 0)
    return counts.where(hit).crossJoin(F.broadcast(stats)).select(id_col, score.alias("score"))  # stats is one row


LAYOUT = "v3"  # of an index; sessions share the folder that indexes are kept in
#: A document's own entry: its length stands where occurrences would.
LENGTH_TERM = ""
MOST_PARTS = 4096
FILES = 6  # for each split of the input
LEAST_SPREAD = 4  # files of a part, at least
ROWS_AT_ONCE = 1 << 17


def _posting_rows(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(at: list[int], lengths: list[int], sizes: list[int], terms: list[bytes], counts: list[int], ids: pa.Array) -> pa.RecordBatch:
            spread = np.repeat(np.arange(len(at)), sizes)
            columns = [ids.take(pa.array(np.array(at)[spread])), pa.array(np.array(lengths, np.int64)[spread]), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["id", "len", "term", "tf"])

        for batch in batches:
            at, lengths, sizes, terms, counts = [], [], [], [], []
            ids = batch.column(0).cast(id_type)
            for i, text in enumerate(batch.column(1)):
                words = X.ascii_words(text.as_py())
                found = Counter(words)
                at.append(i)
                lengths.append(len(words))
                sizes.append(len(found) + 1)
                terms += [b"", *found]
                counts += [len(words), *found.values()]
                if len(terms) >= ROWS_AT_ONCE:
                    yield flush(at, lengths, sizes, terms, counts, ids)
                    at, lengths, sizes, terms, counts = [], [], [], [], []
            if at:
                yield flush(at, lengths, sizes, terms, counts, ids)

    return run


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, len, term, tf`` of a document's words, counted where its text lies, and its own entry."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("len", T.LongType()), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_posting_rows(to_arrow_type(kind)), schema)


def _write_parts(rows: DataFrame, parts: int, spread: int, out: str) -> None:
    """Postings by part of the term's hash, sorted by term; a part has ``spread`` files, so a term that most documents have is in several.

    A file is one task's: hashed once more, some tasks would have several and some none.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    file = F.col("part") * spread + F.pmod(F.xxhash64("id"), F.lit(spread)).cast("int")
    dealt.repartitionById(parts * spread, file).sortWithinPartitions("part", "term", "id").write.partitionBy("part").parquet(f"{out}/postings")


def _write_stats(postings: DataFrame, parts: int, spread: int, out: str) -> None:
    postings.where(F.col("term") != LENGTH_TERM).groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{out}/terms")
    lengths = postings.where(F.col("term") == LENGTH_TERM)
    lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), F.lit(parts).alias("parts"), F.lit(spread).alias("spread")).write.parquet(f"{out}/stats")


def write_postings(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """An inverted index: ``postings`` by part of the term's hash, ``terms`` with their frequencies, and one row of ``stats``.

    A posting has the document's length, so a score takes no join; each document
    has an entry of its own, under an empty term. A document's words are counted
    where its text lies; what is shuffled is its distinct words. There are
    ``FILES`` files for each split of the input, ``LEAST_SPREAD`` a part or more.
    """
    rows = word_counts(docs, id_col, text_col)
    files = FILES * docs.rdd.getNumPartitions()
    parts = min(MOST_PARTS, max(2, -(-files // LEAST_SPREAD)))
    spread = max(LEAST_SPREAD, -(-files // parts))
    _write_parts(rows, parts, spread, out)
    _write_stats(docs.sparkSession.read.parquet(f"{out}/postings"), parts, spread, out)


def replace_postings(spark: SparkSession, index: str, changed: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The index with the documents in ``changed`` as they are now; a null text takes a document out.

    ``changed`` holds one row an id. Written anew to ``out``: Parquet has no updates.
    """
    new = f"{out}/new"
    write_postings(changed.where(F.col(text_col).isNotNull()), new, id_col, text_col)
    told = spark.read.parquet(f"{index}/stats").first()
    kept = spark.read.parquet(f"{index}/postings").drop("part").join(changed.select(F.col(id_col).alias("id")), "id", "left_anti")
    _write_parts(kept.unionByName(spark.read.parquet(f"{new}/postings").drop("part")), told["parts"], told["spread"], out)
    _write_stats(spark.read.parquet(f"{out}/postings"), told["parts"], told["spread"], out)


def table_version(spark: SparkSession, path: str) -> str:
    """A name for what a table of files holds now: their names, sizes and times, without reading rows."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    n, mark = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{path} {n} {mark}".encode()).hexdigest()[:24]


def open_index(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """The index of a table of documents in the shared folder; built once for each version of the table."""
    found = f"{shared_dir(spark)}/brightloom/indexes/{LAYOUT}-{id_col}-{text_col}-{table_version(spark, path)}"
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(found).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place(found)):
        own = f"{found}-{uuid.uuid4().hex[:8]}"
        write_postings(spark.read.parquet(path), own, id_col, text_col)
        # Another session may have been faster; its index is as good.
        if files.exists(place(found)) or not files.rename(place(own), place(found)):
            files.delete(place(own), True)
    return found


def postings_of(spark: SparkSession, index: str, terms: list[str]) -> DataFrame:
    """The postings of some terms, from their parts alone."""
    told = spark.read.parquet(f"{index}/stats").first()
    wanted = spark.createDataFrame([(t,) for t in terms], "term string")
    parts = [r.p for r in wanted.select(F.pmod(F.xxhash64("term"), F.lit(told["parts"])).cast("int").alias("p")).distinct().collect()]  # one a term
    return spark.read.parquet(f"{index}/postings").where(F.col("part").isin(parts) & F.col("term").isin(terms))


def posting_score(tf: Column, length: Column, df: Column, n: Column, mean: Column) -> Column:
    """What a posting adds to a document's BM25 score."""
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def bm25_indexed(spark: SparkSession, index: str, terms: list[str]) -> DataFrame:
    """``id, score`` of every document that has one of the terms, from the index alone."""
    hits = postings_of(spark, index, terms)
    frequency = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row a term
    rows = hits.join(F.broadcast(frequency), "term").crossJoin(F.broadcast(spark.read.parquet(f"{index}/stats")))  # one row
    return rows.groupBy("id").agg(F.sum(posting_score(*[F.col(c) for c in ("tf", "len", "df", "n", "mean")])).alias("score"))


def _equals(term: str):
    return lambda w: w == term


def top_k(scored: DataFrame, k: int, by: Column, id_col: str) -> DataFrame:
    """The first ``k`` rows by an order; ids break ties."""
    return scored.orderBy(by, F.col(id_col)).limit(k)


def relative_cut(scored: DataFrame, share: float = 0.40) -> DataFrame:
    """Rows that score at least a share of the best."""
    best = scored.agg(F.max("score").alias("best"))
    return scored.crossJoin(F.broadcast(best)).where(F.col("score") >= share * F.col("best")).drop("best")  # one row


def phrase_or_prefix(docs: DataFrame, phrase: list[str], prefixes: list[str], text_col: str = "text") -> DataFrame:
    """Documents with the words of a phrase in a row, or with a token for every prefix."""
    w = X.tokens(F.col(text_col))
    in_row = F.contains(F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")), F.lit(f" {' '.join(phrase)} "))
    every = F.lit(True)
    for p in prefixes:
        every = every & F.exists(w, _starts(p))
    return docs.select("*", in_row.alias("phrase_hit"), every.alias("prefix_hit")).where("phrase_hit OR prefix_hit")


def _starts(prefix: str):
    return lambda w: F.startswith(w, F.lit(prefix))


def nearest(vectors: DataFrame, query: DataFrame, k: int, id_col: str = "vec_id", metric: str = "l2") -> DataFrame:
    """``id, distance|similarity`` of the ``k`` vectors nearest to the one vector of ``query(q)``."""
    rows = vectors.crossJoin(F.broadcast(query))  # one query row
    if metric == "l2":
        return top_k(rows.select(id_col, V.l2_distance(F.col("embedding"), F.col("q")).alias("distance")), k, F.col("distance").asc(), id_col)
    return top_k(rows.select(id_col, V.cosine(F.col("embedding"), F.col("q")).alias("similarity")), k, F.col("similarity").desc(), id_col)


def seed_vector(vectors: DataFrame, seed: int, id_col: str = "vec_id") -> DataFrame:
    return vectors.where(F.col(id_col) == seed).select(F.col("embedding").alias("q"))


def ranked(hits: DataFrame, by: Column, id_col: str) -> DataFrame:
    """``id, rank`` of a short list of hits; the list is a top-k already."""
    return hits.select(F.col(id_col).alias("id"), F.row_number().over(Window.orderBy(by, F.col(id_col))).alias("rank"))


def fuse(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists ``id, rank``: ``id, rrf``."""
    union = lists[0]
    for one in lists[1:]:
        union = union.unionByName(one)
    return union.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def evidence_score(base: Column, words: Column, query: list[str]) -> Column:
    """A hit's score from how many query tokens begin a token of its evidence."""
    found = sum(F.when(F.exists(words, _starts(t)), F.lit(1)).otherwise(F.lit(0)) for t in query)
    return F.when(found > 0, base * (1 + found / len(query)) + 0.05 * found).otherwise(base * 0.6)
