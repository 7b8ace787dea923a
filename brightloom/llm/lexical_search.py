"""Ranked lexical search: an inverted index in shards, MaxScore within each.

Terms are the maximal runs of ASCII letters, digits and characters beyond
ASCII, ``A-Z`` in lower case. A term's weight falls with the number of
documents that hold it, its impact in a document rises with its occurrences and
falls with the document's length. All is counted in 64-bit integers, but for
one logarithm a term.

* A task cuts the documents it reads into shards of bounded size and writes one
  row a shard: terms with their postings, ids and lengths. Nothing is shuffled.
  Counts over the corpus come from the index: one row of totals, and of
  document frequencies those of the terms that are asked for.
* A search reads each shard once for a block of items. Every list has an upper
  bound, its weight times its greatest impact here. An item's lists are taken
  by falling bound. While the bounds of the lists not yet taken could reach the
  threshold (the k-th best score so far), the next list is essential and adds
  to all its documents. From there on no document that was not met can qualify:
  the other lists are non-essential and only probed for the documents whose
  score plus the bounds to come still reach the threshold. An item's threshold
  goes on from shard to shard of a task.
* Each shard gives k rows an item at most, which are ranked over all shards;
  Spark limits ranks before that shuffle as well.
* Memory does not grow with the input: a row group of the index is a few
  shards, and shards go to a worker one at a time.

A block of items goes to the tasks with the code. It holds ``items_at_once``
items or few more; a larger table of items is searched in several blocks, each
over all shards.

Defined cases: null and empty texts and texts without terms don't count as
documents and are never found; an item without terms, or whose terms no
document holds, has no rows; items are the distinct pairs of id and text, null
ids included; repeated terms of an item count as often; repeated documents are
ranked row by row; equal scores go by ascending id, null ids last; a document
longer than a shard is a shard of its own, its whole text indexed; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from brightloom.plans.shared import Scratch, rows_at_once

TOP_K = 20
SHARD_BYTES = 4 << 20  # of text in a shard
SHARD_DOCS = 1 << 16
ITEMS_AT_ONCE = 1000
DOCS_AT_ONCE = 1024  # documents that go to a worker at a time
SHARDS_AT_ONCE = 1
# A file of the index can be read by several tasks. Sizes are looked at after each row: by default after 100, which are hundreds of MB here.
INDEX_OPTIONS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(raw: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return (raw or b"").translate(_LETTERS).split()


class _Numbers(dict):
    """A number for each term met, in order of first sight."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def _shard(docs: list[list[bytes]]) -> tuple:
    """Terms, list sizes, and postings (documents and occurrences, term by term) of some documents' terms."""
    number = _Numbers()
    lengths = np.array([len(d) for d in docs], np.int32)
    ids = np.fromiter((number[t] for d in docs for t in d), np.int64, int(lengths.sum()))
    cells, counts = np.unique(ids * len(docs) + np.repeat(np.arange(len(docs)), lengths), return_counts=True)
    sizes = np.bincount(cells // max(1, len(docs)), minlength=len(number)).astype(np.int32)
    return list(number), sizes, (cells % max(1, len(docs))).astype("<i4"), counts.astype("<i4"), lengths


def _index_schema(id_type: T.DataType) -> T.StructType:
    ints = T.ArrayType(T.IntegerType())
    fields = [("shard", T.LongType()), ("doc_ids", T.ArrayType(id_type)), ("lengths", ints), ("terms", T.ArrayType(T.BinaryType())), ("sizes", ints)]
    return T.StructType([T.StructField(*f) for f in (*fields, ("places", T.BinaryType()), ("counts", T.BinaryType()))])


def _indexed(id_type: T.DataType, shard_bytes: int):
    arrow_id = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 33, 0
        names = _index_schema(id_type).names

        def row(ids: list, docs: list[list[bytes]]) -> pa.RecordBatch:
            terms, sizes, places, counts, lengths = _shard(docs)
            cells = [pa.array([base + made]), pa.array([ids], pa.list_(arrow_id)), pa.array([lengths], pa.list_(pa.int32())), pa.array([terms], pa.list_(pa.binary()))]
            cells += [pa.array([sizes], pa.list_(pa.int32())), pa.array([places.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cells, names)

        ids, docs, held = [], [], 0
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms_of(raw.as_py())
                if not found:
                    continue
                ids.append(key)
                docs.append(found)
                held += raw.as_buffer().size
                if held >= shard_bytes or len(docs) == SHARD_DOCS:
                    yield row(ids, docs)
                    ids, docs, held, made = [], [], 0, made + 1
        if docs:
            yield row(ids, docs)

    return run


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Index every document of ``docs`` as Parquet at ``path``, one row a shard."""
    id_type = docs.schema[id_col].dataType
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("id"), raw.alias("raw")).mapInArrow(_indexed(id_type, shard_bytes), _index_schema(id_type))
    with rows_at_once(docs.sparkSession, DOCS_AT_ONCE):
        Scratch(docs.sparkSession, "index").write(rows, path, "zstd", INDEX_OPTIONS)


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


class _Lists:
    """The lists of a shard that a block of items asks for, with impacts and upper bounds."""

    def __init__(self, row: dict, asked: dict[bytes, tuple[int, int]], n_docs: int, n_terms: int):
        lengths = np.array(row["lengths"], np.int64)
        ends = np.cumsum(row["sizes"])
        places, counts = np.frombuffer(row["places"], "<i4"), np.frombuffer(row["counts"], "<i4")
        m = 75 + (25 * lengths * n_docs) // n_terms
        self.size = len(lengths)
        self.lists: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for term, size, end in zip(row["terms"], row["sizes"], ends.tolist()):
            if term in asked:
                number, w = asked[term]
                at, tf = places[end - size : end], counts[end - size : end].astype(np.int64)
                scores = w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[at]))
                self.lists[number] = (int(scores.max()), at, scores)


def max_score(shard: _Lists, item: list[tuple[int, int]], order: np.ndarray, k: int, threshold: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of a shard's best ``k`` documents for an item of ``(term number, repeats)``, and the threshold that they set.

    Documents below ``threshold`` are left out; ``order`` ranks documents of equal score.
    """
    lists = sorted(((bound * n, n, at, scores) for number, n in item if number in shard.lists for bound, at, scores in [shard.lists[number]]), key=lambda x: -x[0])
    rest = [0]
    for bound, *_ in reversed(lists):
        rest.append(rest[-1] + bound)
    rest.reverse()  # of the lists from each one on

    def raised(scores: np.ndarray) -> int:
        return max(threshold, int(np.partition(scores, len(scores) - k)[-k])) if len(scores) >= k else threshold

    total = np.zeros(shard.size, np.int64)
    nth = 0
    while nth < len(lists) and rest[nth] >= threshold:  # essential
        _, n, at, scores = lists[nth]
        total[at] += n * scores
        threshold = raised(total)
        nth += 1
    met = np.flatnonzero(total + rest[nth] >= threshold)
    met = met[total[met] > 0]
    found = total[met]
    for later in range(nth, len(lists)):  # non-essential
        _, n, at, scores = lists[later]
        spot = np.minimum(np.searchsorted(at, met), len(at) - 1)
        found = found + np.where(at[spot] == met, n * scores[spot], 0)
        threshold = raised(found)
        stay = found + rest[later + 1] >= threshold
        met, found = met[stay], found[stay]
    stay = found >= threshold
    met, found = met[stay], found[stay]
    best = np.lexsort((order[met], -found))[:k]
    return met[best], found[best], threshold


def _searched(items: list[list[tuple[int, int]]], asked: dict[bytes, tuple[int, int]], n_docs: int, n_terms: int, k: int, id_type: T.DataType):
    arrow_id = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thresholds = [1] * len(items)
        for row in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            shard = _Lists(row, asked, n_docs, n_terms)
            ids = pa.array(row["doc_ids"], arrow_id)
            order = np.empty(len(ids), np.int64)
            order[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
            which, at, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, item in enumerate(items):
                met, found, thresholds[i] = max_score(shard, item, order, k, thresholds[i])
                which.append(np.full(len(met), i))
                at.append(met)
                scores.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(which)), ids.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(scores))], ["item", "doc_id", "score"])

    return run


def search(spark, path: str, items: DataFrame, item_col: str = "item_id", text_col: str = "text", k: int = TOP_K, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` best documents of the index at ``path`` for each item."""
    index = spark.read.parquet(path)
    id_type = index.schema["doc_ids"].dataType.elementType
    told = index.agg(F.sum(F.size("doc_ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n_docs, n_terms = told[0] or 0, told[1] or 0
    scratch = Scratch(spark, "search")
    asked_items = items.select(F.col(item_col).alias("item_id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("raw")).distinct()
    asked_items = scratch.keep(asked_items, "items")
    blocks = max(1, -(-asked_items.count() // items_at_once))
    out_schema = T.StructType([asked_items.schema["item_id"], T.StructField("rank", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    out = scratch.path("hits")
    spark.createDataFrame([], out_schema).write.parquet(out)
    for block in range(blocks):
        # A bounded block: its items and their terms' frequencies come to the driver and go out with the code.
        rows = [(r.item_id, terms_of(bytes(r.raw))) for r in asked_items.where(F.pmod(F.xxhash64("item_id", "raw"), F.lit(blocks)) == block).collect()]
        vocabulary = sorted({t for _, terms in rows for t in terms})
        if not vocabulary:
            continue
        wanted = spark.createDataFrame([(t,) for t in vocabulary], "term binary")
        held = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.sizes").alias("size"))
        sums = held.join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("size").alias("n")).collect()
        asked = {bytes(r.term): (i, w) for i, r in enumerate(sums) if (w := weight(n_docs, r.n)) > 0}
        counted = [[(asked[t][0], terms.count(t)) for t in sorted(set(terms)) if t in asked] for _, terms in rows]
        hits = index.mapInArrow(_searched(counted, asked, n_docs, n_terms, k, id_type), T.StructType([T.StructField("item", T.LongType()), *out_schema.fields[2:]]))
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        named = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(rows)], T.StructType([T.StructField("item", T.LongType()), out_schema.fields[0]]))
        with rows_at_once(spark, SHARDS_AT_ONCE):
            ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(out)
    scratch.drop("items")
    return spark.read.schema(out_schema).parquet(out)


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents for each item of ``benchmark``."""
    path = Scratch(spark, "op12").path("index")
    write_index(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return search(spark, path, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = {
    "op12_lexical_search": r"""
        WITH split AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents
        ),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM split GROUP BY ALL),
        lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
        totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
        m AS (SELECT doc_id, 75 + (25 * n * n_docs) // n_terms AS m FROM lengths, totals),
        weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term),
        asked AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ),
        scores AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN m USING (doc_id)
            GROUP BY item_id, doc_id
        )
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
        FROM scores
        WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
    """,
}
QUERIES = {"op12_lexical_search": op12_lexical_search}
