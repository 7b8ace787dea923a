"""Lexical retrieval packing.

Documents become token ids; a window of ``window`` ids starts with a seed
document and is filled with the unused documents that a BM25 index ranks
highest for it. Whatever does not fit is cut and goes first into the next
window, so windows are full.

The inverted index is sharded. Document frequencies and the mean length are
counted over the whole corpus (a table of the size of the vocabulary). Every
document's two heaviest terms route it: shards are ranges of that lexical
order, so documents with the same rare terms are indexed together, and a term
that a third of the corpus shares is split further by row. A shard is read as
a stream and indexed ``shard_tokens`` ids at a time, which bounds memory. What
is left at a shard's end is cut into powers of two, which need no padding.

Defined cases: a null text counts as empty; an empty text has the closing id
alone and is packed; null and repeated ids are packed row by row; equal scores
are ranked by arrival; a very long text fills windows of its own and goes on in
further ones; an empty table gives no pieces; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from brightloom.llm.tokens import default_tokenizer, encoder, id_width, text_slices
from brightloom.plans.shared import Scratch

WINDOW = 4096
END_ID = 2
SHARD_TOKENS = 2_000_000
QUERY_TERMS = 48  # of a seed, the heaviest
K1, B = 1.2, 0.75


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            ids = [np.append(coder.encode(t.as_py()), np.array(end_id, coder.width)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "n", "ids"]
            )

    return run


def token_rows(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, ids`` of every row; ids in the narrowest little-endian type."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(_encoded(tokenizer, end_id), schema)


def term_counts(ids: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and how often each occurs, by last occurrence; ``last`` is a work array with a place for every id."""
    places = np.arange(len(ids))
    last[ids] = places
    at = last[ids]
    own = at == places
    return ids[own], np.bincount(at, minlength=len(ids))[own]


def _frequencies(width: str, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, last = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                counts[term_counts(np.frombuffer(raw.as_buffer(), width), last)[0]] += 1
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(counts[seen])], ["token", "docs"])

    return run


def inverse_frequencies(rows: DataFrame, width: str, vocabulary: int, total: int) -> np.ndarray:
    """BM25's inverse document frequency of each id, over all rows; one number per vocabulary entry."""
    counted = rows.select("ids").mapInArrow(_frequencies(width, vocabulary), "token long, docs long").groupBy("token").agg(F.sum("docs").alias("docs")).toPandas()
    docs = np.zeros(vocabulary)
    docs[counted["token"].to_numpy()] = counted["docs"].to_numpy()
    return np.log1p((total - docs + 0.5) / (docs + 0.5)).astype(np.float32)


def _routed(idf: np.ndarray, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(len(idf), np.int64)
        for batch in batches:
            heavy = np.zeros((batch.num_rows, 2), np.int32)
            for row, raw in enumerate(batch.column(1)):
                terms, tf = term_counts(np.frombuffer(raw.as_buffer(), width), last)
                weight = idf[terms] * tf / (tf + K1)
                for place in range(min(2, len(terms))):
                    best = weight.argmax()
                    heavy[row, place], weight[best] = terms[best], -np.inf
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(heavy[:, 0]), pa.array(heavy[:, 1])], ["row_no", "ids", "doc_id", "term1", "term2"])

    return run


class Index:
    """BM25 postings of one shard; a document's score is the sum over a query's terms."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.docs, self.idf = docs, idf
        lengths = np.array([len(d) for d in docs])
        owner = np.repeat(np.arange(len(docs)), lengths)
        key, tf = np.unique(np.concatenate(docs).astype(np.int64) * len(docs) + owner, return_counts=True)
        terms, self.posting = np.divmod(key, len(docs))
        norm = K1 * (1 - B + B * lengths[self.posting] / mean_length)
        self.weight = (idf[terms] * tf * (K1 + 1) / (tf + norm)).astype(np.float32)
        self.terms, first = np.unique(terms, return_index=True)
        self.bounds = np.append(first, len(terms))

    def query(self, seed: int, terms_used: int = QUERY_TERMS) -> np.ndarray:
        """Scores of all documents of the shard for a seed's heaviest terms."""
        terms, tf = np.unique(self.docs[seed], return_counts=True)
        if len(terms) > terms_used:
            terms = terms[np.argsort(-self.idf[terms] * tf / (tf + K1), kind="stable")[:terms_used]]
        at = np.searchsorted(self.terms, terms)
        spans = [slice(a, b) for a, b in zip(self.bounds[at].tolist(), self.bounds[at + 1].tolist())]
        return np.bincount(np.concatenate([self.posting[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), len(self.docs))


def fill_order(docs: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW, room: int | None = None) -> Iterator[int]:
    """Documents in the order in which they fill windows; ``room`` is what the first window has left."""
    index = Index(docs, idf, mean_length)
    unused = np.ones(len(docs), bool)
    left = window if room is None else room

    def take(doc: int, left: int) -> int:
        unused[doc] = False
        return left - len(docs[doc])

    for seed in range(len(docs)):
        if not unused[seed]:
            continue
        left = take(seed, left)
        yield seed
        if left > 0:
            scores = index.query(seed)
            scores[~unused] = 0
            near = np.flatnonzero(scores)
            for doc in near[np.argsort(-scores[near], kind="stable")].tolist():
                left = take(doc, left)
                yield doc
                if left <= 0:
                    break
        if left <= 0:
            left = window - (-left) % window


def _pack(idf: np.ndarray, width: str, mean_length: float, window: int, shard_tokens: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        state = {"sequence": 0, "offset": 0}
        open_: list[list] = []  # pieces of the sequence that isn't full yet

        def table(pieces: list[list]) -> pa.RecordBatch:
            columns = list(zip(*pieces)) or [()] * 6
            kinds = (id_type, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])

        def name() -> int:
            return (part << 32) + state["sequence"]

        def fill(keys: list, docs: list[np.ndarray]) -> list[list]:
            out: list[list] = []
            for doc in fill_order(docs, idf, mean_length, window, window - state["offset"]):
                ids, start = docs[doc], 0
                while start < len(ids):
                    stop = min(len(ids), start + window - state["offset"])
                    open_.append([keys[doc], start, ids[start:stop].astype("<u4").tobytes(), len(ids), name(), state["offset"]])
                    state["offset"] += stop - start
                    start = stop
                    if state["offset"] == window:
                        out.extend(open_)
                        open_.clear()
                        state["sequence"] += 1
                        state["offset"] = 0
            return out

        keys, docs, held = [], [], 0
        for batch in batches:
            for key, ids in zip(batch.column(0), batch.column(1)):
                keys.append(key.as_py())
                docs.append(np.frombuffer(ids.as_py(), width))
                held += len(docs[-1])
                if held >= shard_tokens:
                    yield table(fill(keys, docs))
                    keys, docs, held = [], [], 0
        out = fill(keys, docs) if docs else []
        yield table(out + _in_powers(open_, name, state))

    return run


def _in_powers(pieces: list[list], name, state: dict) -> list[list]:
    """Cut an unfilled sequence into sequences of powers of two, which take no padding."""
    left = sum(len(p[2]) // 4 for p in pieces)
    out: list[list] = []
    room = 0
    for doc, start, ids, total, _, _ in pieces:
        while ids:
            if not room:
                size = room = 1 << (left.bit_length() - 1)
            n = min(room, len(ids) // 4)
            out.append([doc, start, ids[: 4 * n], total, name(), size - room])
            ids, start, room, left = ids[4 * n :], start + n, room - n, left - n
            if not room:
                state["sequence"] += 1
    return out


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    window: int = WINDOW,
    shard_tokens: int = SHARD_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces ``doc_id, start, ids, doc_tokens, sequence_id, offset``; ``ids`` in little-endian uint32."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    path = tokenizer or default_tokenizer()
    vocabulary = max(encoder(path).vocabulary, end_id + 1)
    width = id_width(encoder(path).vocabulary)
    rows = token_rows(docs, path, end_id, id_col, text_col).withColumn("row_no", F.monotonically_increasing_id())
    rows = scratch.keep(rows, "rows")
    total, tokens = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    idf = inverse_frequencies(rows, width, vocabulary, total)
    key = rows.schema["doc_id"]
    layout = T.StructType([T.StructField("row_no", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_id", key.dataType), T.StructField("term1", T.IntegerType()), T.StructField("term2", T.IntegerType())])
    rows = scratch.keep(rows.select("row_no", "ids", "doc_id").mapInArrow(_routed(idf, width), layout), "rows")
    shards = max(1, -(-tokens // shard_tokens))
    spread = rows.repartitionByRange(shards, "term1", "term2", "row_no").sortWithinPartitions("term1", "term2", "row_no")
    schema = T.StructType(
        [
            T.StructField("doc_id", key.dataType),
            T.StructField("start", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    kind = to_arrow_type(key.dataType)
    return spread.select("doc_id", "ids").mapInArrow(_pack(idf, width, max(1.0, tokens / max(1, total)), window, shard_tokens, kind), schema)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents' ids in sequences."""
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op5_packing": op5_packing}
ORACLE_SQL: dict[str, str] = {}
