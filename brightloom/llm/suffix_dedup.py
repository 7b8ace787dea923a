"""Removal of repeated 100-byte strings by column-wise suffix sorting.

The collection's suffixes are sorted as in the column-wise construction of a
multi-document Burrows-Wheeler transform: one symbol of every member is
inserted a round, from the last column to the first. A round sorts the new
suffixes by their symbol, stably over the order of the round before, and takes
the common prefix of two neighbours from the least common prefix between their
places in that order. Members whose suffixes share ``length`` bytes hold the
same string.

Only suffixes of the same column are compared, so a round replaces the order
of the round before instead of growing one transform of all suffixes: over whole
documents, that would take as many rounds as the longest has bytes, each over
all that was inserted.

What makes it one Spark job instead of one suffix array of the corpus:

* Anchors. Of the 32-byte strings that begin in any window of 69, the one with
  the least hash is an anchor (all of them, where hashes tie). Equal 100-byte
  strings have equal anchors at equal offsets, so they are members of the same
  anchor's collection, as 168 bytes around it. Anchors whose hash occurs once
  in the corpus are dropped: a count with map-side combining.
* Equal surroundings are one member, the earliest; a later one repeats all of
  its strings. That is a group-by with map-side combining, so a passage that a
  third of all documents hold is one member wherever it is not at an edge.
* An anchor with more than ``HOT`` places is split by columns: a part has
  ``SPLIT`` of them and only the bytes that their strings span, so members that
  agree there are one, and it is dealt out by the bytes that all its strings
  share. A part that still has more than ``HOT`` different members is not sorted
  in one task at all: its strings are grouped, with map-side combining.
* So a task sorts whole collections of ``HOT`` members at most, ``AT_ONCE`` or
  so together. The transform's column and the common prefixes of a round are
  arrays of that size, and Spark's sorted shuffle files, read once in order, take
  the place of the sequential external files.

Order is by id, then row, then place; a null id comes first. Every byte that a
repeated string covers goes; strings are judged on the input.

Defined cases: null and empty texts, and texts of less than 100 bytes, lose
nothing; of repeated rows the first in the scan's order keeps its bytes; a very
long text is read in pieces that overlap; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.plans.shared import Scratch

LENGTH = 100
GRAM = 32
WINDOW = LENGTH - GRAM + 1  # grams in a string
SIDE = LENGTH - GRAM  # bytes on either side of an anchor's gram
COLUMNS = LENGTH + SIDE
HOT = 16_384  # places of an anchor, or members of a part of one, that a task sorts at most
SPLIT = 9  # columns of a part of a hot anchor
AT_ONCE = 8192  # members that are sorted together, up to the end of a collection
EMITTED = 16_384  # members that leave a task at once
PIECE = 1 << 21  # bytes of a text whose anchors are looked for at a time


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the ``GRAM`` bytes from every place, by doubling."""
    h, factor, size = raw.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while size < GRAM:
            h = h[:-size] * factor + h[size:]
            factor, size = factor * factor, 2 * size
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum over every window of ``width``."""
    take, size = (np.minimum if least else np.maximum), 1
    while 2 * size <= width:
        x = take(x[:-size], x[size:])
        size *= 2
    return take(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's anchors and their hashes, signed."""
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = PIECE - LENGTH + 1
    for start in range(0, max(1, len(text) - LENGTH + 1), step):
        raw = np.frombuffer(text, np.uint8, min(PIECE, len(text) - start), start)
        if len(raw) < LENGTH:
            break
        h = _gram_hashes(raw)
        least = _slide(h, WINDOW, True)
        # A gram is an anchor if it is the least of some window that it begins in.
        edge = np.zeros(WINDOW - 1, np.uint64)
        at = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), WINDOW, False) == h)
        places.append(at + start)
        hashes.append(h[at].view(np.int64))
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[first]


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, hashes, places = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            at, h = anchors(text.as_py())
            keys.append(np.full(len(at), key, np.int64))
            hashes.append(h)
            places.append(at)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hashes, keys, places)], ["h", "row_no", "at"])


PARTS = [(j, min(j + SPLIT, WINDOW)) for j in range(0, WINDOW, SPLIT)]  # columns of each part, the end exclusive


def _fixed_binary(grid: np.ndarray) -> pa.Array:
    """A row of bytes each as a binary value."""
    offsets = np.arange(len(grid) + 1, dtype=np.int32) * grid.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(grid), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(grid).tobytes())])


def _emit_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surroundings of a text's shared anchors; ``low`` and ``high`` bound what the text, or a part, has of them."""
    names = ["h", "part", "around", "low", "high", "doc_id", "row_no", "at"]
    edge = np.zeros(SIDE, np.uint8)
    for batch in batches:
        lists = batch.column(2)
        found = lists.flatten()
        h, at, hot = (found.field(c).to_numpy(zero_copy_only=False) for c in ("h", "at", "hot"))
        sizes = lists.value_lengths().to_numpy()
        out: list[tuple] = []

        def table(out: list[tuple]) -> pa.RecordBatch:
            h, part, grid, low, high, row, at = map(np.concatenate, zip(*out))
            columns = [pa.array(h), pa.array(part.astype(np.int32)), _fixed_binary(grid), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), batch.column(3).take(pa.array(row)), batch.column(0).take(pa.array(row)), pa.array(at)]
            return pa.RecordBatch.from_arrays(columns, names)

        held, last = 0, 0
        for row, (text, size) in enumerate(zip(batch.column(1), sizes.tolist())):
            raw = np.frombuffer(text.as_buffer(), np.uint8)
            around = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, raw, edge]), COLUMNS)
            first, last = last, last + size
            for begin in range(first, last, EMITTED):
                some = slice(begin, min(last, begin + EMITTED))
                low, high = np.maximum(0, SIDE - at[some]), np.minimum(COLUMNS, len(raw) - at[some] + SIDE)
                for part, (left, right) in enumerate([(0, WINDOW), *PARTS] if hot[some].any() else [(0, WINDOW)], -1):
                    lo, hi = np.maximum(low, left), np.minimum(high, right - 1 + LENGTH)
                    mine = np.flatnonzero((hot[some] == (part >= 0)) & (hi - lo >= LENGTH))
                    grid = around[at[some][mine]]
                    grid[:, :left] = 0
                    grid[:, right - 1 + LENGTH :] = 0
                    out.append((h[some][mine], np.full(len(mine), part), grid, lo[mine], hi[mine], np.full(len(mine), row), at[some][mine]))
                    held += len(mine)
                if held >= EMITTED:
                    yield table(out)
                    out, held = [], 0
        if held:
            yield table(out)


def repeated_strings(members: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of the ``WINDOW`` strings of each member an earlier member has at the same column.

    Members stand in order. Columns are inserted from the last to the first.
    """
    m = len(members)
    repeated = np.zeros((m, WINDOW), bool)
    order = np.arange(m)
    lcp = np.zeros(m, np.int32)  # with the neighbour before; nothing is inserted yet
    columns = np.ascontiguousarray(members.T)
    for j in range(COLUMNS - 1, -1, -1):
        symbols = columns[j][order]  # the transform's column: what precedes the suffixes, in their order
        step = np.argsort(symbols, kind="stable")
        same = np.zeros(m, bool)
        same[1:] = symbols[step[1:]] == symbols[step[:-1]]
        # Least common prefix between the places of two neighbours in the order before.
        levels, span = [lcp], 1
        while 2 * span < m + 1:
            x = levels[-1].copy()
            x[: m - span] = np.minimum(x[: m - span], x[span:])
            levels.append(x)
            span *= 2
        left, right = step[:-1] + 1, step[1:]
        inside = np.maximum(right - left + 1, 1)
        depth = np.frexp(inside.astype(np.float64))[1] - 1
        table = np.stack(levels)
        depth = np.minimum(depth, len(levels) - 1)
        least = np.minimum(table[depth, np.minimum(left, m - 1)], table[depth, np.maximum(right - (1 << depth) + 1, 0)])
        grown = np.zeros(m, np.int32)
        grown[1:] = np.where(same[1:], least + 1, 0)
        order, lcp = order[step], np.minimum(grown, COLUMNS)
        if j >= WINDOW:
            continue
        # Runs of suffixes that share LENGTH bytes; of each, the earliest member keeps the string.
        run = np.cumsum(lcp < LENGTH) - 1
        whole = (low[order] <= j) & (high[order] >= j + LENGTH)
        first = np.full(int(run[-1]) + 1, m, np.int64)
        np.minimum.at(first, run[whole], order[whole])
        repeated[order, j] = whole & (first[run] < order)
    return repeated


def _as_bits(repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The flags of the columns as two signed 64-bit numbers, the lowest bit first."""
    wide = np.zeros((len(repeated), 128), bool)
    wide[:, :WINDOW] = repeated
    both = np.packbits(wide, axis=1, bitorder="little").view("<i8")
    return both[:, 0], both[:, 1]


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members sorted by collection and order -> the strings of each that occur before, as bits."""

    def sort_out(rows: pa.RecordBatch) -> pa.RecordBatch:
        around = rows.column("around")
        begin = int(np.frombuffer(around.buffers()[1], np.int32)[around.offset])
        grid = np.frombuffer(around.buffers()[2], np.uint8, len(rows) * COLUMNS, begin).reshape(-1, COLUMNS)
        repeated = repeated_strings(grid, rows.column("low").to_numpy(), rows.column("high").to_numpy())
        return pa.RecordBatch.from_arrays([rows.column("row_no"), rows.column("at"), rows.column("part"), *map(pa.array, _as_bits(repeated))], ["row_no", "at", "part", "bits", "more"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < AT_ONCE:
            continue
        rows = pa.concat_batches(held)
        keys = [rows.column(c).to_numpy() for c in ("h", "part", "route")]
        turns = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        done = int(turns[-1]) if len(turns) else 0  # the last collection may go on
        if done:
            yield sort_out(rows.slice(0, done))
        held = [rows.slice(done)]
    if held and sum(map(len, held)):
        yield sort_out(pa.concat_batches(held))


def _covered(at: np.ndarray, part: np.ndarray, solved: np.ndarray, bits: np.ndarray, size: int) -> np.ndarray:
    """Bytes of a text that a repeated string covers; an unsolved member repeats all strings of its columns."""
    repeated = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, :WINDOW].astype(bool)
    bounds = np.array([(0, WINDOW), *PARTS])[part + 1]
    j = np.arange(WINDOW)
    repeated |= ~solved[:, None] & (j >= bounds[:, :1]) & (j < bounds[:, 1:])
    starts = ((at - SIDE)[:, None] + j)[repeated]
    starts = starts[(starts >= 0) & (starts + LENGTH <= size)]
    edges = np.bincount(starts, minlength=size + 1) - np.bincount(starts + LENGTH, minlength=size + 1)
    return np.cumsum(edges[:size]) > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        lists = batch.column(3)
        found = lists.flatten()
        at, part = (found.field(c).to_numpy() for c in ("at", "part"))
        solved = found.field("bits").is_valid().to_numpy(zero_copy_only=False)
        bits = np.stack([found.field(c).fill_null(0).to_numpy() for c in ("bits", "more")], axis=1)
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
        sizes, removed, spans, kept = [], [], [], []
        for row, (text, last) in enumerate(zip(batch.column(2), ends.tolist())):
            raw = np.frombuffer(text.as_buffer(), np.uint8)
            mine = slice(int(ends[row - 1]) if row else 0, last)
            gone = _covered(at[mine], part[mine], solved[mine], bits[mine], len(raw))
            turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
            sizes.append(len(raw))
            removed.append(int(gone.sum()))
            spans.append([{"start": a, "end": b} for a, b in turns.tolist()])
            kept.append(raw[~gone].tobytes() if len(turns) else text.as_py())
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def _by_strings(members: DataFrame, scratch: Scratch) -> DataFrame:
    """``row_no, at, part, bits, more`` of members too many for one task: equal strings are grouped."""
    span = F.sequence("low", F.col("high") - LENGTH)
    strings = members.select("h", "o", "part", F.explode(span).alias("j"), "around").select("h", "o", "part", "j", F.substring("around", F.col("j") + 1, F.lit(LENGTH)).alias("s"))
    firsts = scratch.keep(strings.groupBy("h", "j", "s").agg(F.min("o").alias("first")), "firsts")
    later = (F.col("first") < F.col("o")).cast("long")
    low, high = F.when(F.col("j") < 64, later).otherwise(0), F.when(F.col("j") >= 64, later).otherwise(0)
    found = strings.join(firsts, ["h", "j", "s"]).groupBy("o", "part").agg(
        F.bit_or(F.call_function("shiftleft", low, F.pmod("j", F.lit(64)))).alias("bits"),
        F.bit_or(F.call_function("shiftleft", high, F.pmod("j", F.lit(64)))).alias("more"),
    )
    return found.select("o.row_no", "o.at", "part", "bits", "more")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` for every row; ``kept`` are the remaining bytes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    # Numbered once and stored: another scan may split the input elsewhere and number its rows otherwise.
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"), raw.alias("raw"))
    rows = scratch.keep(rows, "rows", "zstd")
    found = rows.select("row_no", "raw").mapInArrow(_emit_anchors, "h long, row_no long, at long")
    shared = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", (F.col("n") > HOT).alias("hot"))
    shared = scratch.keep(shared, "shared")
    mine = found.join(shared, "h")
    mine = scratch.keep(mine.groupBy("row_no").agg(F.collect_list(F.struct("h", "at", "hot")).alias("found")), "mine")  # one document's anchors
    # One table from here on; joined and written, so that texts and surroundings do not lie in two shuffles at once.
    rows = scratch.keep(rows.join(mine, "row_no", "left").select("row_no", "raw", "found", "doc_id"), "joined", "zstd")
    scratch.drop("shared", "rows", "mine")

    kind = rows.schema["doc_id"].dataType
    integer, long = T.IntegerType(), T.LongType()
    layout = T.StructType([T.StructField(c, k) for c, k in (("h", long), ("part", integer), ("around", T.BinaryType()), ("low", integer), ("high", integer), ("doc_id", kind), ("row_no", long), ("at", long))])
    members = rows.where(F.col("found").isNotNull()).mapInArrow(_emit_members, layout)
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "row_no", "at")).alias("o")
    # The bytes that all strings of a part share deal it out; the whole collection of a rare anchor stays together.
    left = F.col("part") * SPLIT
    right = F.least(left + SPLIT, F.lit(WINDOW))
    route = F.when(F.col("part") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.substring("around", right, left + LENGTH + 1 - right)))
    members = members.groupBy("h", "part", "around", "low", "high").agg(first).withColumn("route", route)
    members = scratch.keep(members, "members", "zstd")
    large = members.where("part >= 0").groupBy("h", "part", "route").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).drop("n")
    large = scratch.keep(large, "large")
    keys = ["h", "part", "route"]
    split = not large.isEmpty()
    some = members.join(large, keys, "left_anti") if split else members
    ordered = some.repartition(*keys).sortWithinPartitions(*keys, "o")
    solved = ordered.select(*keys, "around", "low", "high", "o.row_no", "o.at").mapInArrow(_resolve, "row_no long, at long, part int, bits long, more long")
    if split:
        solved = solved.unionByName(_by_strings(members.join(large, keys, "left_semi"), scratch))
    solved = scratch.keep(solved, "solved")
    scratch.drop("members", "large", "firsts")
    parts = F.when(F.col("f.hot"), F.sequence(F.lit(0), F.lit(len(PARTS) - 1))).otherwise(F.array(F.lit(-1)))
    anchors_of = rows.select("row_no", F.explode("found").alias("f")).select("row_no", F.col("f.at").alias("at"), F.explode(parts).alias("part"))
    bits = anchors_of.join(solved, ["row_no", "at", "part"], "left").groupBy("row_no").agg(F.collect_list(F.struct("at", "part", "bits", "more")).alias("found"))
    whole = rows.drop("found").join(scratch.keep(bits, "bits"), "row_no", "left").select("row_no", "doc_id", "raw", "found")
    scratch.drop_all_but("joined", "bits")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    return whole.mapInArrow(_cut, schema)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What every document loses to strings that occur before, and the digest of what stays."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
