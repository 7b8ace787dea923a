"""Alignment of two tokenizers' tokens by their bytes.

Tokenizer A is byte-level BPE and encodes a space and the text; tokenizer B is
a sentencepiece model, which adds that space itself. A string of labels has one
label for each byte: 0 where no token ends, 1 where a token of A ends, 2 where
one of B ends, 3 where both do. A regular expression takes spans up to each 3;
the labels that a span holds count its tokens, so spans are the groups. Every
label but 0 also ends a stretch that one token of A and one of B share: a link.

* Both tokenizers start a new token at a space that follows a character which
  is not white space. A worker labels the units between such places, keeps what
  it found for those it has met, up to a bound, and joins units to texts.
* Links are counted twice before they are shuffled: in a batch of texts
  (``batch_bytes``), where a batch's distinct pairs get numbers, and by Spark
  over batches. What a pair counts over the corpus comes back to each batch
  once for each of its distinct pairs, not once a document, and the documents'
  sums are made there. No table goes to the driver or is broadcast.

Defined cases: null and empty texts, and texts whose tokens don't join to the
bytes of space and text (such as texts with U+2581), have no tokens; null and
repeated ids are kept row by row; a long text is a batch of its own; pairs of
equal count are all the highest; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from brightloom.llm.tokens import _byte_letters
from brightloom.plans.shared import Scratch

BATCH_BYTES = 4 << 20  # of text whose distinct pairs are counted together
CACHED_UNITS = 1 << 19
LONGEST_CACHED = 64  # characters
TOGETHER = 4096  # new units that are labelled as one string
TEXTS_AT_ONCE = 1 << 18  # characters of texts whose new units are looked for together
#: White space, and whatever some table of characters takes for it: a space after one of these starts no unit.
_BLANK = "\\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
_ODD_SPACE = re.compile(f"(?:^|[{_BLANK}]) ")
_UNIT_START = re.compile(f"(?<![{_BLANK}])(?= )")
_BLANK_END = re.compile(f"[{_BLANK}]$")
_SPAN = re.compile(b"[\x00-\x02]*\x03")
_PROBE = "a  b\t\n \ufb01 \u00c5 \uff21 a\u0301 "


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def label_string(size: int, ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The label of each of ``size`` bytes, from where the tokens of A and of B end."""
    labels = np.zeros(size, np.uint8)
    labels[ends_a - 1] |= 1
    labels[ends_b - 1] |= 2
    return labels


def group_counts(labels: bytes) -> list[tuple[int, int]]:
    """How many tokens of A and of B each group has."""
    return [(span.count(1) + 1, span.count(2) + 1) for span in _SPAN.findall(labels)]


class Unit(NamedTuple):
    """A unit's groups as text, and its links as one number each."""

    groups: str
    links: bytes
    n_a: int
    n_b: int
    n_groups: int


class Aligner:
    """Aligns texts under two tokenizer files."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {c: i for i, c in enumerate(_byte_letters())}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b)]
        self.width = len(pieces)
        self.names = list(map(str, range(max(len(self.bytes_a), self.width))))
        self.first = self.b.encode("a")
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        apart = not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        kept = b"".join(self.bytes_b[i] for i in self.b.encode(_PROBE)) == b" " + _PROBE.encode()
        self.in_units = bool(apart and kept and not any(re.search("[^\u2581]\u2581", p) for p in pieces))
        self.met: dict[str, Unit | None] = {}

    def _labelled(self, units: list[str], b: list[int]) -> list[Unit] | None:
        """Units that follow each other, each with a space first; None if tokens don't join to them."""
        raws = [u.encode() for u in units]
        raw = b"".join(raws)
        a = self.a.encode_batch_fast(["".join(units)], add_special_tokens=False)[0].ids  # no offsets
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        ids_a, ids_b = np.array(a), np.array(b)
        ends_a, ends_b = np.cumsum(self.sizes[0][ids_a]), np.cumsum(self.sizes[1][ids_b])
        labels = label_string(len(raw), ends_a, ends_b)
        ends = np.cumsum(list(map(len, raws)))
        if (labels[ends - 1] != 3).any():
            return None
        told, i, j = [], 0, 0
        names_a, names_b = [self.names[x] for x in a], [self.names[x] for x in b]
        for x, y in group_counts(labels.tobytes()):
            told.append(f"{names_a[i]}|{names_b[j]}" if x == y == 1 else ",".join(names_a[i : i + x]) + "|" + ",".join(names_b[j : j + y]))
            i, j = i + x, j + y
        at = np.flatnonzero(labels)
        links = (ids_a[np.searchsorted(ends_a, at + 1)] * self.width + ids_b[np.searchsorted(ends_b, at + 1)]).astype("<i8").tobytes()
        # What each unit has of links, groups and tokens.
        upto = [np.searchsorted(x, ends, "right").tolist() for x in (at + 1, np.flatnonzero(labels == 3) + 1, ends_a, ends_b)]
        found, l, g, n, m = [], 0, 0, 0, 0
        for l2, g2, n2, m2 in zip(*upto):
            found.append(Unit(";".join(told[g:g2]), links[8 * l : 8 * l2], n2 - n, m2 - m, g2 - g))
            l, g, n, m = l2, g2, n2, m2
        return found

    def _in_a_row(self, units: list[str]) -> list[Unit] | None:
        # Behind a letter, so that the model adds no space of its own.
        return self._labelled(units, self.b.encode("a" + "".join(units))[len(self.first) :])

    def _meet(self, names: list[str]) -> dict[str, Unit | None]:
        """Units that were not met before; those that don't end with a blank follow each other."""
        found: dict[str, Unit | None] = {}
        solid = [n for n in names if not _BLANK_END.search(n)]
        for start in range(0, len(solid), TOGETHER):
            some = solid[start : start + TOGETHER]
            found |= dict(zip(some, self._in_a_row(some) or ()))
        for name in names:
            if name not in found:
                found[name] = (self._in_a_row([name]) or [None])[0]
        return found

    def units(self, texts: list[str]) -> list[list[Unit] | None]:
        """The units of each text in order; None for a text without tokens."""
        if not self.in_units:
            return [self._labelled([" " + t], self.b.encode(t)) if t else None for t in texts]
        if len(self.met) > CACHED_UNITS:
            self.met.clear()
        names = [[] if not t else [u for u in _UNIT_START.split(" " + t) if u] if _ODD_SPACE.search(t) else [" " + w for w in t.split(" ")] for t in texts]
        met = self.met
        new = self._meet([n for n in dict.fromkeys(n for of in names for n in of) if n not in met])
        met.update(new)
        found = [[met[n] for n in of] for of in names]
        for n in new:
            if len(n) > LONGEST_CACHED:
                del met[n]
        return [None if not of or None in of else of for of in found]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    """The worker's aligner of two tokenizer files."""
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _batch_schema(id_type: T.DataType) -> T.StructType:
    longs = T.ArrayType(T.LongType())
    fields = [("batch", T.LongType()), ("doc_ids", T.ArrayType(id_type)), *((c, longs) for c in COUNTS), ("shas", T.ArrayType(T.StringType()))]
    fields += [("cells", longs), ("places", T.BinaryType()), ("times", T.BinaryType()), ("pairs", longs), ("sums", longs)]
    return T.StructType([T.StructField(*f) for f in fields])


def _with_units(coder: Aligner, batch: pa.RecordBatch) -> Iterator[tuple]:
    """Each row's id and units."""
    keys, texts, held = [], [], 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        keys.append(key)
        texts.append(text.as_py())
        held += len(texts[-1])
        if held >= TEXTS_AT_ONCE:
            yield from zip(keys, coder.units(texts))
            keys, texts, held = [], [], 0
    yield from zip(keys, coder.units(texts))


def _batched(paths: tuple[str, str], id_type: T.DataType, batch_bytes: int):
    arrow_id = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, coder = TaskContext.get().partitionId() << 33, 0, aligner(paths)

        def row(ids: list, counts: list[tuple], shas: list[str], links: list[bytes]) -> pa.RecordBatch:
            n = np.array([c[3] for c in counts])
            pairs, number, sums = np.unique(np.frombuffer(b"".join(links), "<i8"), return_inverse=True, return_counts=True)
            cells, times = np.unique(np.repeat(np.arange(len(ids)), n) * max(1, len(pairs)) + number, return_counts=True)
            held = np.bincount(cells // max(1, len(pairs)), minlength=len(ids))
            lists = [pa.array([list(x)], pa.list_(pa.int64())) for x in zip(*counts)]
            rest = [(cells % max(1, len(pairs))).astype("<i4").tobytes(), times.astype("<i4").tobytes()]
            columns = [pa.array([base + made]), pa.array([ids], pa.list_(arrow_id)), *lists, pa.array([shas], pa.list_(pa.string())), pa.array([held], pa.list_(pa.int64()))]
            columns += [pa.array([x], pa.binary()) for x in rest] + [pa.array([x], pa.list_(pa.int64())) for x in (pairs, sums)]
            return pa.RecordBatch.from_arrays(columns, _batch_schema(id_type).names)

        ids, counts, shas, links, held = [], [], [], [], 0
        for batch in batches:
            for key, units in _with_units(coder, batch):
                ids.append(key)
                if units is None:
                    counts.append((0, 0, 0, 0))
                    shas.append("")
                    links.append(b"")
                else:
                    links.append(b"".join([u.links for u in units]))
                    counts.append((sum([u.n_a for u in units]), sum([u.n_b for u in units]), sum([u.n_groups for u in units]), len(links[-1]) // 8))
                    shas.append(hashlib.sha256(";".join([u.groups for u in units]).encode()).hexdigest())
                held += 16 + len(links[-1]) // 4
                if held >= batch_bytes:
                    yield row(ids, counts, shas, links)
                    ids, counts, shas, links, held, made = [], [], [], [], 0, made + 1
        if ids:
            yield row(ids, counts, shas, links)

    return run


def _summed(id_type: T.DataType):
    arrow_id = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            places, times = np.frombuffer(row["places"], "<i4"), np.frombuffer(row["times"], "<i4").astype(np.int64)
            totals, best = np.array(row["totals"] or [0], np.int64), np.array(row["best"] or [False])
            ends = np.concatenate([[0], np.cumsum(np.array(row["cells"], np.int64))])
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (times * best[places], times * totals[places])]
            columns = [pa.array(row["doc_ids"], arrow_id), *(pa.array(row[c], pa.int64()) for c in COUNTS)]
            columns += [pa.array(x[ends[1:]] - x[ends[:-1]]) for x in sums]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row["shas"], pa.string())], ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _batch_table(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, paths: tuple[str, str], batch_bytes: int) -> DataFrame:
    id_type = docs.schema[id_col].dataType
    return scratch.keep(_texts(docs, id_col, text_col).mapInArrow(_batched(paths, id_type, batch_bytes), _batch_schema(id_type)), "batches", "zstd", {"parquet.block.size": str(16 << 20)})


def _pair_counts(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``batch, pair, n`` of each batch, and ``pair, total`` over all."""
    pairs = batches.select("batch", F.explode(F.arrays_zip("pairs", "sums")).alias("x")).select("batch", F.col("x.pairs").alias("pair"), F.col("x.sums").alias("n"))
    return pairs, pairs.groupBy("pair").agg(F.sum("n").alias("total"))


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``a_id, b_id, links``: how many links of the corpus hold each pair of ids."""
    paths = tokenizers or default_tokenizers()
    width = aligner(paths).width
    _, totals = _pair_counts(_batch_table(docs, Scratch(docs.sparkSession, "links"), id_col, text_col, paths, batch_bytes))
    return totals.select(F.floor(F.col("pair") / width).cast("int").alias("a_id"), (F.col("pair") % width).cast("int").alias("b_id"), F.col("total").alias("links"))


def token_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """``doc_id, groups`` of every row: arrays of the groups' ids of A and B, empty without tokens."""
    paths = tokenizers or default_tokenizers()
    cells = T.ArrayType(T.IntegerType())
    groups = T.ArrayType(T.StructType([T.StructField("a", cells), T.StructField("b", cells)]))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("groups", groups)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = aligner(paths)
        for batch in batches:
            found = []
            for _, units in _with_units(coder, batch):
                pairs = [g.split("|") for u in units or [] for g in u.groups.split(";")]
                found.append([{"a": list(map(int, a.split(","))), "b": list(map(int, b.split(",")))} for a, b in pairs])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, to_arrow_type(groups))], ["doc_id", "groups"])

    return _texts(docs, id_col, text_col).mapInArrow(run, schema)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    paths = tokenizers or default_tokenizers()
    width = aligner(paths).width
    scratch = Scratch(docs.sparkSession, "alignment")
    id_type = docs.schema[id_col].dataType
    batches = _batch_table(docs, scratch, id_col, text_col, paths, batch_bytes)
    pairs, totals = _pair_counts(batches)
    totals = scratch.keep(totals, "totals")
    of_b = Window.partitionBy(F.col("pair") % width)  # as many rows as A has ids, at most
    totals = scratch.keep(totals.withColumn("best", F.col("total") == F.max("total").over(of_b)), "ranked")
    told = scratch.keep(pairs.join(totals, "pair").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("pair", "total", "best"))).alias("x")), "told", "zstd")
    told = told.select("batch", F.col("x.total").alias("totals"), F.col("x.best").alias("best"))
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(c, T.LongType()) for c in (*COUNTS, "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])
    return batches.drop("pairs", "sums").join(told, "batch", "left").mapInArrow(_summed(id_type), schema)


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """Token groups and links of every document under two tokenizers."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_alignment": op11_alignment}
ORACLE_SQL: dict[str, str] = {}
