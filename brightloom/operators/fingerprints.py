"""64-bit hashes that close contents share most bits of, as 16 hex digits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.functions import text as X

WORDS_KEPT = 1 << 18
WORDS_AT_ONCE = 1 << 14
LANES = 32  # bits counted by one sum each; a sum counts two of them, 32 bits apart


def _lane_mask() -> Column:
    return F.lit((1 << 32) | 1)


def _votes(bits: Column) -> list[Column]:
    """Sums that count the ones of 64 bits over rows, two bits in a sum."""
    return [F.sum(F.shiftrightunsigned(bits, i).bitwiseAND(_lane_mask())).alias(f"v{i}") for i in range(LANES)]


def _decisions(at_least: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            bits = np.zeros(len(n), np.uint64)
            for i in range(LANES):
                votes = batch.column(f"v{i}").fill_null(0).to_numpy()
                for ones, at in ((votes >> 32, i + 32), (votes & ((1 << 32) - 1), i)):
                    bits |= (2 * ones >= n if at_least else 2 * ones > n).astype(np.uint64) << np.uint64(at)
            digits = bits.astype(">u8").tobytes().hex().encode()
            told = pa.StringArray.from_buffers(len(n), pa.py_buffer(np.arange(0, 16 * len(n) + 1, 16, dtype=np.int32)), pa.py_buffer(digits))
            keys = batch.schema.names[: -LANES - 1]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), batch.column("n"), told], [*keys, "n", "h"])

    return run


def votes(rows: DataFrame, keys: list[str], bits: str) -> DataFrame:
    """``keys, n`` and the sums that count a group's ones; each task sends one row a group."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *_votes(F.col(bits)))


def votes_together(counted: DataFrame, keys: list[str]) -> DataFrame:
    """The votes of larger groups out of those of smaller ones."""
    return counted.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(LANES)])


def decided(counted: DataFrame, keys: list[str], name: str = "h", at_least: bool = False) -> DataFrame:
    """``keys, n`` and the bits that more than half (or at least half) of a group's numbers have, as hex."""
    # In Python, since the code that Spark makes of 64 comparisons in one expression is too long to be compiled.
    rows = counted.select(*keys, "n", *[f"v{i}" for i in range(LANES)])
    schema = T.StructType([*rows.schema.fields[: len(keys) + 1], T.StructField("h", T.StringType())])
    return rows.mapInArrow(_decisions(at_least), schema).withColumnRenamed("h", name)


def majority(rows: DataFrame, keys: list[str], bits: str, name: str = "h", at_least: bool = False) -> DataFrame:
    """The majority bits of each group's 64-bit numbers."""
    return decided(votes(rows, keys, bits), keys, name, at_least)


def hex_bits(h: Column) -> Column:
    """16 hex digits as a signed 64-bit number; null for any other string."""
    halves = [F.conv(F.substring(h, at, 8), 16, 10).cast("long") for at in (1, 9)]
    return F.when(F.regexp_like(h, F.lit("^[0-9a-fA-F]{16}$")), F.shiftleft(halves[0], 32).bitwiseOR(halves[1]))


class _Digests(dict):
    """First 8 bytes of the MD5 of words met so far."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = digest = hashlib.md5(word, usedforsecurity=False).digest()[:8]
        return digest


def _ones(digests: bytes) -> np.ndarray:
    """How many of the 8-byte digests have each of 64 bits, the highest first."""
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    return sum((np.unpackbits(rows[at : at + WORDS_AT_ONCE], axis=1).sum(axis=0, dtype=np.int64) for at in range(0, len(rows), WORDS_AT_ONCE)), np.zeros(64, np.int64))


def _ones_of_stretches(digests: list[bytes], begins: list[int]) -> np.ndarray:
    """The same for each stretch of the digests, by where it begins; none is empty."""
    if len(digests) > WORDS_AT_ONCE:
        return np.array([_ones(b"".join(digests[begin:end])) for begin, end in zip(begins, [*begins[1:], len(digests)])])
    rows = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    return np.add.reduceat(np.unpackbits(rows, axis=1), begins, axis=0, dtype=np.int64)


def _text_votes(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = _Digests()
        for batch in batches:
            at, part, n, ones = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                words = X.ascii_words(text.as_py())
                edges = [-(-p * len(words) // parts) for p in range(parts + 1)]
                some = [p for p in range(parts) if edges[p + 1] > edges[p]]
                at += [i] * len(some)
                part += some
                n += [edges[p + 1] - edges[p] for p in some]
                if some:
                    ones.append(_ones_of_stretches(list(map(digests.__getitem__, words)), [edges[p] for p in some]))
            if at:
                ones = np.concatenate(ones)
                lanes = [pa.array(ones[:, 63 - i] + (ones[:, 31 - i] << 32)) for i in range(LANES)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(part, pa.int32()), pa.array(n, pa.int64()), *lanes], ["id", "part", "n", *(f"v{i}" for i in range(LANES))])

    return run


def word_votes(rows: DataFrame, id_col: str, text_col: str, parts: int = 1) -> DataFrame:
    """``id, part, n`` and the votes of the words' MD5 in each of ``parts`` equal stretches of a text's words, none for an empty one.

    Words vote in the task that reads their text; rows of one id vote together.
    """
    told = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = [("part", T.IntegerType()), *((c, T.LongType()) for c in ("n", *(f"v{i}" for i in range(LANES))))]
    schema = T.StructType([T.StructField("id", told.schema["id"].dataType), *(T.StructField(*f) for f in fields)])
    return votes_together(told.mapInArrow(_text_votes(parts), schema), ["id", "part"])


def word_hashes(rows: DataFrame, id_col: str, text_col: str, parts: int = 1) -> DataFrame:
    """``id, part, n, h``: a hash for each stretch; a bit is set when most words of the stretch have it in their MD5."""
    return decided(word_votes(rows, id_col, text_col, parts), ["id", "part"])
