"""Media columns: FLAC streams in a binary column, decoded into PCM blocks.

``with_media`` stores a payload losslessly as 8-bit samples in a FLAC stream.
Decoding undoes Rice residuals and linear predictors and verifies both checksums
of every frame, the stream's MD5, and that every seek point leads to the frame
it names; a wrong one stops the job. It yields PCM blocks, one for each seek
point: the first sample, the byte offset from which a reader can start, and the
block's samples. ``pcm_blocks`` gives them as rows; ``read_media`` puts a
stream's blocks together where they are decoded and takes digests and features.

Defined cases: a null text counts as empty, which is stored as 192 blanks; a
null stream has no samples and null features; repeated rows give equal
streams; a very long text is one stream of many frames; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.llm import flac
from brightloom.plans.shared import Scratch

UNIT = 192
PAD = b" "
AT_ONCE = 1 << 21  # payload bytes coded together
#: How a table of streams is written: large pages, so that equal stretches of streams are found.
WRITE = {"parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)}


def padded(raw: bytes) -> bytes:
    """The bytes with blanks up to a positive multiple of the unit."""
    return raw + PAD * (-len(raw) % UNIT if raw else UNIT)


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Runs of rows whose binary values come to about ``AT_ONCE`` bytes."""
    begin, held, values = 0, 0, []
    for i, value in enumerate(batch.column(column)):
        values.append(value.as_py())
        held += len(values[-1] or b"")
        if held >= AT_ONCE or i + 1 == batch.num_rows:
            yield batch.slice(begin, i + 1 - begin), values
            begin, held, values = i + 1, 0, []


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, raw in _groups(batch, 1):
            media = flac.encode([padded(x or b"") for x in raw])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x or b"") for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every row's text as a FLAC stream."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("raw"))
    return rows.mapInArrow(_encode, T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def features(samples: np.ndarray) -> str:
    """Number, sum, energy, peak and sign changes of the signed samples."""
    x = samples.astype(np.int64) - 128
    return f"{len(x)}:{x.sum()}:{(x * x).sum()}:{np.abs(x).max(initial=0)}:{np.count_nonzero(np.diff(x < 0))}"


def stream_blocks(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """Each stream's PCM blocks: first sample, byte offset, samples; verified."""
    out = []
    for m, samples in zip(media, flac.decode(media) if media else ()):
        points, block = flac.seek_points(m), flac.block_size(m)
        for first, offset, n in points:
            found = flac.frame_at(m, offset)
            if found is None or found[0] * block != first or found[1] != n:
                raise ValueError("a seek point doesn't lead to its frame")
        starts = [first for first, _, _ in points]
        if starts[:1] != [0] and len(samples):
            raise ValueError("no seek point at the stream's start")
        out.append([(first, offset, samples[first:last]) for (first, offset, _), last in zip(points, [*starts[1:], len(samples)])])
    return out


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, media in _groups(batch, 2):
            streams = iter(stream_blocks([m for m in media if m is not None]))
            out = []
            for m in media:
                if m is None:
                    out.append((None,) * 6)
                    continue
                x = np.concatenate([pcm for _, _, pcm in next(streams)] or [np.zeros(0, np.uint8)])
                payload = x.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), features(x)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of the samples that ``doc_id, n_bytes, media`` hold."""
    schema = T.StructType(
        [
            T.StructField("doc_id", media.schema["doc_id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("payload_bytes", T.LongType()),
            T.StructField("payload_sha256", T.StringType()),
            T.StructField("tail_crc32", T.LongType()),
            T.StructField("media_bytes", T.LongType()),
            T.StructField("media_sha256", T.StringType()),
            T.StructField("feature", T.StringType()),
        ]
    )
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decode, schema)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, media in _groups(batch, 1):
            keys = [key.as_py() for key, m in zip(rows.column(0), media) if m is not None]
            out = []
            for key, blocks in zip(keys, stream_blocks([m for m in media if m is not None])):
                out += [(key, i, first, offset, len(pcm), pcm.tobytes()) for i, (first, offset, pcm) in enumerate(blocks)]
            columns = list(zip(*out)) or [()] * 6
            kinds = (rows.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "block_no", "first_sample", "byte_offset", "n_samples", "pcm"])


def pcm_blocks(media: DataFrame) -> DataFrame:
    """A row for each seek point of each stream, with the samples up to the next as unsigned bytes."""
    schema = T.StructType([T.StructField("doc_id", media.schema["doc_id"].dataType)] + [T.StructField(c, T.LongType()) for c in ("block_no", "first_sample", "byte_offset", "n_samples")] + [T.StructField("pcm", T.BinaryType())])
    return media.select("doc_id", "media").mapInArrow(_blocks, schema)


def op2_media(spark, sf_dir: str) -> DataFrame:
    """Sizes, digests and features of every document as stored in FLAC and read back."""
    media = with_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_media(Scratch(spark, "media").keep(media, "media", "zstd", WRITE))


QUERIES = {"op2_media": op2_media}
ORACLE_SQL: dict[str, str] = {}
