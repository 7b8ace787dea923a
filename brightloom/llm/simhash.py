"""SimHash near-deduplication by meet-in-the-middle ball hashing.

Words are the runs between ASCII white space, ``A-Z`` in lower case; a
shingle is three words (all words of a shorter text) joined by spaces, repeats
included; its hash is XXH64 with seed 42. A fingerprint bit is set when more
than half of the hashes have it.

Linking distinct fingerprints at radius 3:

* Every fingerprint emits all variants within one flip; the variants are
  shuffled. Two fingerprints at distance 2 or less meet in a bucket. A bucket
  lies within one flip of its key, so it holds at most 65 fingerprints that are
  all linked to each other, and each links to the least of them.
* Three is odd, so half of it is not a whole number of flips. One of three bit
  blocks is masked in turn. At distance 3 some block holds a differing bit;
  with it masked, at most 2 differing bits remain, and one flip on either side
  meets again. Only buckets that join two components found so far are looked
  at, and their pairs are verified on all 64 bits.

Both steps find every pair they have to; no bucket is capped.

Defined cases: null and empty texts, and texts of white space, have
fingerprint zero and are linked like any other; rows with a null id keep their
component, whose id is the least id that is not null (null when there is
none); repeated rows are repeated in the result; a very long text is hashed
whole, a slice of its shingles at a time; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.llm.near_dups import one_of_each
from brightloom.operators.components import connected_components
from brightloom.plans.shared import Scratch

SHINGLE_WORDS = 3
SEED = 42
BITS = 64
EMITTERS = 20_000  # fingerprints that one task emits variants of
AT_ONCE = 1 << 16  # shingles hashed before their bits are counted
BLOCKS = ((0, 21), (21, 42), (42, 64))


def fingerprint(text: bytes | None, width: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text in UTF-8, unsigned."""
    words = (text or b"").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    total = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, AT_ONCE):
        stop = min(total, start + AT_ONCE)
        part = words[start : stop + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
        hashes = np.fromiter((digest(s, SEED) for s in shingles), "<u8", stop - start)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, raw, sha = batch.columns
        found = np.fromiter((fingerprint(x.as_py()) for x in raw), np.uint64, len(raw)).view(np.int64)
        yield pa.RecordBatch.from_arrays([ids, sha, pa.array(found)], ["doc_id", "text_sha256", "fp"])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_sha256, fp`` (signed 64-bit) of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("raw"))
    rows = rows.withColumn("sha", F.sha2("raw", 256))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("text_sha256", T.StringType()), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(_fingerprints, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ball() -> list[int]:
    """What to xor for all variants within one flip."""
    return [0] + [_signed(1 << i) for i in range(BITS)]


def _spread(fps: DataFrame) -> DataFrame:
    """Fingerprints over enough tasks: each becomes over a hundred rows in the task that emits its variants."""
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() // EMITTERS))
    return fps.repartition(tasks, "fp")


def _near_links(fps: DataFrame) -> DataFrame:
    """Edges that connect all fingerprints at distance 2 or less."""
    flips = F.array(*[F.lit(x).cast("long") for x in _ball()])
    variants = _spread(fps).select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("key"))
    # A key's bucket has 65 members at most, whatever the data.
    least = variants.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("key")).alias("b"))
    return least.where("a <> b").distinct()


def _xor_with(base):
    return lambda x: base.bitwiseXOR(x)


def _masked(fp) -> F.Column:
    """Keys of a fingerprint with each block masked in turn and one of the other bits flipped, or none."""
    parts = []
    for tag, (low, high) in enumerate(BLOCKS, 1):
        mask = ((1 << high) - 1) ^ ((1 << low) - 1)
        base = fp.bitwiseAND(F.lit(_signed(~mask & (1 << 64) - 1))).bitwiseOR(F.lit(tag << low))
        flips = F.array(*[F.lit(_signed(x)).cast("long") for x in [0] + [1 << i for i in range(BITS) if not low <= i < high]])
        parts.append(F.transform(flips, _xor_with(base)))
    return F.concat(*parts)


def _far_links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges between components ``comp`` of ``fps(fp, comp)`` that a pair at distance 3 joins."""
    keyed = _spread(fps).select("fp", "comp", F.explode(_masked(F.col("fp"))).alias("key"))
    # One shuffle serves both to find the buckets of several components and to keep their rows.
    bucket = Window.partitionBy("key")
    mixed = keyed.select("key", "fp", "comp", F.min("comp").over(bucket).alias("lo"), F.max("comp").over(bucket).alias("hi")).where("lo <> hi")
    met = scratch.keep(mixed.select("key", "fp", "comp"), "met")
    left, right = met.alias("x"), met.alias("y")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= 3
    return left.join(right, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")) & near).select(F.col("y.comp").alias("a"), F.col("x.comp").alias("b")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id, component, text_sha256`` for every row of ``docs``.

    ``component`` is the least fingerprint reachable; unlike ``component_id`` it is never null.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(with_fingerprints(docs, id_col, text_col), "rows")
    fps = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fps")

    stars = scratch.keep(connected_components(_near_links(fps.select("fp"))), "stars")
    fps = fps.join(stars, fps["fp"] == stars["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("comp"))
    fps = scratch.keep(fps, "fps")
    joined = scratch.keep(connected_components(_far_links(fps.select("fp", "comp"), scratch)), "joined")
    fps = fps.join(joined, fps["comp"] == joined["node"], "left").select("fp", "first_id", F.coalesce("root", "comp").alias("comp"))
    fps = scratch.keep(fps, "fps")
    least = scratch.keep(fps.groupBy("comp").agg(F.min("first_id").alias("component_id")), "least")
    ids = scratch.keep(fps.join(least, "comp").select("fp", "component_id", F.col("comp").alias("component")), "ids")
    return rows.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component", "text_sha256")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of close fingerprints."""
    return one_of_each(docs, near_groups(docs, id_col, text_col), id_col, text_col)


def op8_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "fingerprint", "component_id")


QUERIES = {"op8_simhash_dedup": op8_simhash_dedup}
ORACLE_SQL: dict[str, str] = {}
