"""Token ids in a content-addressed store.

A rolling hash over the last ids cuts each document's id stream into chunks,
so equal stretches of ids give equal chunks wherever they stand. The store has
three Parquet tables:

``chunks``   chunk_id (SHA-256 of the payload), n_ids, payload (little-endian
             ids); every distinct chunk once.
``recipes``  doc_id, start, n_tokens, chunk_ids in order and the Merkle root
             over them; in ascending doc_id order from file to file and within
             each.
``manifest`` the Merkle tree over the recipes: level, node, count, root. A leaf
             is the digest of a recipe's id, place, size and root.

``read_store`` computes the tree anew from the recipes and compares it with the
manifest, rebuilds each distinct recipe once from its chunks, verifies every
chunk's address and the recipe's root, and gives the ids to all documents with
that root. Anything that doesn't match raises.

Defined cases: a null text counts as empty; an empty text has the closing id
alone; null ids come first in order; rows with the same id are ordered by root
and stored each; a very long text is a recipe of many chunks; an empty table
gives empty tables; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.llm.tokens import default_tokenizer, encoder, id_width, text_slices
from brightloom.plans.shared import Scratch

END_ID = 1
WINDOW = 16  # ids that the rolling hash looks back on
MASK_BITS = 9  # a cut every 512 ids on average
MAX_CHUNK = 1 << 14
FAN_IN = 1024


def cut_points(ids: np.ndarray, mask_bits: int = MASK_BITS, max_chunk: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks: where the rolling hash has ``mask_bits`` zero bits, or at the longest."""
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA77)
        rolling, back = mixed, 1
        while back < min(WINDOW, len(ids)):  # each round looks back twice as far
            wider = rolling.copy()
            wider[back:] += rolling[:-back] << np.uint32(back)
            rolling, back = wider, 2 * back
    ends, last = [], 0
    for cut in (np.flatnonzero(rolling >> np.uint32(32 - mask_bits) == 0) + 1).tolist() + [len(ids)]:
        while cut - last > max_chunk:
            last += max_chunk
            ends.append(last)
        if cut > last:
            ends.append(cut)
            last = cut
    return ends


def merkle_root(digests: list[bytes]) -> bytes:
    """Root of the binary Merkle tree over digests; an odd one moves up as it is."""
    level = list(digests) or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_CHUNK = pa.struct([("chunk_id", pa.binary()), ("n_ids", pa.int32()), ("payload", pa.binary())])


def _chunked(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            totals, recipes, roots, stored = [], [], [], []
            sent: set[bytes] = set()  # a chunk leaves a batch once
            for text in batch.column(1):
                ids = np.append(coder.encode(text.as_py()), np.array(end_id, coder.width))
                recipe, chunks, last = [], [], 0
                for end in cut_points(ids):
                    payload = ids[last:end].tobytes()
                    name = hashlib.sha256(payload).digest()
                    recipe.append(name)
                    if name not in sent:
                        sent.add(name)
                        chunks.append({"chunk_id": name, "n_ids": end - last, "payload": payload})
                    last = end
                totals.append(len(ids))
                recipes.append(recipe)
                roots.append(merkle_root(recipe))
                stored.append(chunks)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(recipes, pa.list_(pa.binary())), pa.array(roots, pa.binary()), pa.array(stored, pa.list_(_CHUNK))],
                ["doc_id", "n_tokens", "chunk_ids", "root", "chunks"],
            )

    return run


def write_store(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text of ``docs`` and write the three tables below ``out``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chunk = T.StructType([T.StructField("chunk_id", T.BinaryType()), T.StructField("n_ids", T.IntegerType()), T.StructField("payload", T.BinaryType())])
    schema = T.StructType(
        [
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("chunk_ids", T.ArrayType(T.BinaryType())),
            T.StructField("root", T.BinaryType()),
            T.StructField("chunks", T.ArrayType(chunk)),
        ]
    )
    staged = scratch.keep(rows.mapInArrow(_chunked(tokenizer or default_tokenizer(), end_id), schema), "staged", "zstd")
    chunks = staged.select(F.explode("chunks").alias("c")).select("c.*")
    scratch.write(chunks.groupBy("chunk_id").agg(F.first("n_ids").alias("n_ids"), F.first("payload").alias("payload")), f"{out}/chunks", "zstd")

    order = [F.col("doc_id").asc_nulls_first(), F.col("root").asc()]
    parts = staged.select("doc_id", "n_tokens", "chunk_ids", "root").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    parts = scratch.keep(parts, "parts")
    scratch.drop("staged")
    before = parts.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per part: their running total is a small window.
    before = before.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    recipes = parts.withColumn("own", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(F.broadcast(before), "part")  # one row per part
    recipes = scratch.keep(recipes.select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "chunk_ids", "root"), "recipes")
    scratch.drop("parts")
    # The window dealt the parts out by hash; places put the files in order again.
    scratch.write(recipes.repartitionByRange("start").sortWithinPartitions("start"), f"{out}/recipes")
    scratch.drop("recipes")
    scratch.write(_tree(spark.read.parquet(f"{out}/recipes"), scratch), f"{out}/manifest")
    scratch.drop_all_but()


def _tree(recipes: DataFrame, scratch: Scratch) -> DataFrame:
    """``level, node, count, root`` of a Merkle tree over the recipes in order, up to one node."""
    told = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "start", "n_tokens", F.hex("root"))
    # A document has one id at least, so a node holds a bounded number of leaves.
    nodes = recipes.select(F.floor(F.col("start") / (FAN_IN * 256)).alias("node"), F.col("start").alias("place"), F.lit(1).cast("long").alias("count"), F.unhex(F.sha2(told, 256)).alias("root"))
    levels: DataFrame | None = None
    level = 0
    while True:
        gathered = nodes.groupBy("node").agg(F.sum("count").alias("count"), F.sort_array(F.collect_list(F.struct("place", "root"))).alias("under"))
        named = gathered.select(F.lit(level).alias("level"), "node", "count", F.unhex(F.sha2(F.concat_ws("", F.transform("under", lambda x: F.hex(x["root"]))), 256)).alias("root"))
        named = scratch.keep(named, f"level{level}")
        levels = named if levels is None else levels.unionByName(named)
        if named.limit(2).count() < 2:
            return levels
        nodes = named.select(F.floor(F.col("node") / FAN_IN).alias("node"), F.col("node").alias("place"), "count", "root")
        level += 1


def verify_manifest(spark: SparkSession, out: str) -> None:
    """Raise if the recipes of a store are not those that its manifest was made of."""
    scratch = Scratch(spark, "manifest")
    told, found = spark.read.parquet(f"{out}/manifest"), _tree(spark.read.parquet(f"{out}/recipes"), scratch)
    keys = ["level", "node", "count", "root"]
    odd = told.select(*keys).withColumn("told", F.lit(1)).unionByName(found.select(*keys).withColumn("told", F.lit(-1)))
    if not odd.groupBy(*keys).agg(F.sum("told").alias("n")).where("n <> 0").isEmpty():
        raise ValueError("the recipes don't match the manifest")
    scratch.drop_all_but()


def _rebuilt(width: str):
    """Chunks sorted by recipe and position -> the ids of each recipe, verified."""

    def whole(root: bytes, names: list[bytes], payloads: list[bytes | None]) -> bytes:
        if None in payloads or names != [hashlib.sha256(p).digest() for p in payloads] or merkle_root(names) != root:
            raise ValueError("a stored chunk or recipe doesn't match its address")
        return np.frombuffer(b"".join(payloads), width).astype("<u4").tobytes()

    def batch_of(done: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.binary()) for i in (0, 1)], ["root", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, names, payloads = None, [], []
        for batch in batches:
            done, held = [], 0
            for key, name, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key != root and names:
                    done.append((root, whole(root, names, payloads)))
                    held += len(done[-1][1])
                    names, payloads = [], []
                    if held > 1 << 24:
                        yield batch_of(done)
                        done, held = [], 0
                root = key
                names.append(name)
                payloads.append(payload)
            yield batch_of(done)
        if names:
            yield batch_of([(root, whole(root, names, payloads))])

    return run


def read_distinct(spark: SparkSession, out: str, tokenizer: str | None = None) -> DataFrame:
    """``root, ids`` (little-endian uint32) of each distinct recipe, rebuilt from the chunks and verified."""
    width = id_width(encoder(tokenizer or default_tokenizer()).vocabulary)
    recipes, chunks = spark.read.parquet(f"{out}/recipes"), spark.read.parquet(f"{out}/chunks")
    places = recipes.groupBy("root").agg(F.first("chunk_ids").alias("chunk_ids")).select("root", F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    # A chunk that many recipes share is a skewed key: plain scans on both sides let it be split.
    scratch = Scratch(spark, "places")
    places = scratch.keep(places, "places")
    # Written, so that payloads do not lie in two shuffles at once.
    parts = scratch.keep(places.join(chunks.select("chunk_id", "payload"), "chunk_id", "left"), "parts", "zstd")
    scratch.drop("places")
    parts = parts.repartition("root").sortWithinPartitions("root", "pos").select("root", "chunk_id", "payload")
    return parts.mapInArrow(_rebuilt(width), "root binary, ids binary")


def read_store(spark: SparkSession, out: str, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of a store, its manifest verified."""
    verify_manifest(spark, out)
    recipes = spark.read.parquet(f"{out}/recipes").select("doc_id", "start", "n_tokens", "root")
    return recipes.join(read_distinct(spark, out, tokenizer), "root").select("doc_id", "start", "n_tokens", "ids")


def checksums(spark: SparkSession, out: str, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of a store, from its rebuilt ids."""
    verify_manifest(spark, out)
    scratch = Scratch(spark, "checksums")
    sums = read_distinct(spark, out, tokenizer).select("root", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    recipes = spark.read.parquet(f"{out}/recipes").select("doc_id", "start", "root")
    return recipes.join(scratch.keep(sums, "sums"), "root").select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_token_store(spark, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids, from the files of the store."""
    out = Scratch(spark, "op9").path("store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), out)
    return checksums(spark, out)


QUERIES = {"op9_token_store": op9_token_store}
ORACLE_SQL: dict[str, str] = {}
