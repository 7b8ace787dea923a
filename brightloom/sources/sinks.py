"""Sinks: JSON lines, an envelope, partitions replaced by parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line; Spark's committer renames finished files."""
    rows.write.mode("errorifexists").json(path)


def evidence_bundles(parents: DataFrame, children: DataFrame, key: str, order: str) -> DataFrame:
    """``key, bundle``: each parent with its children in order as one JSON document."""
    own = [c for c in children.columns if c != key]
    nested = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in own if c != order]))).alias("items"))
    joined = parents.join(nested, key, "left")
    body = F.struct(F.lit(1).alias("version"), F.struct(*parents.columns).alias("parent"), F.coalesce("items", F.array().cast(nested.schema["items"].dataType)).alias("items"))
    return joined.select(key, F.to_json(body).alias("bundle"))


def replace_partitions(rows: DataFrame, path: str, partition: str) -> None:
    """Overwrite the partitions that the rows name and leave the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_manifests(frames: DataFrame, transcripts: DataFrame, key: str, path: str) -> None:
    """One JSON manifest an item: its frames in order of time and its transcript in order of start."""
    f = frames.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("time_ms", "frame_index", "path"))).alias("frames"))  # one item's frames
    t = transcripts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start_ms", "end_ms", "text"))).alias("transcript"))
    empty = lambda c, of: F.coalesce(c, F.array().cast(of.schema[c].dataType)).alias(c)
    f.join(t, key, "full").select(key, empty("frames", f), empty("transcript", t)).write.mode("errorifexists").json(path)
