"""Clusters of vectors within a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.operators.linkage import agglomerate, linked_clusters
from brightloom.plans.shared import Scratch

def average_linkage(vectors: np.ndarray, stop: float = 0.75, min_size: int = 3) -> np.ndarray:
    """Agglomerative clusters by mean cosine; labels in order of the first member, -1 for small clusters."""
    n = len(vectors)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    sim = unit @ unit.T
    members = agglomerate(sim, np.ones(n), stop)
    labels = np.full(n, -1)
    for label, group in enumerate(sorted((sorted(m) for m in members if len(m) >= min_size), key=lambda m: m[0])):
        labels[group] = label
    return labels


def cluster_groups(rows: DataFrame, group: str, id_col: str = "vec_id", stop: float = 0.75, min_size: int = 3, at_once: int = 2048) -> DataFrame:
    """``group, id, cluster`` of every vector, clustered within its group, in id order.

    Groups of up to ``at_once`` vectors are clustered in one task each, with a
    matrix of all pairs. Larger ones go through rounds over the cluster until
    so few clusters are left, with the same result.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        labels = average_linkage(np.stack(pdf["embedding"].to_numpy()).astype(float), stop, min_size)
        return pd.DataFrame({group: pdf[group], id_col: pdf[id_col], "cluster": labels})

    kinds = dict(rows.dtypes)
    rows = rows.select(group, id_col, "embedding")
    sizes = Scratch(rows.sparkSession, "groups").keep(rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n")), "sizes")
    large = sizes.where(F.col("__n") > at_once)
    if large.isEmpty():
        return rows.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {id_col} {kinds[id_col]}, cluster long")
    keys = large.select(F.col(group).alias("__large"))
    small = rows.join(keys, rows[group].eqNullSafe(keys["__large"]), "left_anti")
    whole = small.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {id_col} {kinds[id_col]}, cluster long")
    return whole.unionByName(linked_clusters(rows.join(keys, rows[group].eqNullSafe(keys["__large"]), "left_semi"), group, id_col, stop, min_size, at_once=at_once))


def mean_similarity(rows: DataFrame, group: str, dim: int, id_col: str = "vec_id") -> DataFrame:
    """Mean cosine of every vector to the rest of its group, without forming pairs.

    The sum of the cosines to all members is the product with the sum of the
    unit vectors, so a group sends one vector from each task.
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = rows.select(group, id_col, F.transform("embedding", lambda x: x.cast("double") / norm).alias("u"))
    sums = unit.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("u")[i]).alias(f"s{i}") for i in range(dim)])
    sums = sums.select(group, "n", F.array(*[f"s{i}" for i in range(dim)]).alias("total"))
    joined = unit.join(sums, group)
    product = F.aggregate(F.zip_with("u", "total", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return joined.where("n > 1").select(group, id_col, ((product - 1) / (F.col("n") - 1)).alias("similarity"))
