"""Quality classifier by Bradley-Terry pairwise ranking.

Each labelled good document is preferred to labelled bad ones. The model is a
linear score whose difference between two documents is the log-odds of the
preference; its weights minimise the logistic loss on feature differences.
Documents are then split at a quantile of the scores of the labelled rows: the
quantile with the best balanced accuracy. The published score is a logistic
curve that passes 0.7 at that quantile, so ``score >= 0.7`` is the decision.

The fit uses at most ``max_labelled`` labelled rows (those with the least
hashed id) and ``max_pairs`` preference pairs; both are parameters, and the
only thing that the driver sees is that bounded feature matrix. Scoring reads
every whole text where it lies.

Features come from the text alone: shares of character classes and of single
ASCII marks, word and line shapes, and repetition.

Defined cases: null and empty texts have the features of an empty text and get
a score; labels that are null, or that name no document, are ignored; without
labels of both kinds nothing can be preferred and every document scores
``NO_PREFERENCE``; repeated rows score alike; a very long text is read whole;
labelled rows of equal hash, and scores that equal the cut, count on the same
side; an empty table gives an empty result; further columns, whatever their
names, are untouched by ``keep_good`` and are no inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD = 0.7
NO_PREFERENCE = 0.7
MAX_LABELLED = 20_000
MAX_PAIRS = 100_000
PIECE = 1 << 20  # bytes counted at a time

_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_CLASSES = (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", (32,)), ("line", (10,)), ("beyond", range(128, 256)), ("control", [*range(0, 10), *range(11, 32), 127]))
_SHAPES = ("log_bytes", "log_words", "word_mean", "word_spread", "long_words", "capital_words", "marked_words", "distinct_words", "log_lines", "repeated_lines", "line_mean", "marks")
N_FEATURES = len(_MARKS) + len(_CLASSES) + len(_SHAPES)


def features(text: bytes | None) -> np.ndarray:
    """The feature vector of a text in UTF-8."""
    raw = text or b""
    counts = np.zeros(256)
    for start in range(0, len(raw), PIECE):
        counts += np.bincount(np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - start), start), minlength=256)
    size = max(1, len(raw))
    words = raw.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marks = counts[_MARKS]
    shapes = (
        np.log1p(len(raw)),
        np.log1p(len(words)),
        lengths.mean(),
        lengths.std(),
        (lengths > 15).sum() / n,
        sum(map(bytes.isupper, words)) / n,
        (n - sum(map(bytes.isalnum, words))) / n if words else 0.0,
        len(set(words)) / n**0.8,
        np.log1p(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(raw) / max(1, len(lines))),
        np.sqrt(marks.sum() / size),
    )
    classes = [counts[list(which)].sum() / size for _, which in _CLASSES]
    return np.concatenate([np.sqrt(marks / size), classes, shapes])


@dataclass(frozen=True)
class PairwiseModel:
    """Weights over standardised features and the curve from raw to published scores."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float  # the raw score at the chosen quantile
    quantile: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(x), NO_PREFERENCE)
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD)), -60, 60)))


def fit_pairwise(x: np.ndarray, label: np.ndarray, max_pairs: int = MAX_PAIRS, ridge: float = 1e-2, rounds: int = 25, seed: int = 7) -> PairwiseModel:
    """Bradley-Terry weights by Newton steps on the logistic loss of preference pairs."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return PairwiseModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    n = min(max_pairs, len(good) * len(bad))
    # Every labelled row of either kind is in pairs as evenly as the numbers allow.
    first = np.resize(rng.permutation(good), n)
    second = np.resize(np.concatenate([rng.permutation(bad) for _ in range(-(-n // len(bad)))]), n)
    d = z[first] - z[second]
    w = np.zeros(N_FEATURES)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -60, 60)))  # how far each pair still is from being ordered
        gradient = d.T @ p / n - ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(N_FEATURES)
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    order = np.sort(raw)
    cuts = np.concatenate([[order[0] - 1], (order[1:] + order[:-1]) / 2])
    miss = np.searchsorted(np.sort(raw[good]), cuts, "left") / len(good)
    catch = np.searchsorted(np.sort(raw[bad]), cuts, "left") / len(bad)
    best = int(np.argmax(catch - miss))
    return PairwiseModel(mean, scale, w, float(cuts[best]), best / len(order))


def _raw_text(text_col: str) -> Column:
    return F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: features(x).tolist())


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> PairwiseModel:
    """Fit on a bounded number of labelled rows of ``docs``."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    known = known.orderBy(F.xxhash64("__id"), "__id", "__label").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("__id"), _raw_text(text_col).alias("raw")).join(F.broadcast(known), "__id")  # at most max_labelled rows
    rows = rows.groupBy("__id", "__label", F.sha2("raw", 256).alias("sha")).agg(F.first("raw").alias("raw"))
    found = rows.select("__id", "__label", "sha", _features("raw").alias("x")).orderBy("__id", "__label", "sha").limit(max_labelled).toPandas()
    x = np.array(found["x"].tolist()).reshape(-1, N_FEATURES)
    return fit_pairwise(x, found["__label"].to_numpy())


def quality_score(model: PairwiseModel, text_col: str = "text") -> Column:
    """The score of each row's text."""

    @F.pandas_udf(T.DoubleType())
    def score(raw: pd.Series) -> pd.Series:
        if not len(raw):
            return pd.Series([], dtype=float)
        return pd.Series(model.score(np.stack([features(x) for x in raw])))

    return score(_raw_text(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are kept from learning: the id's crc32 leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def with_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    model = fit_quality(docs, labels.where(~held_out(id_col)), id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), quality_score(model, text_col).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at or above the threshold, as they were."""
    model = fit_quality(docs, labels.where(~held_out(id_col)), id_col, text_col)
    return docs.where(quality_score(model, text_col) >= THRESHOLD)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Score and decision for every document."""
    return with_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op10_quality": op10_quality}
ORACLE_SQL: dict[str, str] = {}
