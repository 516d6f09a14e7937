"""Quality classifier by Bradley-Terry ranking.

A labelled good text is preferred to a labelled poor one. A linear score is learned from such pairs by logistic
loss on the differences of their features, and the threshold is the score quantile at which as large a share of
the labelled texts lies below as is poor. Features and scores are native expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole
from .folds import labelled_sample, remainder
from .rules import PUNCTUATION, SYMBOLS, UPPER
from .stats import count_of, duplicate_lines, word_chars, words

FOLDS, HELD_OUT = 4, 2
#: Bounds: labelled rows, and preference pairs.
SAMPLE, PAIRS = 20_000, 100_000
N_FEATURES = 11


def features(text: Column, ws: Column) -> Column:
    """The feature vector of a text; rates are by word, and an empty text has the rates of no words."""
    n = F.greatest(F.size(ws), F.lit(1)).cast("double")
    rate = lambda count: F.log1p(F.lit(10.0) * count / n)
    distinct = F.size(F.array_distinct(ws)).cast("double")
    return F.array(
        F.log1p(F.size(ws).cast("double")),
        F.least(word_chars(text) / n, F.lit(50.0)),
        rate(count_of(text, SYMBOLS)),
        rate(count_of(text, PUNCTUATION)),
        rate(count_of(text, UPPER)),
        rate(count_of(text, "!")),
        rate(count_of(text, "|")),
        rate(count_of(text, "0123456789")),
        F.log1p(distinct),
        distinct / n,
        duplicate_lines(text) / n,
    )


@dataclass
class QualityModel:
    weights: list[float]
    threshold: float
    slope: float

    def score(self, x: Column, cut_off: float) -> Column:
        """The logistic of the distance from the threshold, which itself has the score ``cut_off``."""
        raw = sum((x[i] * w for i, w in enumerate(self.weights)), F.lit(0.0))
        z = (raw - self.threshold) * self.slope + float(np.log(cut_off / (1 - cut_off)))
        return 1 / (1 + F.exp(-z))


def fit_pairs(good: np.ndarray, poor: np.ndarray, pairs: int = PAIRS, ridge: float = 1.0, seed: int = 7) -> np.ndarray:
    """Weights on the features' own scale from up to ``pairs`` pairs of a good and a poor row."""
    both = np.vstack([good, poor])
    scale = both.std(axis=0) + 1e-9
    rng = np.random.default_rng(seed)
    n = min(pairs, len(good) * len(poor))
    d = (good[rng.integers(len(good), size=n)] - poor[rng.integers(len(poor), size=n)]) / scale
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p) + 1e-9)[:, None]).T @ d + ridge * np.eye(len(w)), d.T @ (1 - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w / scale


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Learns from at most ``sample`` labelled rows outside the held-out fold; their features come to the driver.

    Without labels of both kinds every text gets the same score, just at the threshold.
    """
    rows = labelled_sample(docs, labels, label, FOLDS, HELD_OUT, sample, id_col, text_col)
    got = rows.withColumn("_w", words(F.col("_text"))).select(features(F.col("_text"), F.col("_w")).alias("x"), "_y").collect()
    x, y = np.array([r["x"] for r in got]).reshape(-1, N_FEATURES), np.array([r["_y"] for r in got])
    order = np.lexsort([*x.T, y])
    x, y = x[order], y[order]
    if not (y == 1).any() or not (y == 0).any():
        return QualityModel([0.0] * N_FEATURES, 0.0, 1.0)
    w = fit_pairs(x[y == 1], x[y == 0]).round(9)
    s = x @ w
    return QualityModel(w.tolist(), float(np.quantile(s, (y == 0).mean(), method="higher").round(9)), 1.0)


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, score`` (0 to 1) and ``predicted`` (1 if score >= ``threshold``, else 0).

    A null text counts as empty; texts are read whole; repeated rows are rows; an empty table gives none. Other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_text")).withColumn("_w", words(F.col("_text")))
    scored = rows.select("doc_id", model.score(features(F.col("_text"), F.col("_w")), threshold).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    return remainder(id_col, FOLDS) == HELD_OUT
