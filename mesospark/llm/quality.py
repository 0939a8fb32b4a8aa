"""Quality classifier: naive Bayes support vectors.

n-gram indicators are scaled by the log ratio of their smoothed counts in the
two classes; a linear model with hinge loss is then fitted by dual coordinate
descent, and a logistic curve turns margins into scores.

Defined cases: null and empty texts hold no n-gram and get the score of the
bias alone; repeated rows are scored each; a null id is scored and never learnt
from; other columns are ignored. Without both classes among the learnable rows
every score is the share of the class present (0.5 without any).
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesospark.llm.features import Linear, Selected, document_counts, fitted, labelled_ids, labelled_texts, sample_marks, scored, scores, texts_of

FAMILIES = ("shapes2", "shapes3", "shapes4")


@dataclass
class QualityModel:
    linear: Linear | None
    slope: float
    offset: float


def dual_coordinate_descent(x: np.ndarray, y: np.ndarray, cost: np.ndarray, passes: int, seed: int = 7) -> np.ndarray:
    """Weights that minimise |w|^2/2 + sum cost_i * max(0, 1 - y_i w.x_i): one dual variable at a time, in [0, cost_i]."""
    rng, w, alpha = np.random.RandomState(seed), np.zeros(x.shape[1], x.dtype), np.zeros(len(x))
    square = np.maximum((x * x).sum(1), 1e-12)
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1
            moved = min(max(alpha[i] - gradient / square[i], 0), cost[i])
            if moved != alpha[i]:
                worst = max(worst, abs(moved - alpha[i]))
                w += x.dtype.type((moved - alpha[i]) * y[i]) * x[i]
                alpha[i] = moved
        if worst < 1e-5:
            break
    return w


def logistic_fit(margin: np.ndarray, y: np.ndarray, passes: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins, by Newton steps on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta, design = np.array([1.0, 0.0]), np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(passes):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-4 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (p - target) + 1e-4 * (theta - [1, 0]))
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit_quality(documents: DataFrame, labels: DataFrame, *, folds: int = 5, held_out: int = 0, per_class: int = 2500, max_bytes: int = 1 << 16, features: int = 2048, cost: float = 1.0, passes: int = 30) -> QualityModel:
    """Fit on at most ``per_class`` labelled documents of each class, of at most ``max_bytes`` bytes each, outside the held-out fold."""
    ids, _ = labelled_ids(labels, F.col("quality"), folds, held_out, per_class, 16)
    sample = labelled_texts(documents, ids.filter("value IN (0, 1)"), max_bytes)
    return fitted(sample, lambda table: _fit(texts_of(table, 1, per_class), texts_of(table, 0, per_class), features, cost, passes))


def _scaled_marks(texts, chosen: Selected) -> np.ndarray:
    marks = sample_marks(texts, chosen, True).astype(np.float32)
    return marks / np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))


def _fit(good, bad, features: int, cost: float, passes: int) -> QualityModel:
    n1, n0 = len(good), len(bad)
    if not n1 or not n0:
        share = 0.5 if n1 == n0 else float(n1 > 0)
        return QualityModel(None, 0.0, float(np.log((share + 0.01) / (1.01 - share))))
    y = np.r_[np.ones(n1), -np.ones(n0)]
    c1, c0 = document_counts(good, FAMILIES), document_counts(bad, FAMILIES)
    p, q = (c1 + 1) / (n1 + 2), (c0 + 1) / (n0 + 2)
    apart = np.abs(p - q) / np.sqrt((p * (1 - p) / n1 + q * (1 - q) / n0))
    kept = np.argsort(-np.where(c1 + c0 >= 3, apart, 0), kind="stable")[:features]
    chosen = Selected(FAMILIES, kept)
    x = np.concatenate([_scaled_marks(good, chosen), _scaled_marks(bad, chosen)])
    c1, c0 = (x[y > 0] > 0).sum(0), (x[y < 0] > 0).sum(0)
    ratio = (np.log((c1 + 1) / (c1 + 1).sum()) - np.log((c0 + 1) / (c0 + 1).sum())).astype(np.float32)
    x *= ratio
    x = np.c_[x, np.ones(len(y), np.float32)]
    weight = cost * np.where(y > 0, (n1 + n0) / (2 * n1), (n1 + n0) / (2 * n0))
    # margins for the logistic curve come from fits that have not seen their rows
    margin, fold = np.zeros(len(y)), np.arange(len(y)) % 3
    for k in range(3):
        seen = fold != k
        if (y[seen] > 0).any() and (y[seen] < 0).any():
            margin[~seen] = x[~seen] @ dual_coordinate_descent(x[seen], y[seen], weight[seen], passes)
    w = dual_coordinate_descent(x, y, weight, passes)
    slope, offset = logistic_fit(margin if margin.any() else x @ w, y)
    return QualityModel(Linear(chosen, (w[:-1] * ratio)[:, None].astype(np.float32), w[-1:].astype(np.float32), repeats=True, unit=True), slope, offset)


def _rows(texts, model: QualityModel, threshold: float) -> list:
    margin = scores(texts, model.linear)[:, 0] if model.linear else np.zeros(len(texts))
    score = 1 / (1 + np.exp(-np.clip(model.slope * margin.astype(np.float64) + model.offset, -30, 30)))
    return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]


def score_quality(documents: DataFrame, model: QualityModel, threshold: float = 0.3, keep=("doc_id",)) -> DataFrame:
    """The kept columns with ``score, predicted`` for every row of documents."""
    return scored(documents, model, "score double, predicted int", lambda texts, m: _rows(texts, m, threshold), keep)
