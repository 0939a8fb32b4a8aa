"""Toxicity: non-negative positive-unlabelled learning.

Positives are confirmed toxic documents, the unlabelled set is a sample of all
documents whatever their label. With the class prior pi the risk is
``pi R_p(+) + max(0, R_u(-) - pi R_p(-))``: the negative part is estimated from
unlabelled text and kept from going below zero. A numpy linear model over byte
n-gram indicators is trained on it. The prior is estimated from the positives
and the unlabelled texts; no label of a clean document is read.

Defined cases: null and empty texts hold no n-gram and get the score of the
bias alone; repeated rows are scored each; a null id is scored and never learnt
from; other columns are ignored. Without a learnable toxic document every score
is 0.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesospark.llm.blocks import part
from mesospark.llm.features import Linear, Selected, bounded_share, document_counts, fitted, labelled_ids, sample_marks, scored, scores, share_of, texts_of

FAMILIES = ("letters4", "letters5", "letters6")


@dataclass
class ToxicityModel:
    linear: Linear | None
    prior: float


def non_negative_pu(p: np.ndarray, u: np.ndarray, prior: float, passes: int, rate: float, decay: float, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk; p, u: marks of positives and unlabelled.

    The first third of the passes has the logistic loss, the rest the sigmoid
    loss, whose margins do not stop where the two samples overlap. A step on
    which the negative part of the risk is below zero goes back on that part alone.
    """
    rng = np.random.RandomState(seed)
    w, m, v = (np.zeros(p.shape[1] + 1, np.float32) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))
    t, batches = 0, max(1, len(u) // 512)
    p, u = (np.c_[x, np.ones(len(x))].astype(np.float32) for x in (p, u))
    for turn in range(passes):
        ps, us = np.array_split(rng.permutation(len(p)), batches), np.array_split(rng.permutation(len(u)), batches)
        for i, j in zip(ps, us, strict=True):
            xp, xu = p[i] if len(i) else p, u[j]
            sp, su = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for x in (xp, xu))
            if turn < passes // 3:
                up, down, other = 1 - sp, sp, su
                risk = -np.log(1 - su + 1e-9).mean() + prior * np.log(1 - sp + 1e-9).mean()
            else:
                up = down = sp * (1 - sp)
                other, risk = su * (1 - su), su.mean() - prior * sp.mean()
            plus = -prior * xp.T @ up / len(xp)  # gradient of pi R_p(+)
            minus = xu.T @ other / len(xu) - prior * xp.T @ down / len(xp)
            g = plus + minus if risk >= 0 else -minus
            g[:-1] += decay * w[:-1]
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def first_prior(cp: np.ndarray, cu: np.ndarray, n_p: int, n_u: int) -> float:
    """A first guess at the share of positives among the unlabelled: the pooled ratio of the n-grams that are rarest there."""
    frequent = np.flatnonzero(cp >= max(3.0, 0.03 * n_p))
    if not len(frequent):
        return 0.05
    ratio = ((cu[frequent] + 1) / n_u) / (cp[frequent] / n_p)
    best = frequent[np.argsort(ratio, kind="stable")[:200]]
    return float(np.clip(cu[best].sum() / n_u / (cp[best].sum() / n_p), 0.01, 0.5))


def estimated_prior(p: np.ndarray, u: np.ndarray, guess: float, strongest: int = 50) -> float:
    """The share of positives among the unlabelled, from marks in order of strength.

    Two of the strongest marks together hardly occur in clean text, so texts with
    two are as frequent among the toxic part of the unlabelled as among the
    positives; the ratio of the two shares is the prior.
    """
    share_p, share_u = ((x[:, :strongest].sum(1) >= 2).mean() for x in (p, u))
    return float(np.clip(share_u / share_p if share_p else guess, 0.01, 0.5))


def boundary(p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """The margin of least non-negative zero-one risk; the middle of the widest stretch of them."""
    at = np.sort(np.concatenate([p, u]))
    cuts = (at[1:] + at[:-1]) / 2
    missed = np.searchsorted(np.sort(p), cuts) / len(p)
    flagged = 1 - np.searchsorted(np.sort(u), cuts) / len(u)
    risk = prior * missed + np.maximum(0, flagged - prior * (1 - missed))
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    return float((at[best[0]] + at[best[-1] + 1]) / 2)


def fit_toxicity(documents: DataFrame, labels: DataFrame, *, folds: int = 3, held_out: int = 1, positives: int = 1500, unlabelled: int = 4000, max_bytes: int = 1 << 14, features: int = 1000, passes: int = 60, rate: float = 0.02, decay: float = 1e-4) -> ToxicityModel:
    """Fit on at most ``positives`` toxic and ``unlabelled`` other documents of at most ``max_bytes`` bytes outside the held-out fold."""
    toxic = (F.col("toxic") == 1).cast("int")
    ids, _ = labelled_ids(labels.filter("toxic = 1"), toxic, folds, held_out, positives, 1)
    there = documents.count()
    texts = documents.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (F.octet_length("text") <= max_bytes))
    other = (part("doc_id", folds) != held_out) & (share_of("doc_id", 1) < bounded_share(unlabelled, there))
    drawn = texts.join(F.broadcast(ids), "doc_id", "left").withColumn("other", other).filter("value = 1 OR other")
    sample = drawn.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("value").alias("value"), F.max("other").alias("other"))

    def fit(table):
        return _fit(texts_of(table, 1, positives), table.filter(table.column("other")).column("text").slice(0, unlabelled), features, passes, rate, decay)

    return fitted(sample, fit)


def _fit(toxic, other, features: int, passes: int, rate: float, decay: float) -> ToxicityModel:
    if not len(toxic):
        return ToxicityModel(None, 0.0)
    other = other if len(other) else toxic
    cp, cu = (document_counts(x, FAMILIES) for x in (toxic, other))
    n_p, n_u = len(toxic), len(other)
    guess = first_prior(cp, cu, n_p, n_u)
    # of an n-gram that only toxic text holds, the share among the unlabelled is the prior times that among positives
    clean = (np.maximum(cu - guess * n_u * cp / n_p, 0) + 1) / ((1 - guess) * n_u)
    apart = (cp - n_p * clean) / np.sqrt(n_p * clean + n_p * n_p * clean / n_u + 0.3)  # in standard errors
    lift = np.log((cp + 0.5) / n_p / clean)
    score = np.where((cp >= 3) & (lift > 1) & (apart >= 2.5), lift * np.sqrt(cp), 0)
    kept = np.argsort(-score, kind="stable")[:features]
    chosen = Selected(FAMILIES, kept[score[kept] > 0])
    p, u = (sample_marks(x, chosen, False) for x in (toxic, other))
    prior = estimated_prior(p, u, guess)
    w, b = non_negative_pu(p, u, prior, passes, rate, decay)
    b -= boundary(p @ w + b, u @ w + b, prior)
    return ToxicityModel(Linear(chosen, w[:, None].astype(np.float32), np.array([b], np.float32)), prior)


def _rows(texts, model: ToxicityModel, threshold: float) -> list:
    if model.linear is None:
        score = np.zeros(len(texts))
    else:  # the margin at which the risk parts the classes is put at the threshold
        margin = scores(texts, model.linear)[:, 0].astype(np.float64) + np.log(threshold / (1 - threshold))
        score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
    return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]


def score_toxicity(documents: DataFrame, model: ToxicityModel, threshold: float = 0.7, keep=("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns with ``score, predicted`` for every row of documents."""
    return scored(documents, model, "score double, predicted int", lambda texts, m: _rows(texts, m, threshold), keep, text)
