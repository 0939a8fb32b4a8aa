"""Mixing to target weights with soft domain membership.

A softmax classifier over byte n-gram indicators, fitted on labelled rows,
gives each document's domain posteriors p. Non-negative document rates r then
minimise the squared relative distance of the expected domain token totals
S_k = sum_i r_i t_i p_ik from their targets T_k, by projected gradient steps
from r = 1. A step changes r_i by -eta p_i . g, so the rates of all documents
follow from the list of gradients g, one short vector a pass: each pass is one
distributed sum, and no rate is stored or moved.

Defined cases: null and empty texts have no tokens, get the posteriors of the
bias and a rate, and add nothing to any total; repeated rows have a rate each;
null ids pass through; other columns pass through with ``keep``. Without
labelled rows there is one domain, ``all``. A document whose rate is 0 leaves
the mixture.
"""

import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mesospark.llm.blocks import row_slices, utf8, words
from mesospark.llm.features import BITS, WINDOW, Linear, Selected, document_counts, fitted, labelled_ids, labelled_texts, sample_marks, scored, scores, texts_of
from mesospark.plans.lineage import cut

log = logging.getLogger(__name__)
FAMILIES = ("letters3", "letters4", "shapes3")


@dataclass
class DomainModel:
    domains: list[str]
    shares: np.ndarray  # of the labelled rows
    linear: Linear | None


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit_domains(documents: DataFrame, labelled: DataFrame, domain: Column, *, per_domain: int = 300, max_bytes: int = 1 << 14, max_domains: int = 64, features: int = 1500, passes: int = 150, rate: float = 0.1, decay: float = 1e-4) -> DomainModel:
    """Fit on at most ``per_domain`` labelled documents of each domain; over ``max_domains`` domains are an error."""
    ids, counts = labelled_ids(labelled, domain, 1, -1, per_domain, max_domains)

    def fit(table):
        return _fit({d: texts_of(table, d, per_domain) for d in sorted(counts)}, counts, features, passes, rate, decay)

    return fitted(labelled_texts(documents, ids, max_bytes), fit) if counts else DomainModel(["all"], np.ones(1), None)


def _fit(texts: dict, counts: dict, features: int, passes: int, rate: float, decay: float) -> DomainModel:
    domains = [d for d in texts if len(texts[d])]
    if len(domains) < 2:
        return DomainModel(domains or ["all"], np.ones(1), None)
    together = pa.chunked_array([c for d in domains for c in texts[d].chunks])
    y = np.repeat(np.arange(len(domains)), [len(texts[d]) for d in domains])
    width = len(FAMILIES) << BITS
    total, square, seen = np.zeros(width, np.float32), np.zeros(width, np.float32), np.zeros(width, np.float32)
    for k in range(len(domains)):  # one domain's counts at a time
        count = document_counts(texts[domains[k]], FAMILIES)
        seen += count
        count /= (y == k).sum()
        total += count
        square += count * count
    mean = total / len(domains)
    apart = (square / len(domains) - mean * mean) / (mean * (1 - mean) + 0.01)
    kept = np.argsort(-np.where(seen >= 5, apart, 0), kind="stable")[:features]
    chosen = Selected(FAMILIES, kept)
    x = sample_marks(together, chosen, True).astype(np.float32)
    x = np.c_[x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)), np.ones(len(x), np.float32)]
    w, m, v = (np.zeros((x.shape[1], len(domains)), np.float32) for _ in range(3))
    weight = (len(y) / (len(domains) * np.bincount(y)))[y][:, None]
    for t in range(1, passes + 1):
        p = _softmax(x @ w)
        p[np.arange(len(y)), y] -= 1
        g = x.T @ (p * weight).astype(np.float32) / len(y) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = (w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    shares = np.array([counts[d] for d in domains], float)
    return DomainModel(domains, shares / shares.sum(), Linear(chosen, w[:-1], w[-1], repeats=True, unit=True))


def _posteriors(texts, model: DomainModel) -> list:
    p = _softmax(scores(texts, model.linear).astype(np.float64)) if model.linear else np.ones((len(texts), 1))
    data, offsets = utf8(texts)
    tokens = np.zeros(len(texts), np.int64)
    for a, b in row_slices(offsets, WINDOW):
        row = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0]
        tokens[a:b] = np.bincount(row, minlength=b - a)
    sizes = np.arange(0, p.size + 1, p.shape[1]).astype(np.int32)
    return [pa.array(tokens), pa.ListArray.from_arrays(pa.array(sizes), pa.array(p.ravel()))]


def posteriors(documents: DataFrame, model: DomainModel, keep=("doc_id",)) -> DataFrame:
    """The kept columns with ``tokens long, p array<double>`` in the order of ``model.domains``."""
    return scored(documents, model, "tokens long, p array<double>", _posteriors, keep)


def _rates(p: np.ndarray, gradients: list[np.ndarray]) -> np.ndarray:
    r = np.ones(len(p))
    for g in gradients:
        r = np.maximum(0, r - p @ g)
    return r


def _block(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(batch.column("tokens"), dtype=np.float64), np.asarray(batch.column("p").flatten(), dtype=np.float64).reshape(-1, k)


def _totals(soft: DataFrame, k: int, gradients: list[np.ndarray]) -> np.ndarray:
    """Domain token totals S (first k), then the k x k sums of t p p': one row a task, summed."""
    def run(batches):
        total = np.zeros(k + k * k)
        for batch in batches:
            t, p = _block(batch, k)
            total[:k] += (t * _rates(p, gradients)) @ p
            if not gradients:
                total[k:] += (p.T @ (p * t[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "x"])

    rows = soft.select("tokens", "p").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(k + k * k)
    for r in rows:
        out[r.i] = r.x
    return out


def targets_of(model: DomainModel, temperature: float) -> dict[str, float]:
    """Target shares: those of the labelled rows to a power, which flattens them."""
    flat = model.shares**temperature
    return dict(zip(model.domains, flat / flat.sum(), strict=True))


@dataclass
class Solution:
    """The gradients whose steps give the rates, and the largest distance from a target that they leave, as a share of all tokens."""

    gradients: list[np.ndarray]
    gap: float


def solve(soft: DataFrame, model: DomainModel, targets: dict[str, float], *, passes: int = 30, tolerance: float = 1e-5) -> Solution:
    """Projected gradient steps until every total is within the tolerance, no step moves one, or the passes end.

    Targets are shares of the tokens there are; targets that no non-negative
    rates meet leave a gap.
    """
    k = len(model.domains)
    start = _totals(soft, k, [])
    mass, second = start[:k], start[k:].reshape(k, k)
    wanted = np.array([max(0.0, targets.get(d, 0.0)) for d in model.domains])
    if not mass.sum() or not wanted.sum():
        return Solution([], 0.0)
    wanted = wanted / wanted.sum() * mass.sum()
    scale = 1 / np.maximum(mass, 1e-6 * mass.sum())  # distances are relative to what a domain has
    half = np.sqrt(scale)
    step = 1 / max(np.linalg.eigvalsh(half[:, None] * second * half).max(), 1e-12)
    gradients, totals, gap = [], mass, mass - wanted
    for _ in range(passes):
        if np.abs(gap).max() <= tolerance * mass.sum():
            break
        gradients.append(step * scale * gap)
        totals = _totals(soft, k, gradients)[:k]
        before, gap = gap, totals - wanted
        if np.abs(gap - before).max() <= 1e-9 * mass.sum():
            break
    return Solution(gradients, float(np.abs(gap).max() / mass.sum()))


def mix(documents: DataFrame, labelled: DataFrame, domain: Column, *, temperature: float = 0.7, targets: dict[str, float] | None = None, keep=("doc_id",), passes: int = 30, **fitting) -> DataFrame:
    """The kept columns with ``domain string, tokens long, p array<double>, rate double, expected_tokens double``.

    What the last pass leaves of the distance to the targets is logged.
    """
    model = fit_domains(documents, labelled, domain, **fitting)
    soft = cut(posteriors(documents, model, keep))
    solved = solve(soft, model, targets or targets_of(model, temperature), passes=passes)
    log.info("mixing: %d steps leave %.2g of all tokens as the largest gap", len(solved.gradients), solved.gap)
    k, domains, gradients = len(model.domains), model.domains, solved.gradients

    def run(batches):
        for batch in batches:
            t, p = _block(batch, k)
            r = _rates(p, gradients)
            names = pa.array([domains[i] for i in p.argmax(1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, names, pa.array(r), pa.array(r * t)], names=[*batch.schema.names, "domain", "rate", "expected_tokens"])

    schema = ", ".join(f"`{c}` {t}" for c, t in soft.dtypes)
    return soft.mapInArrow(run, f"{schema}, domain string, rate double, expected_tokens double").filter("rate > 0 OR tokens = 0")
