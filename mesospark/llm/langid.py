"""Language identification: a byte convolutional network over fixed-length windows.

Convolutions of several widths over one-hot bytes, max pooling over the window
and a softmax layer, trained in numpy. A text is cut into windows of ``length``
bytes, all of them are classified in batches, and their posteriors are averaged
with the number of letters in each window as weight.

Defined cases: null texts and texts without a letter give ``und`` with score 0;
a null lang is never learnt from, texts of one id count once when learning;
repeated rows are predicted each, null ids too; other columns are ignored. With
no learnable language every text gives ``und``.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesospark.llm.blocks import part, utf8
from mesospark.llm.features import bounded_share, fitted, letters_lut, scored, share_of

WIDTHS = (2, 3, 4)
STRIDE = 1  # convolutions start at every byte
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    filters: list[np.ndarray]  # for each width: width x 256 x filters
    bias: np.ndarray  # widths * filters
    dense: np.ndarray
    dense_bias: np.ndarray
    length: int


class _Forward:
    """The network with its convolutions as sums of table rows: one table for pairs of bytes and one for single bytes."""

    def __init__(self, model: LanguageModel):
        self.model, self.n = model, model.filters[0].shape[2]
        pair = lambda f, k: (f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, -1).astype(np.float32)
        two, three, four = model.filters
        self.tables = [[(0, pair(two, 0))], [(0, pair(three, 0)), (2, three[2].astype(np.float32))], [(0, pair(four, 0)), (2, pair(four, 2))]]

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """x: windows x length bytes -> windows x (widths * filters), after the maximum over positions and the rectifier."""
        pairs = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        out = []
        for width, terms in zip(WIDTHS, self.tables, strict=True):
            at = x.shape[1] - width + 1
            total = None
            for shift, table in terms:
                source = pairs if len(table) > 256 else x
                got = np.take(table, source[:, shift : shift + at : STRIDE], axis=0)
                total = got if total is None else np.add(total, got, out=total)
            out.append(total.max(1))
        return np.maximum(np.concatenate(out, 1) + self.model.bias, 0)

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.model.dense + self.model.dense_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def windows(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row of each window, and where it starts; every byte of every row lies in one window."""
    counts = -(-np.diff(offsets) // length)
    rows = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    return rows, offsets[rows] + nth * length


def _take(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    at = starts[:, None] + np.arange(length)
    out = codes[np.minimum(at, len(codes) - 1)]
    out[at >= ends[:, None]] = 32
    return out


def train(x: np.ndarray, y: np.ndarray, languages: list[str], *, filters: int = 8, passes: int = 12, rate: float = 0.01, batch: int = 128, seed: int = 5) -> LanguageModel:
    """Adam on the cross-entropy; only the bytes at each filter's best position get a gradient."""
    rng = np.random.RandomState(seed)
    width, k = len(WIDTHS) * filters, len(languages)
    params = [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in WIDTHS] + [np.zeros(width, np.float32), rng.normal(0, 0.3, (width, k)).astype(np.float32), np.zeros(k, np.float32)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for step in range(passes):
        order = rng.permutation(len(x))
        for a in range(0, len(order), batch):
            xb, yb = x[order[a : a + batch]], y[order[a : a + batch]]
            best, top = [], []
            for w, table in zip(WIDTHS, params, strict=False):
                at = xb.shape[1] - w + 1
                z = sum(table[j][xb[:, j : j + at : STRIDE]] for j in range(w))
                best.append(z.argmax(1))
                top.append(np.take_along_axis(z, best[-1][:, None, :], 1)[:, 0])
            pre = np.concatenate(top, 1) + params[3]
            hidden = np.maximum(pre, 0)
            z = hidden @ params[4] + params[5]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            p /= len(yb)
            back = (p @ params[4].T) * (pre > 0)
            grads = [np.zeros_like(q) for q in params[:3]] + [back.sum(0), hidden.T @ p, p.sum(0)]
            for i, w in enumerate(WIDTHS):
                g, where = back[:, i * filters : (i + 1) * filters], best[i]
                for j in range(w):
                    np.add.at(grads[i][j], (np.take_along_axis(xb, STRIDE * where + j, 1), np.arange(filters)[None, :]), g)
            t += 1
            now = rate * (1 - step / passes) + 1e-4
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] = params[i] - now * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return LanguageModel(languages, params[:3], params[3], params[4], params[5], x.shape[1])


def fit_languages(documents: DataFrame, *, folds: int = 3, held_out: int = 1, per_language: int = 500, max_bytes: int = 1 << 14, max_languages: int = 256, windows_each: int = 4, length: int = 256, **training) -> LanguageModel | None:
    """Fit on at most ``per_language`` documents of each language outside the held-out fold.

    Two scans: one counts the languages, one draws documents by a hash of the id
    and cuts windows from them; the windows alone, a bounded number, meet in the
    task that trains. Over ``max_languages`` languages are an error.
    """
    known = documents.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & (part("doc_id", folds) != held_out))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise the limit or merge some")
    share, languages = F.lit(0.0), sorted(counts)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, bounded_share(per_language, n)).otherwise(share)
    drawn = known.filter(F.octet_length("text").between(1, max_bytes) & (share_of("doc_id", 0) < share))
    drawn = drawn.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("row")).select("doc_id", "row.*")

    def cut_windows(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            codes, n = letters_lut()[data], batch.num_rows
            room = np.maximum(np.diff(offsets) - length, 0)
            row = np.repeat(np.arange(n), windows_each)
            start = offsets[row] + room[row] * np.tile(np.arange(windows_each), n) // max(1, windows_each - 1)
            x = _take(codes, start, offsets[row + 1], length)
            new = np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1])) if n else np.zeros(0, bool)
            row, x = row[new], np.ascontiguousarray(x[new])
            cells = pa.Array.from_buffers(pa.binary(length), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), batch.column("lang").take(pa.array(row)), cells], names=["doc_id", "lang", "window"])

    def fit(table):
        at = {lang: k for k, lang in enumerate(languages)}
        y = np.array([at[x] for x in table.column("lang").to_pylist()], np.int64)
        if not len(y):
            return None
        x = np.frombuffer(b"".join(table.column("window").to_pylist()), np.uint8).reshape(len(y), length)
        return train(x, y, languages, **training)

    sample = drawn.mapInArrow(cut_windows, f"doc_id {dict(documents.dtypes)['doc_id']}, lang string, window binary")
    return fitted(sample, fit) if languages else None


_FORWARD: dict = {}


def predict(column, model: LanguageModel | None, at_once: int = 256) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of an Arrow column."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    if model is None:
        return [UNKNOWN] * n, np.zeros(n)
    if _FORWARD.get("of") is not model:  # tables are built once for each worker
        _FORWARD.update(of=model, net=_Forward(model))
    net, lut = _FORWARD["net"], letters_lut()
    rows, starts = windows(data, offsets, model.length)
    total, letters = np.zeros((n, len(model.languages))), np.zeros(n)
    for a in range(0, len(rows), at_once):
        row, start = rows[a : a + at_once], starts[a : a + at_once]
        low = int(start[0])
        high = int(min(start[-1] + model.length, len(data)))
        x = _take(lut[data[low:high]], start - low, offsets[row + 1] - low, model.length)
        weight = (x != 32).sum(1)
        np.add.at(total, row, net.posteriors(x) * weight[:, None])
        np.add.at(letters, row, weight)
    share = total / np.maximum(letters, 1e-9)[:, None]
    best = share.argmax(1)
    plain = np.zeros(n, bool)  # holds an ASCII letter
    for i in range(n):
        piece = data[offsets[i] : offsets[i + 1]]
        head = lut[piece[:512]]
        plain[i] = ((head > 96) & (head < 123)).any() or any(c.isalpha() for c in piece.tobytes().decode("utf-8", "replace"))
    names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, plain, strict=True)]
    return names, np.where(plain, np.clip(share[np.arange(n), best], 0, 1), 0.0)


def _rows(texts, model) -> list:
    names, score = predict(texts, model)
    return [pa.array(names, pa.string()), pa.array(score)]


def predict_languages(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of documents; neither lang nor source is read."""
    return scored(documents, model, "lang_pred string, score double", _rows)
