"""Hashed byte n-gram indicators shared by the linear classifiers.

A feature is "this text holds this n-gram of byte classes". Hashing all
n-grams and looking up the selected ones are array operations over the bytes
of a whole record batch; a document's features are found over its whole text.
"""

import pickle
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mesospark.llm.blocks import WINDOW, part, row_slices, utf8, words

BITS = 20
_READ = "the text that is read"


def letters_lut() -> np.ndarray:
    """Letters lower-cased, everything else in ASCII one blank."""
    lut = np.full(256, 32, np.uint8)
    lut[97:123] = np.arange(97, 123)
    lut[65:91] = np.arange(97, 123)
    lut[128:] = np.arange(128, 256)
    return lut


def shapes_lut() -> np.ndarray:
    """Lower and other letters, upper letters and digits one class each; blanks and punctuation as they are."""
    lut = np.arange(256, dtype=np.uint8)
    lut[97:123] = lut[128:] = ord("a")
    lut[65:91] = ord("A")
    lut[48:58] = ord("0")
    return lut


#: name -> (byte classes, n-gram width)
FAMILIES = {f"letters{n}": (letters_lut, n) for n in (2, 3, 4, 5, 6, 8, 11)} | {f"shapes{n}": (shapes_lut, n) for n in (2, 3, 4)}


@dataclass
class Selected:
    """Which hash buckets are kept as features: bucket numbers, family-major. Lookup tables are made where they are used."""

    families: tuple[str, ...]
    kept: np.ndarray
    _tables: dict = field(default_factory=dict, repr=False, compare=False)

    @property
    def size(self) -> int:
        return len(self.kept)

    def table(self, family: str) -> np.ndarray:
        """Bucket -> index of the kept feature, from 1 (0: none)."""
        if family not in self._tables:
            own = np.flatnonzero(self.kept >> BITS == self.families.index(family))
            table = np.zeros(1 << BITS, np.int16)
            table[self.kept[own] & ((1 << BITS) - 1)] = own + 1
            self._tables[family] = table
        return self._tables[family]

    def __getstate__(self):
        return self.__dict__ | {"_tables": {}}


def _buckets(codes: np.ndarray, family: str) -> np.ndarray:
    rng = np.random.RandomState(sum(map(ord, family)))
    n = FAMILIES[family][1]
    tables = rng.randint(0, 2**32, (n, 256), dtype=np.uint32)
    h = tables[0][codes[: len(codes) - n + 1]]
    for k in range(1, n):
        h = h + tables[k][codes[k : len(codes) - n + 1 + k]]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - BITS)


def _repeats(data: np.ndarray, offsets: np.ndarray, rows: int) -> np.ndarray:
    """Indicators of word 2-, 3- and 4-grams whose words are all equal, and of the same over every second word."""
    out = np.zeros((rows, 4), bool)
    row, _, _, h = words(data, offsets)
    same = (h[1:] == h[:-1]) & (row[1:] == row[:-1]) if len(h) > 1 else np.zeros(0, bool)
    run = same
    for k in range(3):
        out[row[: len(run)][run], k] = True
        run = run[:-1] & same[k + 1 :] if len(run) > 1 else run[:0]
    if len(h) > 5:
        two = (h[2:] == h[:-2]) & (row[2:] == row[:-2])
        run = two[:-3] & two[1:-2] & two[2:-1] & two[3:]
        out[row[: len(run)][run], 3] = True
    return out


def _windows(data: np.ndarray, width: int):
    for a in range(0, len(data), WINDOW):
        yield a, data[a : a + WINDOW + width - 1]


def marked(data: np.ndarray, offsets: np.ndarray, chosen: Selected, repeats: bool) -> np.ndarray:
    """Rows x features, True where the text holds the feature; the last four are word repeats if asked for."""
    rows = len(offsets) - 1
    out = np.zeros((rows, chosen.size + 1 + 4 * repeats), bool)
    for family in chosen.families:
        make, n = FAMILIES[family]
        for a, piece in _windows(data, n):
            if len(piece) < n:
                continue
            found = chosen.table(family)[_buckets(make()[piece], family)]
            at = np.flatnonzero(found)
            row = np.searchsorted(offsets, a + at, "right") - 1
            inside = a + at + n <= offsets[row + 1]
            out[row[inside], found[at[inside]]] = True
    if repeats:
        out[:, chosen.size + 1 :] = _repeats(data, offsets, rows)
    return out[:, 1:]


def document_counts(texts: pa.ChunkedArray, families) -> np.ndarray:
    """How many texts of a bounded sample hold each bucket, family-major; a window of texts is in memory at a time."""
    data, offsets = utf8(texts)
    out = np.zeros(len(families) << BITS, np.float32)
    for start, end in row_slices(offsets, WINDOW):
        own = offsets[start : end + 1] - offsets[start]
        piece = data[offsets[start] : offsets[end]]
        row = np.repeat(np.arange(end - start, dtype=np.int32), np.diff(own))
        for f, family in enumerate(families):
            make, n = FAMILIES[family]
            if len(piece) < n:
                continue
            h = _buckets(make()[piece], family).astype(np.int64)
            whole = row[: len(h)] == row[n - 1 :]
            key = np.unique((row[: len(h)][whole].astype(np.int64) << BITS) | h[whole])
            out[f << BITS : (f + 1) << BITS] += np.bincount(key & ((1 << BITS) - 1), minlength=1 << BITS)
    return out


def sample_marks(texts: pa.ChunkedArray, chosen: Selected, repeats: bool) -> np.ndarray:
    data, offsets = utf8(texts)
    parts = [marked(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], chosen, repeats) for a, b in row_slices(offsets, WINDOW)]
    return np.concatenate(parts) if parts else np.zeros((0, chosen.size + 4 * repeats), bool)


def scores(texts, model: "Linear") -> np.ndarray:
    """Rows x outputs: weights of the features that each whole text holds, plus the bias."""
    data, offsets = utf8(texts)
    out = np.empty((len(offsets) - 1, len(model.bias)), np.float32)
    for a, b in row_slices(offsets, WINDOW):
        x = marked(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], model.chosen, model.repeats).astype(np.float32)
        if model.unit:
            x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        out[a:b] = x @ model.weights + model.bias
    return out


@dataclass
class Linear:
    chosen: Selected
    weights: np.ndarray  # features x outputs
    bias: np.ndarray
    repeats: bool = False
    unit: bool = False  # rows scaled to unit length


def share_of(id_column: str, seed: int) -> Column:
    """A keyed hash of the id as a number from 0 up to 1."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_column)), F.lit(1 << 30)) / float(1 << 30)


def bounded_share(wanted: int, there: int) -> float:
    """The share of rows to draw by hash, so low that ``wanted`` is passed once in tens of thousands of draws."""
    return 1.0 if there <= wanted else max(0.0, wanted - 4 * wanted**0.5) / there


def labelled_ids(labels: DataFrame, value: Column, folds: int, held_out: int, per_value: int, max_values: int) -> tuple[DataFrame, dict]:
    """``doc_id, value`` of about ``per_value`` learnable ids for each value, drawn by a hash of the id, and how many there are of each.

    Rows with a null id or value and those of the held-out fold are not learnt
    from; an id with several values has the greatest.
    """
    learnt = labels.select("doc_id", value.alias("value")).filter(F.col("value").isNotNull() & (part("doc_id", folds) != held_out))
    learnt = learnt.groupBy("doc_id").agg(F.max("value").alias("value"))
    counts = {r[0]: r[1] for r in learnt.groupBy("value").count().limit(max_values + 1).collect()}
    if len(counts) > max_values:
        raise ValueError(f"more than {max_values} values to learn: raise the limit or merge some")
    share = F.lit(0.0)
    for v, n in counts.items():
        share = F.when(F.col("value") == F.lit(v), bounded_share(per_value, n)).otherwise(share)
    return learnt.filter(share_of("doc_id", 0) < share), counts


def labelled_texts(documents: DataFrame, ids: DataFrame, max_bytes: int) -> DataFrame:
    """``doc_id, text, value`` of the ids (a bounded number), in one scan of documents; a repeated id counts once."""
    texts = documents.select("doc_id", "text").filter(F.octet_length("text") <= max_bytes)
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("value").alias("value"))


def fitted(sample: DataFrame, fit: Callable[[pa.Table], object]):
    """fit over a bounded sample, in order of its first column, in one task; only what it returns comes to the driver."""
    first = sample.columns[0]

    def run(batches):
        got = list(batches)
        if got:
            model = pickle.dumps(fit(pa.Table.from_batches(got).sort_by(first)))
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    rows = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(rows[0][0]) if rows else fit(sample.limit(0).toArrow())


def texts_of(table: pa.Table, value, most: int) -> pa.ChunkedArray:
    """At most ``most`` texts of the rows with a value."""
    return table.filter(pc.equal(table.column("value"), value)).column("text").slice(0, most)


def scored(documents: DataFrame, model, fields: str, rows_of, keep=("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns with computed ones: rows_of(batch, model) -> list of Arrow arrays, one for each of ``fields``.

    The model goes along with the tasks; it holds a bounded number of weights.
    """
    read = text if text in keep else _READ
    source = documents.select(*keep, *([] if text in keep else [F.col(text).alias(_READ)]))
    passed = [f"`{c}` {t}" for c, t in source.dtypes if c != _READ]
    names = [*keep, *(x.split()[0] for x in fields.split(","))]
    if len(set(names)) < len(names):
        raise ValueError(f"rename columns before they are kept: {names}")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + rows_of(batch.column(read), model), names=names)

    return source.mapInArrow(run, ", ".join([*passed, fields]))
