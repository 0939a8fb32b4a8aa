"""Benchmark decontamination with an FM-index for each shard of the training text.

A task gathers documents into a shard, encodes their words over the words of
the benchmark, and builds an FM-index of it: suffix order, Burrows-Wheeler
transform in a wavelet tree, and sampled suffix positions. All benchmark
windows are then searched backwards at once through wavelet-tree ranks, their
occurrences located, and the word spans of each document merged.

A window is ``size`` consecutive words of an item, or all words of a shorter
item. Words that no window holds end a run; runs shorter than the shortest
window can hold no occurrence and are left out of the index, which is exact.
Nothing is shuffled: benchmark windows go to the tasks in blocks of at most
``block_words`` words, one narrow pass over the documents each.

Defined cases: a null or wordless text has no words, no hits and is clean;
items with null id or without words are ignored, items with one id are one
item; repeated document rows are judged each; other columns are ignored unless
kept, and a kept one may not have the name of a result.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesospark.llm.blocks import WINDOW, utf8
from mesospark.plans.lineage import cut

_READ = "the text that is read"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words_of(text: str | bytes | None) -> list[bytes]:
    """A-Z lower-cased, then runs of digits, a-z and everything beyond ASCII."""
    if not text:
        return []
    return WORD.findall((text.encode() if isinstance(text, str) else text).translate(_ASCII_LOWER))


class WaveletTree:
    """Rank over a sequence of small integers, one bit vector for each bit of the alphabet, highest first."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.zeros, self.ranks = bits, [], []
        for b in reversed(range(bits)):
            bit = (seq >> b) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(seq) - int(self.ranks[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        low, high = np.zeros_like(end), end
        for level, b in enumerate(reversed(range(self.bits))):
            ones = (symbol >> b) & 1
            l1, h1 = self.ranks[level][low], self.ranks[level][high]
            low = np.where(ones, self.zeros[level] + l1, low - l1)
            high = np.where(ones, self.zeros[level] + h1, high - h1)
        return high - low


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order, by prefix doubling; only ties are sorted again. seq ends with a unique least symbol."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    first = np.concatenate([[True], seq[order][1:] != seq[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # a group's rank: where it begins
    step, open_ = 1, np.flatnonzero(~(first & np.append(first[1:], True)))
    while len(open_):
        at = order[open_]
        group, second = rank[at], rank[np.minimum(at + step, n - 1)]
        by = np.lexsort((second, group))
        at, group, second = at[by], group[by], second[by]
        order[open_] = at
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone]
        step *= 2
    return order


class FMIndex:
    """Count and locate over integer sequences (symbols from 1; 0 is the end mark)."""

    def __init__(self, seq: np.ndarray, alphabet: int, every: int = 8):
        seq = np.append(seq, 0).astype(np.int64)
        order = suffix_order(seq)
        self.tree = WaveletTree(seq[order - 1], max(1, int(alphabet).bit_length()))
        self.bwt = seq[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=alphabet + 1))])
        sampled = order % every == 0
        self.sampled, self.sample_rank, self.samples = sampled, np.concatenate([[0], np.cumsum(sampled)]), order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of equally long patterns (one a row), by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        live = np.arange(len(patterns))
        for k in reversed(range(patterns.shape[1])):
            c = patterns[live, k]
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
            live = live[high[live] > low[live]]
        high[high < low] = low[high < low]
        done = np.setdiff1d(np.arange(len(patterns)), live)
        high[done] = low[done]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: steps back through the text until a sampled position."""
        rows, steps, out = rows.copy(), 0, np.full(len(rows), -1, np.int64)
        live = np.arange(len(rows))
        while len(live):
            hit = self.sampled[rows[live]]
            out[live[hit]] = self.samples[self.sample_rank[rows[live[hit]]]] + steps
            live = live[~hit]
            c = self.bwt[rows[live]]
            rows[live] = self.before[c] + self.tree.rank(c, rows[live])
            steps += 1
        return out


class Patterns:
    """The distinct windows of a block of items, by length, and the items that hold each (as numbers of sorted ``items``)."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.items = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.items)}
        windows: dict[tuple[bytes, ...], set[int]] = {}
        for item, text in items:
            w = words_of(text)
            for i in range(max(1, len(w) - size + 1) if w else 0):
                windows.setdefault(tuple(w[i : i + size]), set()).add(number[item])
        self.ids = {w: i + 2 for i, w in enumerate(sorted({x for k in windows for x in k}))}  # 1 parts runs
        ordered = sorted(windows, key=lambda k: (len(k), k))
        self.by_length: list[np.ndarray] = []
        for n in sorted({len(k) for k in windows}):
            self.by_length.append(np.array([[self.ids[x] for x in k] for k in ordered if len(k) == n], np.int64))
        # the owners of window k, in the order of by_length, are owners[begin[k] : begin[k + 1]]
        self.owners = np.array([i for k in ordered for i in sorted(windows[k])], np.int64)
        self.begin = np.concatenate([[0], np.cumsum([len(windows[k]) for k in ordered])]).astype(np.int64)
        self.shortest = min((len(k) for k in windows), default=0)


def _ragged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [begin, end): which range, and each number in it."""
    n = end - begin
    which = np.repeat(np.arange(len(n)), n)
    return which, begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


class Shard:
    """Runs of benchmark words of some documents, with the document and word position of each symbol."""

    def __init__(self, patterns: Patterns):
        self.patterns, self.symbols, self.rows, self.at, self.size = patterns, [], [], [], 0

    def add(self, row: int, codes: np.ndarray) -> None:
        """codes: the number of each word of a document (1 for words of no window)."""
        if not self.patterns.shortest:
            return
        known = np.concatenate([[0], (codes > 1).view(np.int8), [0]])
        edge = np.diff(known)
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if b - a >= self.patterns.shortest:
                self.symbols += [codes[a:b], np.ones(1, np.int32)]
                self.rows.append(np.full(b - a + 1, row))
                self.at.append(np.arange(a, b + 1))
                self.size += b - a + 1

    def hits(self) -> tuple[np.ndarray, np.ndarray]:
        """Merged spans (rows of document, begin, end) and the distinct pairs of document and item."""
        spans, pairs, base = [np.zeros((0, 3), np.int64)], [np.zeros((0, 2), np.int64)], 0
        if self.size:
            index = FMIndex(np.concatenate(self.symbols), len(self.patterns.ids) + 1)
            rows, at = np.concatenate(self.rows), np.concatenate(self.at)
            for windows in self.patterns.by_length:
                low, high = index.search(windows)
                which, places = _ragged(low, high)
                found = index.locate(places)
                spans.append(merged(np.stack([rows[found], at[found], at[found] + windows.shape[1]], 1)))
                once = np.unique(rows[found] * len(windows) + which)
                doc, window = once // len(windows), once % len(windows) + base
                own, k = _ragged(self.patterns.begin[window], self.patterns.begin[window + 1])
                pairs.append(np.stack([doc[own], self.patterns.owners[k]], 1))
                base += len(windows)
        return merged(np.concatenate(spans)), np.unique(np.concatenate(pairs), axis=0)


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of word spans (rows of document, begin, end), in order; spans that touch become one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    room = spans[:, 2].max() + 2
    begin, end = spans[:, 0] * room + spans[:, 1], spans[:, 0] * room + spans[:, 2]
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.append(True, begin[1:] > reach[:-1]))
    last = np.append(first[1:], len(spans)) - 1
    return np.stack([spans[first, 0], spans[first, 1], reach[last] - spans[first, 0] * room], 1)


def _codes(raw: bytes, get) -> np.ndarray:
    """The numbers of the words of a text; a list of the words is made only of a text that is not very long."""
    low = raw.translate(_ASCII_LOWER)
    words = WORD.findall(low) if len(low) <= WINDOW else (m[0] for m in WORD.finditer(low))
    return np.fromiter((get(w, 1) for w in words), np.int32)


def _list_array(rows: np.ndarray, values, n: int) -> pa.Array:
    """Lists of the values of each of n rows; rows are in order."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _scan(batch: pa.RecordBatch, read: str, patterns: Patterns, shard_words: int, later: bool) -> tuple[pa.Array, pa.Array, pa.Array]:
    """n_words, spans and items of a batch; those that an earlier block has found are merged in."""
    data, offsets = utf8(batch.column(read))
    n = batch.num_rows
    counts, spans, pairs = np.zeros(n, np.int64), [], []
    raw, shard, get = data.tobytes(), Shard(patterns), patterns.ids.get
    for i in range(n):
        codes = _codes(raw[offsets[i] : offsets[i + 1]], get)
        counts[i] = len(codes)
        shard.add(i, codes)
        if shard.size >= shard_words:
            for into, x in zip((spans, pairs), shard.hits(), strict=True):
                into.append(x)
            shard = Shard(patterns)
    for into, x in zip((spans, pairs), shard.hits(), strict=True):
        into.append(x)
    spans, pairs = np.concatenate(spans), np.unique(np.concatenate(pairs), axis=0)
    items = pa.array(patterns.items, pa.string()).take(pa.array(pairs[:, 1]))
    if not later:
        spans = merged(spans)
        return pa.array(counts), _list_array(np.repeat(spans[:, 0], 2), pa.array(spans[:, 1:].astype(np.int32).ravel()), n), _list_array(pairs[:, 0], items, n)
    before, known = batch.column("spans"), batch.column("items")
    old = np.asarray(before.flatten(), np.int64).reshape(-1, 2)
    old_row = np.repeat(np.arange(n), np.asarray(pc.list_value_length(before)) // 2)
    spans = merged(np.concatenate([spans, np.c_[old_row, old]]))
    new = _list_array(pairs[:, 0], items, n)
    both = pa.array([sorted({*a, *b}) for a, b in zip(known.to_pylist(), new.to_pylist(), strict=True)], pa.list_(pa.string()))
    return pa.array(counts), _list_array(np.repeat(spans[:, 0], 2), pa.array(spans[:, 1:].astype(np.int32).ravel()), n), both


def benchmark_blocks(benchmark: DataFrame, block_words: int):
    """Items in blocks of bounded size; one block at a time is on the driver."""
    block, size = [], 0
    for item, text in benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string"), "text").toLocalIterator():
        block.append((item, text))
        size += len(words_of(text))
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(documents: DataFrame, benchmark: DataFrame, *, size: int = 13, block_words: int = 1_000_000, shard_words: int = 1_000_000, keep=("doc_id", "text")) -> DataFrame:
    """The kept columns with ``n_words long, spans array<int>`` (merged word spans, begin and end in turn) and ``items array<string>``.

    The result of each block but the last is cut, so that the windows of one
    block alone are held by the driver and the tasks.
    """
    if clash := {"n_words", "spans", "items", _READ} & set(keep):
        raise ValueError(f"rename columns before they are kept: {sorted(clash)}")
    spark = documents.sparkSession
    out = documents.select(*keep, *([] if "text" in keep else [F.col("text").alias(_READ)]))
    block, held = None, None
    for following in _then_none(benchmark_blocks(benchmark, block_words)):
        if block is not None:
            out, used = _pass(spark, out, keep, Patterns(block, size), shard_words, held is not None, following is not None)
            if following is not None:
                out = cut(out)
                used.destroy()
            held = used
        block = following
    return out if held else _pass(spark, out, keep, Patterns([], size), shard_words, False, False)[0]


def _then_none(blocks):
    yield from blocks
    yield None


def _pass(spark, df: DataFrame, keep, patterns: Patterns, shard_words: int, later: bool, with_text: bool):
    held = spark.sparkContext.broadcast(patterns)
    read = "text" if "text" in keep else _READ
    names = [*keep, *([_READ] if with_text and read == _READ else [])]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c in names), "n_words long, spans array<int>, items array<string>"])

    def run(batches):
        for batch in batches:
            found = _scan(batch, read, held.value, shard_words, later)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found], names=[*names, "n_words", "spans", "items"])

    return df.mapInArrow(run, schema), held


def judged(found: DataFrame) -> DataFrame:
    """Adds ``n_hit long, n_items long, items_sha256 string, contaminated boolean`` (at least a twentieth of the words hit)."""
    n_hit = F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (s, x) -> s + x)")
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def without_spans(text: str | None, spans: list[int]) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if not text or not spans:
        return text
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.translate(_ASCII_LOWER))]
    kept, last = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        kept.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, raw[last:]]).decode()


def remove_spans(found: DataFrame, text: str = "text", into: str = "clean_text") -> DataFrame:
    """Adds the text without its merged removal spans."""
    schema = ", ".join([*(f"`{c}` {t}" for c, t in found.dtypes), f"`{into}` string"])

    def run(batches):
        for batch in batches:
            texts = [without_spans(t, s or []) for t, s in zip(batch.column(text).to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    return found.mapInArrow(run, schema)


def brute_force(text: str | None, items: list[tuple[str, str]], size: int = 13) -> tuple[int, int, str]:
    """n_words, n_hit and the hash of the items by comparing every position; for tests."""
    w, hit, owners = words_of(text), set(), set()
    for item, t in items:
        v = words_of(t)
        for i in range(max(1, len(v) - size + 1) if v else 0):
            k = v[i : i + size]
            for j in range(len(w) - len(k) + 1):
                if w[j : j + len(k)] == k:
                    hit.update(range(j, j + len(k)))
                    owners.add(item)
    return len(w), len(hit), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
