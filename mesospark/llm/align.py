"""Alignment of two tokenizers over the bytes of each text.

All documents of a slice advance together: one vector holds each document's place
in its A tokens, one that in its B tokens. A step emits the link of every
document's two tokens, and a cut where both end; the token that ends
first gives way to its successor, both where they end together. Finished documents
leave the vectors. A long text is entered at several places, each of which goes on
to where the next one began, so that it does not hold up the others.

How often an id pair is linked is a count over the whole corpus. Tasks put the
pairs of a chunk of documents (``CHUNK`` bytes) together before anything is
shuffled; the chunk asks for the counts of its pairs, each once, so a pair that is
everywhere costs one row a chunk, and documents meet the answers of their own chunk.

Defined cases: a text that is null or empty, or that either tokenizer does not give
back byte for byte, has no tokens and zeros; special tokens written in a
text are plain text; repeated rows are counted as often as they occur; other
columns are ignored, whatever their names, unless they are kept; a task holds the tokens of one
slice of texts, or of one longer text.
"""

import hashlib
import json
import os
import re
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mesospark.llm.blocks import row_slices, utf8
from mesospark.plans.lineage import ensure_checkpoint_dir

SLICE = 1 << 21  # bytes of text tokenized and aligned at a time
CHUNK = 1 << 24  # bytes of text whose pairs are counted together
LANE = 4096  # bytes of a text between two places at which it is entered


def _byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others moved up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


#: Fixed value: how a byte-level pre-tokenizer parts text into words.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLANKS = re.compile(r"\s{10000}")  # runs for which its look-ahead takes too many steps


def _by_rank(file: dict, token_bytes: list[bytes]):
    """An encoder that merges by id, where that is the file's own rule; else None.

    It is if the text is taken as it is, and each merge makes the next id, so that the
    earliest merge that applies is the one with the least id.
    """
    import tiktoken

    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not file.get("normalizer")
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    single = len(model["vocab"]) - len(pairs)
    if not plain or single != 256 or any(model["vocab"].get(a + b) != single + i for i, (a, b) in enumerate(pairs)):
        return None
    return tiktoken.Encoding("file", pat_str=_WORDS, mergeable_ranks={token_bytes[i]: i for i in model["vocab"].values()}, special_tokens={})


class Vocabularies:
    """Both tokenizers, with the bytes of each of their ids."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to other tasks
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_buffer(a_file), SentencePieceProcessor(model_proto=b_file)
        self.a.encode_special_tokens = True
        byte, file = _byte_of_character(), json.loads(a_file)
        entries = {i: token for token, i in file["model"]["vocab"].items()}
        self.a_bytes = [bytes(byte[c] for c in entries[i]) if i in entries and all(c in byte for c in entries[i]) else b"" for i in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.fast = _by_rank(file, self.a_bytes)
        self.a_length, self.b_length = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        #: Each id as text, once within a group and once as the last of its side.
        self.written = [f"{i}{end}" for n, last in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";")) for i in range(n) for end in (",", last)]

    def encode(self, texts: list[str]) -> tuple[list, list]:
        """Ids of A (of the text after a blank) and of B; both are empty where the bytes differ."""
        a = [self.fast.encode_ordinary(" " + t) if self.fast and not _BLANKS.search(t) else self.a.encode(" " + t, add_special_tokens=False).ids for t in texts]
        b = self.b.encode(texts, num_threads=1)
        for i, text in enumerate(texts):
            want = b" " + text.encode()
            if not text or b"".join(map(self.a_bytes.__getitem__, a[i])) != want or b"".join(map(self.b_bytes.__getitem__, b[i])) != want:
                a[i], b[i] = [], []
        return a, b


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (places in A and in B) in order, and where A and where B tokens end a group.

    ``a_ends`` and ``b_ends`` are byte ends of tokens, none of them empty, over
    documents laid end to end; ``starts`` and ``stops`` are the byte ranges of
    lanes, each within a document, which together cover all documents. A lane
    emits the links whose overlap begins in its range.
    """
    i, j = np.searchsorted(a_ends, starts, "right"), np.searchsorted(b_ends, starts, "right")
    room = np.searchsorted(a_ends, stops, "left") - i + np.searchsorted(b_ends, stops, "left") - j + 2
    slot = np.cumsum(room) - room
    links_a, links_b = np.full((2, int(room.sum())), -1, np.int64)
    cut_a, cut_b = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    begun = np.maximum(np.where(i > 0, a_ends[i - 1], 0), np.where(j > 0, b_ends[j - 1], 0)) if len(i) else starts
    mine = begun >= starts  # the link in which an inner lane starts belongs to the lane before
    while len(i):
        links_a[slot[mine]], links_b[slot[mine]] = i[mine], j[mine]
        slot = slot + mine
        x, y = a_ends[i], b_ends[j]
        both = x == y
        cut_a[i[both]] = cut_b[j[both]] = True
        i, j = i + (x <= y), j + (y <= x)
        going = np.minimum(x, y) < stops
        mine = np.ones(len(i), bool)
        if not going.all():
            i, j, slot, stops, mine = i[going], j[going], slot[going], stops[going], mine[going]
    found = links_a >= 0
    return links_a[found], links_b[found], cut_a, cut_b


def _lanes(lengths: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of at most ``lane`` bytes that cover documents of these lengths laid end to end."""
    n = -(-lengths // lane)
    ends = np.cumsum(lengths)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(ends - lengths, n) + k * lane
    return starts, np.minimum(starts + lane, np.repeat(ends, n))


class Aligned:
    """The tokens, links and cuts of some documents, laid end to end."""

    def __init__(self, vocabularies: Vocabularies, texts: list[str], lane: int = LANE):
        a, b = vocabularies.encode(texts)
        self.vocabularies = vocabularies
        self.n_a, self.n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        self.a, self.b = (np.fromiter((i for ids in side for i in ids), np.int64, int(n.sum())) for side, n in ((a, self.n_a), (b, self.n_b)))
        a_ends, b_ends = np.cumsum(vocabularies.a_length[self.a]), np.cumsum(vocabularies.b_length[self.b])
        self.a_row, self.b_row = np.repeat(np.arange(len(texts)), self.n_a), np.repeat(np.arange(len(texts)), self.n_b)
        lengths = np.bincount(self.a_row, vocabularies.a_length[self.a], len(texts)).astype(np.int64)
        self.link_a, self.link_b, self.cut_a, self.cut_b = lockstep(a_ends, b_ends, *_lanes(lengths, lane))
        self.link_row = self.a_row[self.link_a]
        self.n_links = np.bincount(self.link_row, minlength=len(texts))
        self.n_groups = np.bincount(self.a_row[self.cut_a], minlength=len(texts))

    def groups(self) -> list[str]:
        """The groups of each document as text: ``a1,a2|b1;a3|b2,b3``."""
        group_a, group_b = (np.cumsum(cut) - cut for cut in (self.cut_a, self.cut_b))
        b_before = np.concatenate([[0], np.flatnonzero(self.cut_b) + 1])  # B tokens before each group
        a_through = np.flatnonzero(self.cut_a) + 1  # A tokens up to the end of each group
        codes = np.zeros(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + b_before[group_a]] = 2 * self.a + self.cut_a
        codes[np.arange(len(self.b)) + a_through[group_b]] = 2 * (self.b + len(self.vocabularies.a_bytes)) + self.cut_b
        ends, words = np.cumsum(self.n_a + self.n_b), list(map(self.vocabularies.written.__getitem__, codes.tolist()))
        return ["".join(words[e - n : e])[:-1] for e, n in zip(ends.tolist(), (self.n_a + self.n_b).tolist(), strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, pair and number of links of each document's distinct id pairs; a pair is ``a * len(B) + b``."""
        width = len(self.vocabularies.b_bytes)
        pair = self.a[self.link_a] * width + self.b[self.link_b]
        order = np.lexsort((pair, self.link_row))
        row, pair = self.link_row[order], pair[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])])) if len(row) else np.zeros(0, np.int64)
        return row[new], pair[new], np.diff(np.append(new, len(row)))


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _vocabularies(spark, a_path: str, b_path: str):
    """Both files, read by the driver and sent to the tasks (they are as large as two vocabularies)."""
    return spark.sparkContext.broadcast((Path(a_path).read_bytes(), Path(b_path).read_bytes()))


def align(documents: DataFrame, a_path: str, b_path: str, *, keep: tuple[str, ...] = ("doc_id",), lane: int = LANE) -> DataFrame:
    """The kept columns, then ``a_ids, b_ids`` (token ids), ``link_a, link_b`` (places of linked tokens from 0) and ``cut_a, cut_b`` (tokens of A and of B before the end of each group)."""
    files = _vocabularies(documents.sparkSession, a_path, b_path)
    added = ["a_ids", "b_ids", "link_a", "link_b", "cut_a", "cut_b"]
    if set(added) & set(keep):
        raise ValueError(f"rename the kept columns {sorted(set(added) & set(keep))}")

    def aligned(batches):
        vocabularies = Vocabularies(*files.value)
        for batch in batches:
            texts = batch.column("_text")
            for start, end in row_slices(utf8(texts)[1], SLICE):
                found = Aligned(vocabularies, texts.slice(start, end - start).to_pylist(), lane)
                first_a, first_b = np.cumsum(found.n_a) - found.n_a, np.cumsum(found.n_b) - found.n_b
                at_a, at_b = np.flatnonzero(found.cut_a), np.flatnonzero(found.cut_b)
                lists = [(found.a, found.n_a), (found.b, found.n_b), (found.link_a - first_a[found.link_row], found.n_links), (found.link_b - first_b[found.link_row], found.n_links)]
                lists += [(at_a + 1 - first_a[found.a_row[at_a]], found.n_groups), (at_b + 1 - first_b[found.b_row[at_b]], found.n_groups)]
                kept = [batch.column(c).slice(start, end - start) for c in keep]
                yield pa.RecordBatch.from_arrays(kept + [_lists(v, n, pa.int32()) for v, n in lists], [*keep, *added])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema] + [f"{c} array<int>" for c in added])
    return documents.select(*keep, F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(aligned, fields)


_COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>, chunk long, chunk_pairs array<long>, chunk_times array<long>"


def _chunk_row(chunk: int, pairs: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """The row that stands for a chunk: its distinct pairs, in the order by which its documents name them."""
    names = [field.split()[0] for field in _COUNTED.split(", ")]
    filled = {"chunk": pa.array([chunk], pa.int64()), "chunk_pairs": _lists(pairs, [len(pairs)], pa.int64()), "chunk_times": _lists(times, [len(times)], pa.int64())}
    kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([filled[n] if n in filled else pa.nulls(1, kinds[i]) for i, n in enumerate(names)], names)


def _counted(documents: DataFrame, files) -> DataFrame:
    """A row for each document, whose ``pairs`` are places in the pairs of its chunk, and a row for each chunk."""
    names = [field.split()[0] for field in _COUNTED.split(", ")]

    def close(chunk, held):
        """The documents of a chunk, then its own row."""
        rows, counts, pairs, times = ([h[k] for h in held] for k in range(4))
        distinct, place = np.unique(np.concatenate(pairs), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, np.concatenate(times))
        often = np.argsort(-total, kind="stable")  # frequent pairs get small numbers, which pack well
        rank = np.empty(len(often), np.int64)
        rank[often] = np.arange(len(often))
        place, at = rank[place], 0
        for columns, n, own in zip(rows, counts, times, strict=True):
            lists = [_lists(place[at : at + len(own)], n, pa.int32()), _lists(own, n, pa.int32())]
            none = [pa.nulls(len(n), pa.list_(pa.int64()))] * 2
            yield pa.RecordBatch.from_arrays([*columns, *lists, pa.array(np.full(len(n), chunk), pa.int64()), *none], names)
            at += len(own)
        yield _chunk_row(chunk, distinct[often], total[often])

    def counted(batches):
        vocabularies, chunk, held, size = Vocabularies(*files.value), TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            texts = batch.column("text")
            offsets = utf8(texts)[1]
            for start, end in row_slices(offsets, SLICE):
                found = Aligned(vocabularies, texts.slice(start, end - start).to_pylist())
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.groups()]
                row, pair, times = found.pairs()
                columns = [batch.column("doc_id").slice(start, end - start)] + [pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)] + [pa.array(digests, pa.string())]
                held.append((columns, np.bincount(row, minlength=end - start), pair, times))
                size += int(offsets[end] - offsets[start])
                if size >= CHUNK:
                    yield from close(chunk, held)
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield from close(chunk, held)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(counted, _COUNTED)


def _answer(documents: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The links of a chunk's documents by the corpus-wide counts of their pairs."""
    count, best = np.zeros(len(answers), np.int64), np.zeros(len(answers), bool)
    count[answers["place"]], best[answers["place"]] = answers["count"], answers["best"]
    n = documents["pairs"].map(len).to_numpy(np.int64)
    row = np.repeat(np.arange(len(documents)), n)
    pairs, times = (np.concatenate([*documents[c], np.zeros(0, np.int64)]).astype(np.int64) for c in ("pairs", "times"))
    out = documents[["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].copy()
    for name, value in (("n_best", times * best[pairs]), ("count_sum", times * count[pairs])):
        total = np.zeros(len(documents), np.int64)
        np.add.at(total, row, value)
        out[name] = total
    return out


STATISTICS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


def pair_statistics(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each document.

    ``n_best`` counts the links whose pair is the most frequent of its B id in the
    corpus, ``count_sum`` adds the counts of all links. Texts are tokenized once;
    what the tasks found is written to the shared folder, where it stays, as the result reads it.
    """
    spark = documents.sparkSession
    files = _vocabularies(spark, a_path, b_path)
    width = Vocabularies(*files.value).b.get_piece_size()
    path = f"{ensure_checkpoint_dir(spark)}/aligned-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    _counted(documents, files).write.option("compression", "zstd").parquet(path)
    found = spark.read.parquet(path)
    chunks = found.filter("chunk_pairs IS NOT NULL")
    counts = chunks.select(F.explode(F.arrays_zip("chunk_pairs", "chunk_times")).alias("p")).groupBy(F.col("p.chunk_pairs").alias("pair")).agg(F.sum("p.chunk_times").alias("count"))
    of_b = Window.partitionBy(F.pmod("pair", F.lit(width)))  # at most as many rows as A has ids
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(of_b))
    asked = chunks.select(F.col("chunk").alias("asking"), F.posexplode("chunk_pairs").alias("place", "pair"))
    answers = asked.join(counts, "pair").select("asking", "place", "count", "best")
    rows = found.filter("chunk_pairs IS NULL").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    return rows.groupBy("chunk").cogroup(answers.groupBy("asking")).applyInPandas(_answer, STATISTICS)
