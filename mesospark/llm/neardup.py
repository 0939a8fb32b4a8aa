"""MinHash near-duplicate detection with ProbMinHash signatures.

A document is its set of five-word shingles. The sketch takes weights; here each
distinct shingle has weight 1, however often it occurs, so that the sketch
estimates the very similarity that is verified.
Each shingle runs a Poisson process whose rate is its weight; an arrival goes
to a random register, and a register keeps the shingle that arrived first. A
process stops at the time by which every register is filled (early
termination). Two registers agree with the probability Jaccard similarity.
Bands of registers give candidate buckets, and candidates are verified on the
exact Jaccard similarity of their shingle sets.

Texts with the same words are one node before banding, and an id with several
texts is as many nodes. In a bucket every node is compared with one pivot first;
only nodes of one bucket that are still in different components are joined
further, and only where the shingles that they share with any node at all leave
room for the threshold. So no bucket is expanded into all pairs, and every
candidate pair is compared, connected already, or too far apart by count.

Defined cases: null, empty and wordless texts and null ids are never duplicates
of anything; texts of under five words are one shingle; repeated rows of one id
are one document, and an id with several texts ties their classes together; other columns are ignored; an empty table gives an empty one.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesospark.llm.blocks import mix64, row_slices, utf8, words
from mesospark.operators.components import connected_components
from mesospark.plans.lineage import cut

SHINGLE = 5
CHUNK = 1 << 21
SMALL = 256  # sets of so many shingles are compared within the join, larger ones after it
_FACTORS = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct shingles of each row (rows in order), and two hashes of each row's words."""
    n = len(offsets) - 1
    row, _, _, h = words(data, offsets)
    counts = np.bincount(row, minlength=n)
    nth = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
    whole = np.zeros((2, n), np.uint64)
    for k in range(2):
        np.add.at(whole[k], row, mix64(h + (nth + np.uint64(1)) * _FACTORS[k]))
    full = max(0, len(h) - SHINGLE + 1)
    inside = row[:full] == row[len(row) - full :] if full else np.zeros(0, bool)
    s = np.zeros(full, np.uint64)
    for k in range(SHINGLE if full else 0):
        s += mix64(h[k : k + full]) * _FACTORS[k]
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    rows = np.concatenate([row[:full][inside], short])
    s = mix64(np.concatenate([s[inside], whole[0][short]]))
    order = np.lexsort((s, rows))
    rows, s = rows[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    return rows[at], s[at], np.diff(np.append(at, len(s))), whole[0], whole[1]


def prob_min_hash(rows: np.ndarray, ids: np.ndarray, weights: np.ndarray, n: int, registers: int) -> np.ndarray:
    """n x registers: the element that arrives first in each register of each row (0 in rows without elements)."""
    first, winner = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
    row, element, rate, time, key = rows.astype(np.int64), ids, weights, np.zeros(len(ids)), ids.copy()
    while len(row):
        key = key + _STEP
        a = mix64(key)
        time = time - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        at = row * registers + (mix64(a ^ _STEP) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        winner[at[won]] = element[won]
        live, inverse = np.unique(row, return_inverse=True)
        limit = first.reshape(n, registers)[live].max(1)
        go = time < limit[inverse]
        row, element, rate, time, key = row[go], element[go], rate[go], time[go], key[go]
    return winner.reshape(n, registers)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    n, registers = signature.shape
    size = registers // bands
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (n, 1))
    for k in range(size):
        key = mix64(key ^ (signature[:, k::size][:, :bands] * _FACTORS[k % len(_FACTORS)]))
    return key


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _shingled(documents: DataFrame, outputs, fields: str) -> DataFrame:
    """``k1, k2``, two hashes of a text's words, and what ``outputs`` makes of the row numbers, shingles and size of a slice; ``doc_id`` before them."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in row_slices(offsets, CHUNK):
                row, s, _, k1, k2 = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), outputs(row, s, b - a)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", fields.split()[0]])

    source = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, k1 long, k2 long, {fields}")


def signatures(documents: DataFrame, bands: int, rows: int) -> DataFrame:
    """``doc_id, k1, k2, bands array<long>``: two hashes of the words and the band keys (none without words)."""

    def keys(row, s, n):
        signature = prob_min_hash(row, s, np.ones(len(s)), n, bands * rows)
        has = np.isin(np.arange(n), row)
        return _lists(band_keys(signature[has], bands).ravel(), has * bands)

    return _shingled(documents.filter(F.col("doc_id").isNotNull()), keys, "bands array<long>")


def shingle_sets(documents: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, shingles array<long>`` of the texts ``node, least, k1, k2``, each of which is found among the rows of the id ``least``."""
    wanted = documents.join(texts.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = _shingled(wanted, lambda row, s, n: _lists(s, np.bincount(row, minlength=n)), "shingles array<long>")
    # an id may have other texts, and the same text in several rows
    once = sets.groupBy("k1", "k2").agg(F.first("shingles").alias("shingles"))
    return once.join(texts.select("k1", "k2", "node"), ["k1", "k2"]).select("node", "shingles")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a, b`` whose exact Jaccard similarity reaches the threshold."""
    sized = sets.withColumn("n", F.size("shingles"))
    left = sized.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("n").alias("na"))
    right = sized.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("n").alias("nb"))
    # sizes alone rule out pairs, before any set is compared
    close = pairs.join(left.select("a", "na"), "a").join(right.select("b", "nb"), "b").filter(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    both = close.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(common >= threshold * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _shared(sets: DataFrame, threshold: float) -> DataFrame:
    """``node, total, shared, few``: shingles of a node, those that some other node has too, and the set itself if it is small.

    Two sets have at most the lesser ``shared`` in common, so a node with less than the
    threshold's part shared has no partner and is left out.
    """
    alone = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c = 1")
    own = alone.groupBy("node").agg(F.count("*").alias("alone"))
    counted = sets.select("node", F.size("shingles").alias("total"), F.when(F.size("shingles") <= SMALL, F.col("shingles")).alias("few")).join(own, "node", "left").withColumn("shared", F.col("total") - F.coalesce("alone", F.lit(0)))
    return counted.filter(F.col("shared") >= threshold * F.col("total")).select("node", "total", "shared", "few")


def _apart(placed: DataFrame, tested: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: pairs of one bucket in different components that counts and small sets leave possible."""
    one, two = (placed.select("key", *(F.col(c).alias(c[0] + x) for c in ("node", "component", "total", "shared", "few"))) for x in "ab")
    least, common = F.least("sa", "sb"), F.size(F.array_intersect("fa", "fb"))
    pairs = one.join(
        two,
        (one.key == two.key) & (F.col("na") > F.col("nb")) & (F.col("ca") != F.col("cb"))
        & (least >= threshold * (F.col("ta") + F.col("tb") - least)) & (F.coalesce(common >= threshold * (F.col("ta") + F.col("tb") - common), F.lit(True))),
    )
    return pairs.select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")


def _node_components(texts: DataFrame, documents: DataFrame, threshold: float) -> DataFrame:
    """``node, component`` of the texts that have a near duplicate."""
    keys = texts.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    members = cut(keys.join(buckets.drop("n"), "key"))
    sets = cut(shingle_sets(documents, texts.drop("bands").join(members.select("node").distinct(), "node", "left_semi")))
    tested = members.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    found = connected_components(cut(verified(tested, sets, threshold)), "a", "b").withColumnRenamed("id", "node")
    placed = members.select("key", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
    placed = cut(placed.join(split, "key"))
    shared = _shared(sets.join(placed.select("node").distinct(), "node", "left_semi"), threshold)
    more = cut(verified(cut(_apart(cut(placed.join(shared, "node")), tested, threshold)), sets, threshold))
    if more.isEmpty():
        return found
    stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return connected_components(stars.union(more), "a", "b").withColumnRenamed("id", "node")


def _classes(texts: DataFrame, component: DataFrame, salts: int = 16) -> DataFrame:
    """``k1, k2, class_id``: the least id of each text's component, which each of its nodes meets by one of a few salts."""
    placed = texts.select("k1", "k2", "node", "least").join(component, "node", "left")
    least = placed.filter("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("class_id"))
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # a text without a component is its own class, and needs no salt of a null key
    alone = placed.filter("component IS NULL").select("k1", "k2", F.col("least").alias("class_id"))
    met = placed.filter("component IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
    return met.join(salted, ["component", "salt"]).select("k1", "k2", "class_id").union(alone)


def near_duplicate_classes(documents: DataFrame, *, threshold: float = 0.8, bands: int = 36, rows: int = 6) -> DataFrame:
    """``doc_id, class_id``: one row for each row of documents with a non-null id; class_id is the least id of its class.

    36 bands of 6 registers find a pair of similarity 0.8 with probability 0.99998.
    """
    signed = cut(signatures(documents, bands, rows))
    worded = signed.filter(F.size("bands") > 0)
    each = worded.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    texts = cut(each.withColumn("node", F.monotonically_increasing_id()))  # numbers that stay, as the table is cut
    classes = _classes(texts, _node_components(texts, documents, threshold))
    found = worded.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"]).select("doc_id", "class_id")
    found = cut(found.union(signed.filter(F.size("bands") == 0).select("doc_id", F.col("doc_id").alias("class_id"))))
    # one id with several texts is one document, and ties their classes together
    several = found.groupBy("doc_id").agg(F.min("class_id").alias("x"), F.max("class_id").alias("y")).filter("x <> y").select("doc_id", "x")
    ties = cut(found.join(several, "doc_id").select(F.col("class_id").alias("a"), F.col("x").alias("b")).distinct())
    if ties.isEmpty():
        return found
    tied = connected_components(ties, "a", "b").withColumnRenamed("id", "class_id")
    return found.join(tied, "class_id", "left").select("doc_id", F.coalesce("component", "class_id").alias("class_id"))


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """One row of each class: a row of its least id. Rows with a null id stay."""
    classes = cut(near_duplicate_classes(documents, **options))
    gone = classes.filter("class_id <> doc_id").select("doc_id")
    repeated = cut(classes.filter("class_id = doc_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    kept = documents.join(gone.distinct(), "doc_id", "left_anti")
    if repeated.isEmpty():
        return kept
    one = documents.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").select(documents.columns).unionByName(one.select(documents.columns))
