"""Choosing, weighting and sampling frames and atoms; set operations."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mesospark.plans.lineage import cut


def select_frames(frames: DataFrame, start: int = 0, end: int | None = None, every: int = 1, n_frames: int = 0) -> DataFrame:
    """Frames of a window; ``n_frames`` 0 goes to the end. Only the filter on the id, which reaches the scan, unless n_frames is given."""
    if every <= 0:
        raise ValueError("every must be positive")
    out = frames.filter((F.col("frame_id") >= start) & ((F.col("frame_id") - start) % every == 0))
    out = out if end is None else out.filter(F.col("frame_id") < end)
    return out.filter(F.col("frame_id") < start + every * n_frames) if n_frames else out


def with_weights(frames: DataFrame, weights: DataFrame) -> DataFrame:
    """External weights by frame; frames without one weigh 1. Negative weights are an error."""
    checked = weights.withColumn("weight", F.when(F.col("weight") < 0, F.raise_error(F.lit("negative weight"))).otherwise(F.col("weight")))
    return frames.join(checked, "frame_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def select_atoms(atoms: DataFrame, wanted: DataFrame) -> DataFrame:
    """Listed atoms (``atom_id, k``) in listed order; k becomes the position."""
    return atoms.join(wanted, "atom_id")


def numbered(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Adds the place of each row in the order of a unique key, from 0.

    Rows are dealt by ranges of the key and numbered within each range; what the
    ranges before it hold is added. Only one count a range is gathered.
    """
    dealt = cut(rows.repartitionByRange(key).sortWithinPartitions(key).withColumns({"range_": F.spark_partition_id(), "nth_": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before = F.coalesce(F.sum("there").over(W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("range_").agg(F.count("*").alias("there")).select("range_", before.alias("before"))
    return dealt.join(F.broadcast(offsets), "range_").withColumn(name, F.col("before") + F.col("nth_")).drop("range_", "nth_", "before")


def split_frames(frames: DataFrame, n: int) -> DataFrame:
    """n near-equal contiguous parts, the first ones longer; numbered from 0."""
    at, total = numbered(frames, "frame_id", "at_"), frames.count()
    size, longer = divmod(total, n)
    first = longer * (size + 1)
    part = F.when(F.col("at_") < first, F.floor(F.col("at_") / (size + 1))).otherwise(longer + F.floor((F.col("at_") - first) / max(size, 1)))
    return at.withColumn("part", part.cast("long")).drop("at_")


def sample_frames(frames: DataFrame, n: int, seed: int) -> DataFrame:
    """n frames without replacement, a function of seed and ids alone; all if n is 0 or more than there are."""
    if n <= 0:
        return frames
    return frames.orderBy(drawn_order(seed), "frame_id").limit(n)


def drawn_order(seed: int):
    """A keyed order of frames that any engine can repeat: the MD5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("frame_id").cast("string")))


def sample_starts(pool: DataFrame, n: int, seed: int) -> DataFrame:
    """n distinct start frames of a pool; more than there are is an error."""
    distinct = pool.distinct()
    if (there := distinct.count()) < n:
        raise ValueError(f"{n} start configurations are asked for; there are {there}")
    return distinct.orderBy(drawn_order(seed), "frame_id").limit(n)


def first_seen(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct keys with the position at which each is first seen."""
    return rows.groupBy(key).agg(F.min(position).alias("first"))


def first_occurrences(requests: DataFrame, value: str, position: str) -> DataFrame:
    """requests with ``first``, where their value is asked for first, and ``produced``: later ones refer to it and are not made again."""
    first = requests.groupBy(value).agg(F.min(position).alias("first"))
    return requests.join(first, value).withColumn("produced", F.col(position) == F.col("first"))


def missing(requested: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(present.select(key), key, "left_anti")


def chained(*segments: DataFrame) -> DataFrame:
    """Frame counts of segments as one trajectory: rows ``segment, n_frames`` with the first global id of each."""
    one = segments[0]
    for s in segments[1:]:
        one = one.unionByName(s)
    before = F.coalesce(F.sum("n_frames").over(W.orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return one.withColumn("first_id", before.cast("long"))


def with_channels(rows: DataFrame, channels: list[str]) -> DataFrame:
    """rows, once it is known that some row has each of the asked channels; one that none has is an error."""
    held = rows.agg(*[F.bool_or(F.col(c).isNotNull()).alias(c) for c in channels]).first()
    if absent := [c for c in channels if not held[c]]:
        raise ValueError(f"no frame has {', '.join(absent)}")
    return rows
