"""Weighted ensemble statistics over term tables."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bin_of(x: Column, lo: float, hi: float, n: int) -> Column:
    """Bin of x; the last bin is closed on the right, values outside have none."""
    return F.when((x >= lo) & (x <= hi), F.least(F.floor((x - lo) / ((hi - lo) / n)), F.lit(n - 1)).cast("int"))


def histogram(values: DataFrame, lo: float, hi: float, n: int, value: str = "value", by: tuple[str, ...] = ("key",), weight: str = "w") -> DataFrame:
    """Weighted counts by key and bin; summed map-side before the shuffle, which carries at most keys x bins rows a task."""
    # values outside are a group of their own, dropped afterwards: filters on bins, also those that joins infer, would be moved
    # to where values are made, in code too long to be compiled
    binned = values.withColumn("bin", F.coalesce(bin_of(F.col(value), lo, hi, n), F.lit(-1)))
    return binned.groupBy(*by, "bin").agg(F.sum(weight).alias("count"), F.count_if(F.col("bin") >= 0).alias("n")).filter("n > 0")


def filled(counts: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """A row for every key and bin, 0 where nothing was counted."""
    grid = keys.select("key").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.join(counts, ["key", "bin"], "left").fillna(0)


def density(counts: DataFrame, lo: float, hi: float, n: int) -> DataFrame:
    """Probability density by key; zeros where a key has no count."""
    total = F.sum("count").over(W.partitionBy("key"))
    return counts.withColumn("density", F.when(total > 0, F.col("count") / (total * ((hi - lo) / n))).otherwise(0.0))


def type_counts(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("frame_id", "type").agg(F.count("*").alias("n"))


def type_pairs(counts: DataFrame, alike: Column, unlike: Column) -> DataFrame:
    """Counts by frame joined with themselves, unordered types: ``key, frame_id`` and ``pairs``."""
    one, two = counts.withColumnsRenamed({"type": "t1", "n": "n1"}), counts.withColumnsRenamed({"type": "t2", "n": "n2"})
    joined = one.join(two, "frame_id").filter("t1 <= t2")
    return joined.withColumn("key", F.concat_ws(":", F.lit("pair"), "t1", "t2")).withColumn("pairs", F.when(F.col("t1") == F.col("t2"), alike).otherwise(unlike))


def radial_distribution(counts: DataFrame, atoms: DataFrame, frames: DataFrame, r_max: float, n: int) -> DataFrame:
    """``key, bin, count, g``: summed counts over the summed expectation of an ideal gas; exclusions do not lower it."""
    expected = type_pairs(type_counts(atoms), F.col("n1") * (F.col("n1") - 1) / 2, F.col("n1") * F.col("n2"))
    expected = expected.join(frames, "frame_id").groupBy("key").agg(F.sum(F.col("w") * F.col("pairs") / (F.col("lx") * F.col("ly") * F.col("lz"))).alias("rho"))
    width = r_max / n
    lo, hi = F.col("bin") * width, (F.col("bin") + 1) * width
    shell = 4.0 / 3.0 * math.pi * (hi * hi * hi - lo * lo * lo)
    full = filled(counts, expected, n).join(expected, "key")
    return full.withColumn("g", F.coalesce(F.col("count") / F.nullif(F.col("rho") * shell, F.lit(0.0)), F.lit(0.0))).select("key", "bin", "count", "g")


def eligible_pairs(atoms: DataFrame, group: str = "mol_id") -> DataFrame:
    """Pairs by key that group exclusion leaves, by counting alone."""
    everything = type_pairs(type_counts(atoms), F.col("n1") * (F.col("n1") - 1) / 2, F.col("n1") * F.col("n2"))
    inside = atoms.groupBy("frame_id", group, "type").agg(F.count("*").alias("n"))
    one, two = inside.withColumnsRenamed({"type": "t1", "n": "n1"}), inside.withColumnsRenamed({"type": "t2", "n": "n2"})
    same = one.join(two, ["frame_id", group]).filter("t1 <= t2").withColumn("key", F.concat_ws(":", F.lit("pair"), "t1", "t2"))
    same = same.groupBy("frame_id", "key").agg(F.sum(F.when(F.col("t1") == F.col("t2"), F.col("n1") * (F.col("n1") - 1) / 2).otherwise(F.col("n1") * F.col("n2"))).alias("same"))
    left = everything.select("frame_id", "key", "pairs").join(same, ["frame_id", "key"], "left").withColumn("eligible", F.col("pairs") - F.coalesce("same", F.lit(0.0)))
    return left.select("frame_id", "key", F.when(F.col("eligible") < 0, F.raise_error(F.lit("negative pair count"))).otherwise(F.col("eligible")).cast("long").alias("eligible"))


def weighted_moments(values: DataFrame, by: list[str], value: str, weight: str = "w") -> DataFrame:
    """Weighted mean, standard error with reliability weights and effective n by key; the error is NaN for n_eff <= 1."""
    w, v = F.col(weight), F.col(value)
    m = values.groupBy(*by).agg(F.sum(w).alias("sw"), F.sum(w * v).alias("swv"), F.sum(w * v * v).alias("swvv"), F.sum(w * w).alias("sww"))
    mean = F.col("swv") / F.nullif(F.col("sw"), F.lit(0.0))
    n_eff = F.col("sw") * F.col("sw") / F.nullif(F.col("sww"), F.lit(0.0))
    spread = F.greatest(F.lit(0.0), F.col("swvv") / F.col("sw") - mean * mean) * n_eff / (n_eff - 1)
    return m.select(*by, mean.alias("mean"), n_eff.alias("n_eff"), F.when(n_eff > 1, F.sqrt(spread / n_eff)).otherwise(float("nan")).alias("sem"))


def block_error(values: DataFrame, by: list[str], value: str, size: int) -> DataFrame:
    """Mean and standard error of equal-weight block means; a block is frame div size; NaN under two blocks."""
    blocks = values.groupBy(*by, F.floor(F.col("frame_id") / size).alias("block")).agg(F.avg(value).alias("m"))
    n = F.count("*")
    return blocks.groupBy(*by).agg(n.alias("blocks"), F.avg("m").alias("mean"), F.when(n >= 2, F.stddev_samp("m") / F.sqrt(n)).otherwise(float("nan")).alias("sem"))


def ensemble_average(values: DataFrame, by: list[str], value: str, weight: str = "w") -> DataFrame:
    """sum(w v) / sum(w), 0 without weight."""
    return values.groupBy(*by).agg(F.coalesce(F.sum(F.col(weight) * F.col(value)) / F.nullif(F.sum(weight), F.lit(0.0)), F.lit(0.0)).alias("average"))


def folded_copies(values: DataFrame, base: list[str], value: str, weight: str = "w") -> DataFrame:
    """One value for each base frame: its copies averaged with weights that sum to one within it."""
    return ensemble_average(values, base, value, weight)
