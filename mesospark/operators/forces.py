"""Forces on atoms and the statistics of force matching."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mesospark.operators.neighbors import sites_of


def pair_forces(pairs: DataFrame, force: Column) -> DataFrame:
    """``frame_id, atom_id, fx, fy, fz``: -dU/dr along each pair's vector (a to b), opposite on the two atoms."""
    scaled = [(force / F.col("r") * F.col(c)).alias("f" + c[1]) for c in ("dx", "dy", "dz")]
    sides = F.array(F.struct(F.col("a").alias("atom_id"), F.lit(-1.0).alias("sign")), F.struct(F.col("b").alias("atom_id"), F.lit(1.0).alias("sign")))
    rows = pairs.select("frame_id", *scaled, F.explode(sides).alias("s"))
    return rows.groupBy("frame_id", F.col("s.atom_id").alias("atom_id")).agg(*[F.sum(F.col("s.sign") * F.col(c)).alias(c) for c in ("fx", "fy", "fz")])


def site_rows(pairs: DataFrame, force: Column) -> DataFrame:
    """``frame_id, atom_id``, the fields of ``own`` and the model's force ``mfx, mfy, mfz`` (null without a pair) of every atom.

    pairs are neighbours with each atom's row with itself (``alone``), which carry that struct: no
    atom is met by a join, and nothing is dealt again.
    """
    found = sites_of(pairs, tuple(force / F.nullif(F.col("r"), F.lit(0.0)) * F.col(f"d{a}") for a in "xyz"))
    return found.withColumnsRenamed({f"s{a}": f"mf{a}" for a in "xyz"})


def hat_jacobian(pairs: DataFrame, lo: float, step: float, n: int) -> DataFrame:
    """``frame_id, w, atom_id, axis, p, j``: dF/dc of a force that is a sum of hats; a pair touches two parameters at most."""
    at = F.floor((F.col("r") - lo) / step).cast("int")
    wide = pairs.withColumn("p", F.explode(F.sequence(at, at + 1))).filter(F.col("p").between(0, n - 1))
    basis = F.greatest(F.lit(0.0), 1 - F.abs((F.col("r") - lo) / step - F.col("p")))
    parts = [F.struct(F.col(side).alias("atom_id"), F.lit(axis).alias("axis"), (sign * basis / F.col("r") * F.col(f"d{axis}")).alias("j")) for side, sign in (("a", -1.0), ("b", 1.0)) for axis in "xyz"]
    rows = wide.select("frame_id", "w", "p", F.explode(F.array(*parts)).alias("s")).select("frame_id", "w", "p", "s.*")
    return rows.groupBy("frame_id", "w", "atom_id", "axis", "p").agg(F.sum("j").alias("j"))


def normal_equations(jacobian: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``p, q, jtj`` (p <= q) and ``p, jty``, weighted by frame; targets: ``frame_id, atom_id, axis, y``. Rows are sparse, so the join stays small."""
    row = ["frame_id", "atom_id", "axis"]
    other = jacobian.select(*row, F.col("p").alias("q"), F.col("j").alias("k"))
    gram = jacobian.join(other, row).filter("p <= q").groupBy("p", "q").agg(F.sum(F.col("w") * F.col("j") * F.col("k")).alias("jtj"))
    return gram, jacobian.join(targets, row).groupBy("p").agg(F.sum(F.col("w") * F.col("j") * F.col("y")).alias("jty"))


def solve_ridge(gram: DataFrame, right: DataFrame, n: int, ridge: float) -> np.ndarray:
    """Coefficients of the n-sized system; only n x n numbers come to the driver."""
    a, b = np.zeros((n, n)), np.zeros(n)
    for r in gram.collect():
        a[r.p, r.q] = a[r.q, r.p] = r.jtj
    for r in right.collect():
        b[r.p] = r.jty
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    return np.linalg.solve(a / scale[:, None] / scale + ridge * np.eye(n), b / scale) / scale


def residuals(forces: DataFrame, model: DataFrame) -> DataFrame:
    """By type and overall: rows, target, model and residual sums of squares, and the unexplained fraction."""
    return residual_sums(forces.join(model.select("frame_id", "atom_id", *[F.col(c).alias("m" + c) for c in ("fx", "fy", "fz")]), ["frame_id", "atom_id"], "left"))


def residual_sums(rows: DataFrame) -> DataFrame:
    """The same of atoms that have their target ``fx, fy, fz`` and the model's ``mfx, mfy, mfz`` beside them."""
    joined = rows.fillna(0.0)
    square = lambda cs: sum((c * c for c in cs[1:]), cs[0] * cs[0])
    y, m = [F.col(c) for c in ("fx", "fy", "fz")], [F.col("m" + c) for c in ("fx", "fy", "fz")]
    sums = joined.rollup("type").agg(F.count("*").alias("n"), F.sum(square(y)).alias("target"), F.sum(square(m)).alias("model"), F.sum(square([a - b for a, b in zip(y, m, strict=True)])).alias("residual"))
    return sums.withColumns({"type": F.coalesce("type", F.lit("all")), "unexplained": F.col("residual") / F.nullif(F.col("target"), F.lit(0.0))})
