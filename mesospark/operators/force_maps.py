"""Linear force maps by template: moments, constrained pairs and groups, uniform and optimal maps.

A template is a kind of molecule whose atoms are numbered by ``ord``; statistics
are summed over all molecules of it in all frames. Templates are small, so what
is solved for one of them is a small matrix.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mesospark.operators.components import connected_components
from mesospark.plans.lineage import cut

MOLECULE = ["frame_id", "mol_id"]


def with_template(atoms: DataFrame) -> DataFrame:
    """Adds ``template``: the number of atoms of the molecule."""
    return atoms.withColumn("template", F.count("*").over(W.partitionBy(*MOLECULE)))


def _pairs(atoms: DataFrame, columns: list[str]) -> DataFrame:
    """Atoms of one molecule in one frame with each other: ``template, i, j`` and the columns with suffixes 1 and 2."""
    side = lambda k, name: atoms.select(*MOLECULE, *(["template"] if k == 1 else []), F.col("ord").alias(name), *[F.col(c).alias(f"{c}{k}") for c in columns])
    return side(1, "i").join(side(2, "j"), MOLECULE)


def force_moments(atoms: DataFrame) -> DataFrame:
    """``template, i, j, n, q`` (i <= j): sums over molecules of the products of the forces on two atoms."""
    dot = sum((F.col(f"f{a}1") * F.col(f"f{a}2") for a in "yz"), F.col("fx1") * F.col("fx2"))
    both = _pairs(atoms, ["fx", "fy", "fz"]).filter("i <= j")
    return both.groupBy("template", "i", "j").agg(F.count("*").alias("n"), F.sum(dot).alias("q"))


def distance_moments(atoms: DataFrame) -> DataFrame:
    """``template, i, j, n, s1, s2`` (i < j): counts and sums of the distances of two atoms and of their squares."""
    square = sum(((F.col(f"u{a}1") - F.col(f"u{a}2")) * (F.col(f"u{a}1") - F.col(f"u{a}2")) for a in "yz"), (F.col("ux1") - F.col("ux2")) * (F.col("ux1") - F.col("ux2")))
    both = _pairs(atoms, ["ux", "uy", "uz"]).filter("i < j").withColumn("r", F.sqrt(square))
    return both.groupBy("template", "i", "j").agg(F.count("*").alias("n"), F.sum("r").alias("s1"), F.sum(F.col("r") * F.col("r")).alias("s2"))


def constrained_pairs(moments: DataFrame, threshold: float) -> DataFrame:
    """``template, i, j`` of the pairs whose distance hardly varies; one observation tells nothing."""
    mean = F.col("s1") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)))
    return moments.filter((F.col("n") >= 2) & (spread < threshold)).select("template", "i", "j")


def constraint_groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``template, atom, group``: atoms held together by constrained pairs have one group, named by its least atom."""
    node = lambda c: F.struct("template", F.col(c).alias("atom"))
    edges = cut(pairs.select(node("i").alias("u"), node("j").alias("v")))
    found = connected_components(edges).select(F.col("id.template").alias("template"), F.col("id.atom").alias("atom"), F.col("component.atom").alias("group"))
    return members.select("template", "atom").distinct().join(found, ["template", "atom"], "left").select("template", "atom", F.coalesce("group", "atom").alias("group"))


def uniform_map(groups: DataFrame, coordinate: DataFrame) -> DataFrame:
    """``template, site, atom, weight``: weight 1 on every atom whose group touches the site.

    ``coordinate``: ``template, site, atom, c``, the weights of the position map.
    """
    touched = coordinate.filter("c <> 0").join(groups, ["template", "atom"]).select("template", "site", "group").distinct()
    return touched.join(groups, ["template", "group"]).select("template", "site", "atom", F.lit(1.0).alias("weight"))


def grouped_moments(moments: DataFrame, groups: DataFrame) -> DataFrame:
    """``template, i, j, q`` (i <= j): moments of the sums of the forces in each constraint group, named by its least atom."""
    side = lambda c, name: groups.select("template", F.col("atom").alias(c), F.col("group").alias(name))
    met = moments.join(side("i", "gi"), ["template", "i"]).join(side("j", "gj"), ["template", "j"])
    twice = F.when((F.col("gi") == F.col("gj")) & (F.col("i") != F.col("j")), 2.0).otherwise(1.0)
    return met.groupBy("template", F.least("gi", "gj").alias("i"), F.greatest("gi", "gj").alias("j")).agg(F.sum(twice * F.col("q")).alias("q"))


def least_map(p: np.ndarray, c: np.ndarray) -> np.ndarray:
    """W of least tr(W P W') with W C' = I, also for a singular P: one solution, less what the null space of C can take off."""
    start, null = np.linalg.pinv(c).T, np.linalg.svd(c)[2][len(c) :].T
    return start - start @ p @ null @ np.linalg.pinv(null.T @ p @ null, rcond=1e-12, hermitian=True) @ null.T


def optimal_map(moments: DataFrame, coordinate: DataFrame, groups: DataFrame | None = None, *, l2: float = 0.0, tolerance: float = 1e-7) -> DataFrame:
    """``template, site, atom, weight, objective, given_objective, uniform_objective, consistency``: least tr(W Q W') with W C' = I.

    With ``groups`` (``template, atom, group``) the atoms of a constraint group share
    one weight, as only the sum of their forces is known; atoms without one stand alone.
    ``objective``, ``given_objective`` (a site's forces are those of its own atoms, each in
    full) and ``uniform_objective`` (those of all groups that it touches) are the quadratic
    forms of the whole template. ``l2`` is in units of the mean square of an atom's
    force. A position map of less than full rank over the groups, or one that W
    misses by more than the tolerance, is an error. Templates are solved in parallel.
    """

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["template", "site", "atom", "weight", "objective", "given_objective", "uniform_objective", "consistency"]
        held, right = right[right.site.isna()], right[right.site.notna()]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in names})
        atoms, sites = np.unique(np.concatenate([left.i, left.j])), np.unique(right.site).astype(int)
        q, c = np.zeros((len(atoms),) * 2), np.zeros((len(sites), len(atoms)))
        i, j = np.searchsorted(atoms, left.i), np.searchsorted(atoms, left.j)
        q[i, j] = q[j, i] = left.q
        c[np.searchsorted(sites, right.site), np.searchsorted(atoms, right.atom)] = right.c
        named = dict(zip(held.atom, held.group, strict=True))
        of = np.array([named.get(a, a) for a in atoms])
        share = (of[:, None] == np.unique(of)).astype(float)
        if np.linalg.matrix_rank(c @ share) < len(sites):
            raise ValueError(f"template {left.template.iloc[0]}: sites are not independent")
        p = q / max(np.trace(q) / len(q), 1e-300) + l2 * np.eye(len(q))
        w = least_map(share.T @ p @ share, c @ share) @ share.T
        miss = float(np.abs(w @ c.T - np.eye(len(sites))).max())
        if miss > tolerance:
            raise ValueError(f"template {left.template.iloc[0]}: the map misses its condition by {miss:g}")
        rows = [(left.template.iloc[0], s, a, w[x, y]) for x, s in enumerate(sites) for y, a in enumerate(atoms)]
        forms = [float(np.trace(m @ q @ m.T)) for m in (w, (c != 0).astype(float), ((c != 0) @ share > 0) @ share.T)]
        return pd.DataFrame(rows, columns=names[:4]).assign(objective=forms[0], given_objective=forms[1], uniform_objective=forms[2], consistency=miss)

    schema = "template long, site long, atom long, weight double, objective double, given_objective double, uniform_objective double, consistency double"
    none = lambda kind: F.lit(None).cast(kind)
    apart = coordinate.select(F.col("template").alias("of"), "site", "atom", "c", none("long").alias("group"))
    if groups is not None:
        apart = apart.unionByName(groups.select(F.col("template").alias("of"), none("long").alias("site"), "atom", none("double").alias("c"), "group"))
    return moments.groupBy("template").cogroup(apart.groupBy("of")).applyInPandas(solve, schema)


def apply_map(atoms: DataFrame, operator: DataFrame) -> DataFrame:
    """``frame_id, mol_id, site, fx, fy, fz``: the operator of each template (``template, site, atom, weight``) on its molecules."""
    met = atoms.join(operator.select("template", "site", F.col("atom").alias("ord"), "weight"), ["template", "ord"])
    return met.groupBy(*MOLECULE, "site").agg(*[F.sum(F.col("weight") * F.col(f"f{a}")).alias(f"f{a}") for a in "xyz"])
