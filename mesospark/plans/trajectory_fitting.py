"""Registered queries: force maps over constraint groups, fits within bounds and with anchors, dihedral forces that end."""

from pyspark.sql import functions as F

from mesospark.functions import splines as S
from mesospark.operators import extensions, force_maps, table_fits, tables
from mesospark.plans.trajectory import DIHEDRALS, _table, query
from mesospark.plans.trajectory_models import DISTANCES, GROUPS, TEMPLATE, _basis_sql, _coordinate, _dihedral_table, _dihedrals, _groups, _molecules

assert table_fits  # its fitters are registered by name


@query("A34_groups", "RECURSIVE", TEMPLATE, DISTANCES, GROUPS,
 """v_sum AS (SELECT m.template, frame_id, mol_id, g."group" AS g, sum(fx) AS fx, sum(fy) AS fy, sum(fz) AS fz FROM v_mol m JOIN v_group g ON m.template = g.template AND m.ord = g.atom GROUP BY 1, 2, 3, 4)""",
 select="SELECT a.template, a.g AS i, b.g AS j, round(sum(a.fx * b.fx + a.fy * b.fy + a.fz * b.fz), 4) + 0.0 AS q FROM v_sum a JOIN v_sum b ON a.frame_id = b.frame_id AND a.mol_id = b.mol_id AND a.g <= b.g GROUP BY 1, 2, 3")
def a34_groups(spark, d):
    """Force moments in coordinates of constraint groups."""
    atoms = _molecules(spark, d)
    return force_maps.grouped_moments(force_maps.force_moments(atoms), _groups(atoms)).select("template", "i", "j", (F.round("q", 4) + 0.0).alias("q"))


@query("M07_constrained")
def m07_constrained(spark, d):
    """Optimal maps that give one weight to each constraint group; a site for every two atoms, joined where a group holds several."""
    atoms = _molecules(spark, d)
    groups = _groups(atoms)
    sites = _coordinate(atoms).join(groups, ["template", "atom"])
    least = sites.groupBy("template", "site").agg(F.min("group").alias("home"))
    whole = sites.join(least, ["template", "site"]).groupBy("template", F.col("home").alias("site"), "atom").agg(F.sum("c").alias("c"))
    found = force_maps.optimal_map(force_maps.force_moments(atoms), whole, groups, l2=1e-3)
    return found.select("template", "site", "atom", *[F.round(c, 6).alias(c) for c in ("weight", "objective", "given_objective", "uniform_objective")], "consistency")


@query("M09_bounded")
def m09_bounded(spark, d):
    """Cubic splines within bounds, anchored at the ends of their tables."""
    weighted = _table(spark, d).withColumn("weight", 1.0 + F.col("i") % 3)
    return extensions.fit_tables(weighted, "bounded_spline", n=6, low=-0.2, high=0.25).select("key", "p", F.round("c", 5).alias("c"))


@query("M11_anchored")
def m11_anchored(spark, d):
    """Gaussian amplitudes at the best of twelve starts, anchored at the ends of the integrated tables."""
    found = extensions.fit_tables(tables.integrated(_table(spark, d)), "anchored_gaussians", n=5)
    return found.select("key", "p", *[F.round(c, 5).alias(c) for c in ("c", "centre", "width", "objective")])


COMPACT = (0.4, -0.3, 0.2, 0.5, -0.6)
_COMPACT_KNOTS = S.compact_knots(-150.0, 150.0, len(COMPACT), 2)
_WIDER = [_COMPACT_KNOTS[0], *_COMPACT_KNOTS, _COMPACT_KNOTS[-1]]
_RAW = S.compact_coefficients(COMPACT)
_TOTALS = [sum(_RAW[: k + 1]) * (_COMPACT_KNOTS[1] - _COMPACT_KNOTS[0]) for k in range(len(COMPACT))]
_F_SQL = " + ".join(f"({c!r}) * {_basis_sql('value', _COMPACT_KNOTS, k, 2)}" for k, c in enumerate(_RAW))
_U_SQL = " + ".join(f"({-c!r}) * {_basis_sql('value', _WIDER, k + 1, 3)}" for k, c in enumerate(_TOTALS))


@query("F10_compact", DIHEDRALS, select=f"SELECT key, count(*) AS n, round(sum({_F_SQL}), 3) + 0.0 AS f, round(sum({_U_SQL}), 2) + 0.0 AS u FROM v_dihedrals GROUP BY 1")
def f10_compact(spark, d):
    """A dihedral force from -150 to 150 degrees of zero integral, and its energy, which is zero at both ends."""
    x = F.col("value")
    force, energy = S.spline(x, _COMPACT_KNOTS, _RAW, 2), S.spline_rest(x, _COMPACT_KNOTS, _RAW, 2)
    return _dihedrals(spark, d).groupBy("key").agg(F.count("*").alias("n"), (F.round(F.sum(force), 3) + 0.0).alias("f"), (F.round(F.sum(energy), 2) + 0.0).alias("u"))


@query("M10_compact")
def m10_compact(spark, d):
    return extensions.fit_tables(_dihedral_table(spark, d), "compact_dihedral", n=4, lo=-170.0, hi=170.0).select("key", "p", F.round("c", 5).alias("c"))
