"""Bounded and anchored fits, compact dihedral forces, force maps over constraint groups."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mesospark.functions import splines as S
from mesospark.operators import extensions, force_maps, table_fits


def _by_all_active_sets(a, y, low, high):
    """Brute force: every choice of coefficients held at a bound."""
    best = None
    for state in itertools.product((0, 1, 2), repeat=a.shape[1]):
        c = np.array([np.nan if s == 0 else (low, high)[s - 1][k] for k, s in enumerate(state)])
        free = np.isnan(c)
        if not np.isfinite(c[~free]).all():
            continue
        if free.any():
            c[free] = np.linalg.lstsq(a[:, free], y - a[:, ~free] @ c[~free], rcond=None)[0]
        if (c >= low - 1e-9).all() and (c <= high + 1e-9).all():
            left = ((a @ c - y) ** 2).sum()
            best = left if best is None else min(best, left)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_bounded_fit_is_the_optimum(seed):
    rng = np.random.RandomState(seed)
    a, y = rng.randn(20, 5), rng.randn(20) * 3
    if seed % 3 == 0:
        a[:, 1] = a[:, 0] * 0.5 + 1e-4 * rng.randn(20)  # nearly dependent
    low, high = -rng.uniform(0, 0.5, 5), rng.uniform(0, 0.5, 5)
    if seed % 2:
        low[0], high[3] = -np.inf, np.inf
    if seed == 4:
        low[2] = high[2] = 0.1
    c = table_fits.bounded_fit(a, y, low, high)
    assert (c >= low).all() and (c <= high).all()
    assert ((a @ c - y) ** 2).sum() == pytest.approx(_by_all_active_sets(a, y, low, high), rel=1e-9)


def test_bounds_that_cross_are_an_error():
    with pytest.raises(ValueError, match="above"):
        table_fits.bounded_fit(np.eye(2), np.ones(2), 1.0, 0.0)


def test_anchor_points_lie_inside_the_table():
    x = np.linspace(1, 2, 11)
    assert table_fits.anchor_points(x, 5.0, 3, 0.4) == pytest.approx([1.6, 1.8, 2.0])
    assert table_fits.anchor_points(x, 1.5, 3, 9.0) == pytest.approx([1.0, 1.25, 1.5])
    assert table_fits.anchor_points(x, None, 1, 0.4) == pytest.approx([2.0]) and len(table_fits.anchor_points(x, None, 0, 0.4)) == 0


def test_basis_slopes_are_differences():
    knots, x = S.clamped_knots(0.0, 2.0, 7, 3), np.linspace(0.05, 1.95, 17)
    near = (S.basis_array(x + 1e-6, knots, 3) - S.basis_array(x - 1e-6, knots, 3)) / 2e-6
    assert S.basis_slope_array(x, knots, 3) == pytest.approx(near, abs=1e-6)


def test_bounded_spline_meets_bounds_and_anchors(spark):
    rng = np.random.RandomState(3)
    x = np.linspace(0.5, 2.5, 60)
    f = np.exp(-x) * 3 - 0.4 + 0.05 * rng.randn(60)
    table = spark.createDataFrame(pd.DataFrame({"key": "pair:A:B", "x": x, "f": f}))
    fit = lambda **o: np.array([r.c for r in extensions.fit_tables(table, "bounded_spline", **o).orderBy("p").collect()])
    knots = S.clamped_knots(0.5, 2.5, 8, 3)
    end = lambda c: (S.basis_array(x[-1:], knots, 3) @ c, S.basis_slope_array(x[-1:], knots, 3) @ c)
    held, plain = fit(weights=(1.0, 1e4, 1e4)), fit(anchors=0)
    assert np.abs(end(held)).max() < 1e-3 < abs(end(plain)[0])
    inside = fit(low=-0.1, high=1.0, anchors=0)
    assert inside.min() >= -0.1 and inside.max() <= 1.0
    a = S.basis_array(x, knots, 3)
    pull = a.T @ (f - a @ inside)  # what is at a bound pushes outward, the rest is at rest
    assert all(abs(p) < 1e-8 if -0.1 < c < 1.0 else (p < 1e-9 if c == -0.1 else p > -1e-9) for c, p in zip(inside, pull, strict=True))
    energy = spark.createDataFrame(pd.DataFrame({"key": "pair:A:B", "x": x, "v": x * x}))
    got = np.array([r.c for r in extensions.fit_tables(energy, "bounded_spline", anchors=0).orderBy("p").collect()])
    assert a[5:-5] @ got == pytest.approx(-2 * x[5:-5], abs=0.02)


def test_tables_that_cannot_be_fitted_are_errors(spark):
    for x, f, what in ((([0.0, 1.0, 1.0, 2.0, 3.0]), [1.0] * 5, "repeats"), ([0.0, 1.0, 2.0, 3.0, 4.0], [1.0, float("nan"), 1.0, 1.0, 1.0], "finite"), ([0.0, 1.0], [1.0, 2.0], "needs 4")):
        table = spark.createDataFrame([("k", a, b) for a, b in zip(x, f, strict=True)], "key string, x double, f double")
        with pytest.raises(Exception, match=what):
            extensions.fit_tables(table, "bounded_spline", n=5).collect()


def test_anchored_gaussians_find_the_width_and_keep_signs(spark):
    x = np.linspace(1.0, 4.0, 80)
    centres, width = np.linspace(1.0 + 0.15 * 3, 4.0 - 0.15 * 3, 4), 2.0 * 3 / 8
    v = table_fits.gaussian_array(x, centres, width) @ np.array([3.0, -1.0, -0.4, -0.2])
    table = spark.createDataFrame(pd.DataFrame({"key": "pair:A:A", "x": x, "v": v}))
    got = extensions.fit_tables(table, "anchored_gaussians", n=4, anchors=0).orderBy("p").toPandas()
    assert got.c.to_numpy() == pytest.approx([3.0, -1.0, -0.4, -0.2], abs=1e-6) and got.width[0] == pytest.approx(width) and got.objective[0] < 1e-12
    rng = np.random.RandomState(5)
    noisy = spark.createDataFrame(pd.DataFrame({"key": "pair:A:A", "x": x, "v": v + 0.1 * rng.randn(80)}))
    got = extensions.fit_tables(noisy, "anchored_gaussians", n=4, anchors=3, weights=(1.0, 100.0, 100.0)).orderBy("p").toPandas()
    assert got.c[0] >= 0 and (got.c[1:] <= 0).all()
    at_end = table_fits.gaussian_array(x[-1:], got.centre.to_numpy(), got.width[0]) @ got.c.to_numpy()
    assert abs(at_end[0]) < 0.02


def test_compact_dihedral_force_ends_and_has_no_integral(spark):
    c, degree = [0.5, -0.2, 0.7, 0.1, -0.4, 0.3], 3
    knots, raw = S.compact_knots(-120.0, 90.0, len(c), degree), S.compact_coefficients(c)
    x = np.linspace(-179, 179, 4297)
    rows = spark.createDataFrame([(float(a),) for a in x], "x double")
    got = rows.select("x", S.spline(F.col("x"), knots, raw, degree).alias("f"), S.spline_rest(F.col("x"), knots, raw, degree).alias("u")).orderBy("x").toPandas()
    outside = (x < -120) | (x > 90)
    assert np.abs(got.f[outside]).max() == 0 and np.abs(got.u[outside]).max() < 1e-12
    assert np.trapezoid(got.f, x) == pytest.approx(0.0, abs=1e-6)
    assert -np.gradient(got.u, x)[1:-1] == pytest.approx(got.f.to_numpy()[1:-1], abs=1e-3)
    table = rows.sample(0.1, 1).withColumns({"key": F.lit("dihedral:A:A:A:A"), "f": S.spline(F.col("x"), knots, raw, degree)})
    fitted = [r.c for r in extensions.fit_tables(table, "compact_dihedral", n=6, lo=-120.0, hi=90.0).orderBy("p").collect()]
    assert fitted == pytest.approx(c, abs=1e-6)
    with pytest.raises(Exception, match="coefficients need"):
        extensions.fit_tables(table.limit(8).withColumn("x", F.col("x") / 1000 + 150), "compact_dihedral", n=6, lo=-120.0, hi=90.0).collect()
    for lo, hi, deg in ((-180.0, 180.0, 3), (-90.0, 90.0, 1)):
        with pytest.raises(ValueError):
            S.compact_knots(lo, hi, 5, deg)


def _forces(spark, rng, n_atoms, n, rank):
    base = rng.randn(rank, n_atoms)
    f = np.einsum("mda,ab->mbd", rng.randn(n, 3, rank), base)
    rows = [(0, m, a + 1, *map(float, f[m, a])) for m in range(n) for a in range(n_atoms)]
    return force_maps.with_template(spark.createDataFrame(rows, "frame_id long, mol_id long, ord long, fx double, fy double, fz double")), np.einsum("mad,mbd->ab", f, f)


@pytest.mark.parametrize("rank", [6, 3])
def test_map_over_groups_is_optimal_for_singular_moments_too(spark, rank):
    rng = np.random.RandomState(rank)
    atoms, q = _forces(spark, rng, 6, 40, rank)
    groups = spark.createDataFrame([(6, a, g) for a, g in zip(range(1, 7), (1, 1, 3, 4, 4, 6), strict=True)], "template long, atom long, group long")
    c = np.array([[0.3, 0.7, 0, 0, 0, 0], [0, 0, 0, 0.2, 0.3, 0.5]])
    coordinate = spark.createDataFrame([(6, s, a + 1, float(c[s, a])) for s in range(2) for a in range(6) if c[s, a]], "template long, site long, atom long, c double")
    moments = force_maps.force_moments(atoms)
    got = force_maps.optimal_map(moments, coordinate, groups).toPandas()
    w = got.pivot(index="site", columns="atom", values="weight").to_numpy()
    assert w @ c.T == pytest.approx(np.eye(2), abs=1e-9)
    assert w[:, 0] == pytest.approx(w[:, 1]) and w[:, 3] == pytest.approx(w[:, 4])
    k = np.array([[1, 1, 0, 0, 0, 0], [0, 0, 1, 0, 0, 0], [0, 0, 0, 1, 1, 0], [0, 0, 0, 0, 0, 1]], float).T
    grouped = force_maps.grouped_moments(moments, groups).toPandas()
    held = np.zeros((4, 4))
    at = {1: 0, 3: 1, 4: 2, 6: 3}
    for r in grouped.itertuples():
        held[at[r.i], at[r.j]] = held[at[r.j], at[r.i]] = r.q
    assert held == pytest.approx(k.T @ q @ k)
    objective = np.trace(w @ q @ w.T)
    assert got.objective[0] == pytest.approx(objective, abs=1e-9) and got.objective[0] <= got.uniform_objective[0] + 1e-9
    kernel = np.linalg.svd(c @ k)[2][2:]
    for _ in range(200):  # no other map that meets the condition is better
        other = w + rng.randn(2, len(kernel)) @ kernel @ k.T * rng.choice([1e-3, 0.1, 1.0])
        assert np.trace(other @ q @ other.T) >= objective - 1e-8


def test_sites_that_a_group_makes_one_are_an_error(spark):
    atoms, _ = _forces(spark, np.random.RandomState(0), 2, 5, 2)
    coordinate = spark.createDataFrame([(2, 0, 1, 1.0), (2, 1, 2, 1.0)], "template long, site long, atom long, c double")
    groups = spark.createDataFrame([(2, 1, 1), (2, 2, 1)], "template long, atom long, group long")
    with pytest.raises(Exception, match="not independent"):
        force_maps.optimal_map(force_maps.force_moments(atoms), coordinate, groups).collect()
