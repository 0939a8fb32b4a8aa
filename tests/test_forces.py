"""Forces, Jacobians, statistics and solvers of all terms against finite differences and numpy."""

import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesospark.functions import potentials as P
from mesospark.operators import bonded, denoising, force_matching, gradients, neighbors
from mesospark.plans.trajectory import QUERIES

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
EDGE = 9.0


def image(d):
    return d - EDGE * np.round(d / EDGE)


def length(x):
    return np.linalg.norm(image(x[1] - x[0]))


def angle(x):
    u, v = image(x[0] - x[1]), image(x[2] - x[1])
    return math.degrees(math.acos(u @ v / np.linalg.norm(u) / np.linalg.norm(v)))


def dihedral(x):
    b1, b2, b3 = (image(x[k + 1] - x[k]) for k in range(3))
    m, n = np.cross(b1, b2), np.cross(b2, b3)
    return math.degrees(math.atan2(np.linalg.norm(b2) * (b1 @ n), m @ n))


COORDINATE = {"bond": (2, length), "angle": (3, angle), "dihedral": (4, dihedral)}


def chains(n_frames=3, n_molecules=6, n_atoms=5, seed=2):
    """Wrapped positions of ``(frame, molecule, atom)``."""
    rng = np.random.RandomState(seed)
    start = rng.uniform(0, EDGE, (n_frames, n_molecules, 1, 3))
    return np.mod(start + np.cumsum(rng.normal(0.6, 0.5, (n_frames, n_molecules, n_atoms, 3)), axis=2), EDGE)


@pytest.fixture(scope="module")
def positions():
    return chains()


@pytest.fixture(scope="module")
def atoms(spark, positions):
    rows = [(f, 10 * m + k, m, k + 1, "AB"[k % 2], *map(float, positions[f, m, k]), EDGE, EDGE, EDGE, 0.5 + 0.25 * f, *map(float, np.sin([f + m, m + k, k + 1.0]))) for f, m, k in itertools.product(*map(range, positions.shape[:3]))]
    return spark.createDataFrame(rows, "frame_id long, atom_id long, mol_id long, ord long, type string, x double, y double, z double, lx double, ly double, lz double, w double, fx double, fy double, fz double")


def terms(spark, style, shape):
    n = COORDINATE[style][0]
    rows = [(f, *[10 * m + k + i for i in range(n)], style) for f, m, k in itertools.product(range(shape[0]), range(shape[1]), range(shape[2] - n + 1))]
    return spark.createDataFrame(rows, ", ".join(["frame_id long", *[f"a{i + 1} long" for i in range(n)], "key string"]))


@pytest.mark.parametrize("style", COORDINATE)
def test_slopes_of_coordinates_equal_finite_differences(spark, atoms, positions, style):
    n, value = COORDINATE[style]
    got = bonded.term_rows(terms(spark, style, positions.shape), atoms, style).collect()
    assert len(got) == positions.shape[0] * positions.shape[1] * (positions.shape[2] - n + 1)
    for r in got:
        at = [(r.frame_id, s.atom_id // 10, s.atom_id % 10) for s in r.sites]
        x = np.array([positions[i] for i in at])
        assert r.value == pytest.approx(value(x), abs=1e-8) and r.w == 0.5 + 0.25 * r.frame_id
        for i, s in enumerate(r.sites):
            for a, g in enumerate((s.gx, s.gy, s.gz)):
                step = np.zeros_like(x)
                step[i, a] = 1e-6
                assert g == pytest.approx((value(x + step) - value(x - step)) / 2e-6, rel=2e-5, abs=2e-4), (r, i, a)
        slopes = np.array([[s.gx, s.gy, s.gz] for s in r.sites])
        # no net force, and no torque about the first site
        scale = np.abs(slopes).max()
        assert np.allclose(slopes.sum(0), 0, atol=1e-9 * scale) and np.allclose(np.cross(image(x - x[0]), slopes).sum(0), 0, atol=1e-9 * scale)


def test_straight_and_collapsed_terms(spark):
    rows = [(0, 0, 1.0, 1.0, 1.0), (0, 1, 2.0, 1.0, 1.0), (0, 2, 3.0, 1.0, 1.0), (0, 3, 3.0, 1.0, 1.0), (0, 4, 4.0, 2.0, 1.0)]
    at = spark.createDataFrame(rows, "frame_id long, atom_id long, x double, y double, z double").withColumns({c: F.lit(EDGE) for c in ("lx", "ly", "lz")} | {"w": F.lit(1.0)})
    angles = spark.createDataFrame([(0, 0, 1, 2, "k"), (0, 2, 3, 4, "k")], "frame_id long, a1 long, a2 long, a3 long, key string")
    found = bonded.term_rows(angles, at, "angle").collect()
    assert [r.value for r in found] == [180.0] and all(math.isfinite(g) for s in found[0].sites for g in s)
    straight = spark.createDataFrame([(0, 0, 1, 2, 4, "k")], "frame_id long, a1 long, a2 long, a3 long, a4 long, key string")
    assert bonded.term_rows(straight, at, "dihedral").count() == 0
    bonds = spark.createDataFrame([(0, 2, 3, "k")], "frame_id long, a1 long, a2 long, key string")
    assert bonded.term_rows(bonds, at, "bond").count() == 0 and bonded.term_rows(bonds.limit(0), at, "bond").count() == 0


def _pairs(atoms, cutoff=3.0):
    pairs = neighbors.exclude_groups(neighbors.neighbor_pairs(atoms, cutoff), "mol_id").withColumn("key", F.lit("pair"))
    return bonded.pair_rows(pairs, ends=("i", "j"))


GRIDS = {"pair": (0.0, 0.5, 7), "bond": (0.0, 0.5, 6), "angle": (0.0, 30.0, 7), "dihedral": (-180.0, 45.0, 9)}


def _rows(spark, atoms, shape, pairs=None, by=("frame_id",)):
    out = pairs if pairs is not None else _pairs(atoms)
    for style in COORDINATE:
        out = out.unionByName(bonded.term_rows(terms(spark, style, shape), atoms, style, by))
    return out


def _pick(of):
    out = F.when(F.col("key") == "pair", of("pair"))
    for s in COORDINATE:
        out = out.when(F.col("key") == s, of(s))
    return out


def _basis(style):
    return bonded.hat_basis(F.col("value"), *GRIDS[style])


def _coefficients(style):
    return [0.3 * math.sin(1 + k) for k in range(GRIDS[style][2])]


def _numpy_rows(x):
    """All rows of one frame ``(molecule, atom, axis)``: style, value, sites and slopes by finite differences of the coordinate."""
    ids = list(itertools.product(*map(range, x.shape[:2])))
    lists = [("pair", p) for p in itertools.combinations(ids, 2) if p[0][0] != p[1][0] and 1e-6 <= length([x[i] for i in p]) <= 3.0]
    lists += [(s, tuple((m, k + i) for i in range(n))) for s, (n, _) in COORDINATE.items() for m, k in itertools.product(range(x.shape[0]), range(x.shape[1] - n + 1))]
    for style, sites in lists:
        value = COORDINATE.get(style, (2, length))[1]
        at, slopes = np.array([x[i] for i in sites]), np.zeros((len(sites), 3))
        for i, a in itertools.product(range(len(sites)), range(3)):
            step = np.zeros_like(at)
            step[i, a] = 1e-6
            slopes[i, a] = (value(at + step) - value(at - step)) / 2e-6
        yield style, value(at), sites, slopes


def _numpy_jacobian(x):
    columns = [(s, p) for s in sorted(GRIDS) for p in range(GRIDS[s][2])]
    j = np.zeros((*x.shape, len(columns)))
    for style, v, sites, slopes in _numpy_rows(x):
        lo, step, n = GRIDS[style]
        for p in range(n):
            h = max(0.0, 1 - abs((v - lo) / step - p))
            for site, g in zip(sites, slopes, strict=True):
                j[(*site, slice(None), columns.index((style, p)))] += h * g
    return columns, j.reshape(-1, len(columns))


def _statistics(spark, rows, targets, by=("frame_id",)):
    forces = rows.withColumn("f", _pick(lambda s: bonded.hat_force(F.col("value"), *GRIDS[s][:2], _coefficients(s)))).select(*by, "w", "f", F.explode_outer("sites").alias("s"))
    model = forces.select(*by, "w", "s.atom_id", *[(F.col("f") * F.col(f"s.g{a}")).alias(f"f{a}") for a in "xyz"])
    vectors = force_matching.atom_vectors(bonded.force_jacobian(rows, _pick(_basis), by), model, targets, by)
    return vectors, force_matching.collect_batch(force_matching.statistics(vectors, by), force_matching.observed(targets, by))


@pytest.fixture(scope="module")
def matched(spark, atoms, positions):
    return _statistics(spark, _rows(spark, atoms, positions.shape), atoms.select("frame_id", "w", "atom_id", "fx", "fy", "fz"))


def _numpy_batch(frames):
    """Statistics of ``(weight, positions, targets)``, divided by the weight."""
    total, sums = sum(w for w, _, _ in frames), 0
    for w, x, y in frames:
        columns, j = _numpy_jacobian(x)
        f = j @ np.array([_coefficients(s)[p] for s, p in columns])
        v = np.column_stack([j, f, y.reshape(-1)])
        sums = sums + w * v.T @ v
    return columns, sums / total


def _equals(batch, columns, gram, **scale):
    at = [columns.index(c) for c in batch.parameters]
    assert not gram[np.setdiff1d(np.arange(len(columns)), at)].any()
    f, y = len(columns), len(columns) + 1
    close = {"rtol": 1e-5, "atol": 1e-5 * np.abs(gram).max() ** 0.5} | scale
    assert np.allclose(batch.jtj, gram[np.ix_(at, at)], **close) and np.allclose(batch.jtf, gram[at, f], **close) and np.allclose(batch.jty, gram[at, y], **close)
    assert np.allclose([batch.ftf, batch.fty, batch.yty], [gram[f, f], gram[f, y], gram[y, y]], **close)


def test_statistics_equal_numpy(matched, atoms, positions):
    _, batch = matched
    y = np.array([[r.fx, r.fy, r.fz] for r in atoms.orderBy("frame_id", "atom_id").collect()]).reshape(positions.shape)
    columns, gram = _numpy_batch([(0.5 + 0.25 * f, positions[f], y[f]) for f in range(len(positions))])
    _equals(batch, columns, gram)
    assert (batch.weight, batch.frames, batch.atoms) == (2.25, 3, 30)


def test_atoms_without_a_target_are_not_observed(spark, atoms, positions):
    rows, some = _rows(spark, atoms, positions.shape), atoms.filter("type = 'A'").select("frame_id", "w", "atom_id", "fx", "fy", "fz")
    vectors, batch = _statistics(spark, rows, some)
    assert vectors.filter("atom_id % 2 = 1").count() == 0 and batch.atoms == 18
    none = force_matching.collect_batch(force_matching.statistics(vectors.limit(0)), force_matching.observed(some.limit(0)))
    assert none.parameters == [] and none.frames == 0 and force_matching.solve(none).loss == 0


def test_denoising_statistics_are_taken_at_the_noisy_positions(spark, atoms, positions):
    by, beta, sigma = ("frame_id", "copy"), 1.7, 0.1
    copies = denoising.noisy_copies(atoms, 2, sigma, 5, selected=F.col("type") == "A", original=True)
    pairs = neighbors.exclude_groups(neighbors.copy_pairs(atoms, copies, 3.0, 1.4), "mol_id").withColumn("key", F.lit("pair"))
    rows = _rows(spark, denoising.moved(copies), positions.shape, bonded.pair_rows(pairs, by, ("i", "j")), by)
    targets = denoising.score_targets(copies, beta, sigma).select(*by, "w", "atom_id", "fx", "fy", "fz")
    vectors, _ = _statistics(spark, rows, targets, by)
    batch = force_matching.collect_batch(force_matching.statistics(vectors, by), force_matching.observed(targets, by), scale=beta * beta)
    frames = []
    for f, copy in itertools.product(range(3), range(3)):
        noise = np.array([[r.nx, r.ny, r.nz] for r in copies.filter((F.col("frame_id") == f) & (F.col("copy") == copy)).orderBy("atom_id").collect()]).reshape(positions.shape[1:])
        assert (copy > 0) == bool(np.abs(noise).sum()) and not noise[:, 1::2].any()
        frames.append(((0.5 + 0.25 * f) / 3, positions[f] + noise, -noise / (beta * sigma * sigma)))
    columns, gram = _numpy_batch(frames)
    _equals(batch, columns, gram * beta * beta)
    assert batch.frames == 3 and batch.weight == pytest.approx(2.25) and batch.atoms == 30


def test_noise_options(spark, atoms):
    wrapped = denoising.noisy_copies(atoms, 1, 3.0, 1, wrapped=True)
    assert wrapped.filter("x < 0 OR x >= lx OR copy <> 1").count() == 0 and wrapped.agg(F.sum("w")).first()[0] == pytest.approx(atoms.agg(F.sum("w")).first()[0])
    mixed = denoising.mixed_targets(denoising.noisy_copies(atoms, 1, 0.2, 1, original=True), 0.25, 2.0, 0.2, selected=F.col("type") == "B")
    for r in mixed.join(atoms.select("frame_id", "atom_id", F.col("fx").alias("before")), ["frame_id", "atom_id"]).collect():
        assert r.fx == pytest.approx(0.75 * r.before - 0.25 * r.nx / (2.0 * 0.04) if r["copy"] == 1 and r.type == "B" else r.before)
    for bad in (lambda: denoising.noisy_copies(atoms, 0, 1.0, 1), lambda: denoising.noisy_copies(atoms, 1, -1.0, 1), lambda: denoising.mixed_targets(atoms, 2.0, 1.0, 1.0), lambda: denoising.score_targets(atoms, 1.0, 0.0)):
        with pytest.raises(ValueError):
            bad()


def test_solvers(matched):
    vectors, batch = matched
    ols = force_matching.solve(batch)
    assert ols.loss <= batch.loss and np.allclose(batch.jtj @ ols.theta, batch.jty, atol=1e-8 * np.abs(batch.jty).max())
    ridge = force_matching.solve(batch, "ridge", ridge=0.5)
    assert np.allclose(batch.jtj @ ridge.theta + 0.5 * ridge.theta, batch.jty) and ridge.loss >= ols.loss
    start = np.linspace(-1, 1, len(ols.theta))
    free = np.arange(len(start)) % 3 > 0
    held = force_matching.solve(batch, start=start, free=free)
    assert np.array_equal(held.theta[~free], start[~free]) and np.allclose((batch.jtj @ held.theta - batch.jty)[free], 0, atol=1e-8 * np.abs(batch.jty).max())
    clamped = force_matching.solve(batch, lower=np.full(len(start), -0.1), upper=np.full(len(start), 0.1))
    assert np.abs(clamped.theta).max() <= 0.1 and clamped.loss == pytest.approx(batch.loss_at(clamped.theta))
    with pytest.raises(ValueError, match="mode"):
        force_matching.solve(batch, "best")
    found = force_matching.conjugate_gradients(vectors, tolerance=1e-12, most_passes=200)
    assert list(found) == batch.parameters
    theta = np.array(list(found.values()))
    assert batch.loss_at(theta) == pytest.approx(ols.loss, rel=1e-9) and np.allclose(theta, ols.theta, atol=1e-5 * np.abs(ols.theta).max())


def test_evidence_is_stationary_and_finds_the_noise():
    rng = np.random.RandomState(0)
    j, true = rng.normal(size=(600, 5)), np.array([2.0, -1.0, 0.0, 0.0, 0.5])
    y = j @ true + rng.normal(0, 0.3, 600)
    batch = force_matching.Batch([("k", i) for i in range(5)], j.T @ j / 20, j.T @ y * 0 / 20, j.T @ y / 20, 0.0, 0.0, y @ y / 20, 20.0, 20, 10)
    fit = force_matching.solve(batch, "bayesian", most_passes=2000)
    assert fit.converged and fit.beta == pytest.approx(1 / 0.09, rel=0.1) and np.allclose(fit.theta, true, atol=0.05) and fit.alpha[2] > 20 * fit.alpha[0]
    inverse = np.linalg.inv(fit.beta * j.T @ j + np.diag(fit.alpha))
    known = 1 - fit.alpha * np.diag(inverse)
    assert np.allclose(fit.theta, inverse @ (fit.beta * j.T @ y), rtol=1e-3, atol=1e-5) and fit.beta == pytest.approx((600 - known.sum()) / ((y - j @ fit.theta) ** 2).sum(), rel=1e-3)


FAMILIES = [
    (P.HARMONIC, {"k": 2.0, "r0": 1.1}), (P.LJ126, {"epsilon": 0.7, "sigma": 1.2}), (P.LJ96, {"epsilon": 0.7, "sigma": 1.2}), (P.GAUSSIAN, {"a": 0.8, "r0": 1.2, "s": 0.4}),
    (P.DOUBLE_GAUSSIAN, {"a": 1.0, "b": 0.5, "c": -0.4, "d": 0.2}), (P.COSINE_SOFT, {"a": 2.0, "rc": 3.0}), (P.SOFT_LJ, {"epsilon": 0.5, "sigma": 1.1, "lam": 0.7}), (P.gated(P.LJ126), {"epsilon": 0.7, "sigma": 1.2, "log_alpha": 0.4}), (P.gated(P.HARMONIC), {"k": 2.0, "r0": 1.1, "log_alpha": 9.0}),
]


@pytest.mark.parametrize("family,at", FAMILIES)
def test_derivatives_equal_finite_differences(spark, family, at):
    """Force by the coordinate, gradient and second derivatives by the parameters."""
    points = [0.9, 1.3, 2.2]
    df = spark.createDataFrame([(x,) for x in points], "x double")
    lit = lambda p: {k: F.lit(v) for k, v in p.items()}
    moved = {n: [lit(at | {n: at[n] + s}) for s in (1e-5, -1e-5)] for n in family.names}
    gradient, hessian = family.gradient(F.col("x"), **lit(at)), family.hessian(F.col("x"), **lit(at)) if family.hessian else {}
    want = {"force": -(family.energy(F.col("x") + 1e-5, **lit(at)) - family.energy(F.col("x") - 1e-5, **lit(at))) / 2e-5}
    want |= {n: (family.energy(F.col("x"), **up) - family.energy(F.col("x"), **down)) / 2e-5 for n, (up, down) in moved.items()}
    got = {"force": family.force(F.col("x"), **lit(at))} | gradient
    if family.hessian:
        for a, b in itertools.combinations_with_replacement(family.names, 2):
            up, down = moved[b]
            want[f"{a}/{b}"] = (family.gradient(F.col("x"), **up)[a] - family.gradient(F.col("x"), **down)[a]) / 2e-5
            got[f"{a}/{b}"] = hessian.get((a, b), F.lit(0.0))
    rows = df.select(*[v.alias(f"g_{k}") for k, v in got.items()], *[v.alias(f"w_{k}") for k, v in want.items()]).collect()
    for r in rows:
        for k in got:
            assert r[f"g_{k}"] == pytest.approx(r[f"w_{k}"], rel=1e-5, abs=1e-6), k


def test_gates(spark):
    shut, wide = ({"k": 2.0, "r0": 1.0, "log_alpha": v} for v in (-9.0, 9.0))
    family = P.gated(P.HARMONIC)
    r = spark.range(1).select(family.energy(F.lit(2.0), **shut).alias("shut"), family.energy(F.lit(2.0), **wide).alias("wide"), family.gradient(F.lit(2.0), **shut)["log_alpha"].alias("slope"), *[c.alias(n) for n, c in zip(("low", "rise"), P.gate_penalty(F.lit(0.3), 2.0), strict=True)], P.gate_penalty(F.lit(0.3 + 1e-6), 2.0)[0].alias("high")).first()
    assert (r.shut, r.wide, r.slope) == (0.0, 2.0, 0.0) and r.rise == pytest.approx((r.high - r.low) / 1e-6, rel=1e-4)


@pytest.mark.parametrize("n", [1, 2, 3, 12])
def test_legendre_basis(spark, n):
    x, w = np.polynomial.legendre.leggauss(24)
    x = 1.0 + (x + 1) * 1.5  # [1, 4]
    df = spark.createDataFrame([(float(v),) for v in x] + [(float(v) + 1e-6,) for v in x], "x double")
    rows = {r.x: r.b for r in df.select("x", P.legendre_basis(F.col("x"), n, 1.0, 4.0).alias("b")).collect()}
    v, d = (np.array([rows[float(p)][i] for p in x]) for i in (0, 1))
    after = np.array([rows[float(p) + 1e-6]["values"] for p in x])
    assert v.shape == (24, n) and np.allclose((v * w[:, None] * 1.5).T @ v, np.eye(n), atol=1e-9) and np.allclose(d, (after - v) / 1e-6, atol=2e-3)


def test_covariance_has_every_two_parameters(spark):
    """Against dense numpy; parameters 0 of a and 1 of b never meet."""
    g = {0: {("a", 0): 1.0, ("a", 1): 2.0}, 1: {("b", 1): 3.0, ("a", 1): -1.0}, 2: {}, 3: {("b", 0): 5.0}}
    frames = spark.createDataFrame([(f, 1.0 + f) for f in g], "frame_id long, w double")
    rows = spark.createDataFrame([(k, f, 1.0 + f, p, v) for f, vs in g.items() for (k, p), v in vs.items()], "key string, frame_id long, w double, p int, g double")
    names = [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    dense, w = np.array([[g[f].get(n, 0.0) for n in names] for f in g]), np.array([1.0 + f for f in g])
    mean = w @ dense / w.sum()
    want = (dense * w[:, None]).T @ dense / w.sum() - np.outer(mean, mean)
    got = {((r.key, r.p), (r.key2, r.q)): r.c for r in gradients.covariance(rows, frames, F.lit(True)).collect()}
    assert len(got) == 10 and all(c == pytest.approx(want[names.index(a), names.index(b)]) for (a, b), c in got.items())
    outer = {((r.key, r.p), (r.key2, r.q)): r.h for r in gradients.outer_products(rows).collect()}
    assert outer[("a", 1), ("b", 1)] == -6.0 and (("a", 0), ("b", 1)) not in outer


@needs_data
def test_registered_fits_solve_their_normal_equations(spark):
    from mesospark.plans.trajectory_forces import GRIDS as MODEL
    from mesospark.plans.trajectory_forces import _batch

    batch, got = _batch(spark, DATA), QUERIES["M01"](spark, DATA).toPandas().set_index(["key", "p"])
    fit = got.loc[batch.parameters]
    size = np.sqrt(np.diag(batch.jtj))
    assert np.abs((batch.jtj @ fit.ols - batch.jty) / size).max() < 1e-6 * np.abs(batch.jty / size).max()
    assert np.allclose(fit.loc["bond"].frozen, [MODEL["bond"][2][p] for p in fit.loc["bond"].index])
    loss = got.loc["~loss"].iloc[0]
    assert loss.ols <= min(loss.ridge, loss.bayesian, loss.frozen) + 1e-9 and loss.ols < 0.5 * batch.yty
