"""Splines, fits, force maps, conditional steps, topologies and table files against closed forms and numpy."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesospark.functions import splines as S
from mesospark.operators import conditional, extensions, force_maps, neighbors, selection, tables, topology
from mesospark.plans import trajectory_fits, trajectory_models, trajectory_more  # noqa: F401  (registers)
from mesospark.plans.trajectory import QUERIES, _coefficients, _table
from mesospark.sources import adapters as A
from mesospark.sources.table_files import load_tables, write_tables

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_clamped_bases_sum_to_one_and_have_the_slopes_and_integrals_of_their_sum(spark, degree):
    knots, c = S.clamped_knots(0.5, 2.5, 7, degree), [0.3, -0.2, 0.7, 0.1, -0.5, 0.4, 0.2]
    x = np.linspace(0.5, 2.5, 41)
    b = S.basis_array(x, knots, degree)
    assert np.allclose(b.sum(1), 1) and (b >= -1e-12).all()
    h = 1e-5
    rows = spark.createDataFrame([(float(v),) for v in x[1:-1] + 1e-3], "x double")
    at = lambda v: S.spline(v, knots, c, degree)
    got = rows.select("x", at(F.col("x")).alias("f"), S.spline_slope(F.col("x"), knots, c, degree).alias("s"), ((at(F.col("x") + h) - at(F.col("x") - h)) / (2 * h)).alias("s0"), S.spline_rest(F.col("x"), knots, c, degree).alias("u")).collect()
    fine = np.linspace(0.5, 2.5, 200_001)
    f = S.basis_array(fine, knots, degree) @ c
    rest = np.r_[np.cumsum(((f[1:] + f[:-1]) / 2 * np.diff(fine))[::-1])[::-1], 0]
    for r in got:
        assert r.f == pytest.approx(float((S.basis_array(np.array([r.x]), knots, degree) @ c)[0]), abs=1e-12)
        assert r.s == pytest.approx(r.s0, abs=1e-5) and r.u == pytest.approx(float(np.interp(r.x, fine, rest)), abs=1e-6)


def test_periodic_bases_fold_and_integrate_to_zero(spark):
    x = np.linspace(-180, 180, 3601)[:-1]
    for k in range(8):
        b = S.periodic_basis(x, k, 8, np.where)
        assert abs(b.mean()) < 1e-9 and np.allclose(b, S.periodic_basis(x + 360, k, 8, np.where))
    sums = sum(S.periodic_basis(x, k, 8, np.where) for k in range(8))
    assert np.allclose(sums, 0, atol=1e-9)
    got = [r.b for r in spark.createDataFrame([(float(v),) for v in x[::97]], "x double").select(S.periodic_basis(F.col("x"), 3, 8).alias("b")).collect()]
    assert np.allclose(got, S.periodic_basis(x[::97], 3, 8, np.where))


def test_dihedral_fit_recovers_a_force_of_zero_integral(spark):
    x = np.arange(-172.5, 180, 7.5)
    c = np.array([0.3, -0.1, 0.4, -0.2, 0.1, -0.5])
    f = sum(v * S.periodic_basis(x, k, 6, np.where) for k, v in enumerate(c))
    table = spark.createDataFrame([("dihedral:A:A:A:A", float(a), float(b)) for a, b in zip(x, f, strict=True)], "key string, x double, f double")
    got = [r.c for r in extensions.fit_tables(table, "dihedral", n=6).orderBy("p").collect()]
    assert np.allclose(got, c - c.mean(), atol=1e-6)
    with pytest.raises(Exception, match="needs 8"):
        extensions.fit_tables(table.limit(5), "dihedral").collect()


def test_spline_fit_is_weighted_least_squares(spark):
    rng = np.random.RandomState(1)
    x, f, w = np.linspace(1, 2, 30), rng.normal(size=30), rng.uniform(0.5, 2, 30)
    table = spark.createDataFrame([("k", float(a), float(b), float(c)) for a, b, c in zip(x, f, w, strict=True)], "key string, x double, f double, weight double")
    got = [r.c for r in extensions.fit_tables(table, "spline", n=6, degree=3).orderBy("p").collect()]
    b = S.basis_array(x, S.clamped_knots(1.0, 2.0, 6, 3), 3)
    assert np.allclose(got, np.linalg.lstsq(b * np.sqrt(w)[:, None], f * np.sqrt(w), rcond=None)[0], atol=1e-5)


def test_gaussian_amplitudes_keep_their_bounds_and_are_optimal(spark):
    x = np.linspace(0, 4, 50)
    centres = np.linspace(0, 4, 5)
    design = np.exp(-((x[:, None] - centres) ** 2) / 2)
    v = design @ [3.0, -1.0, -0.5, 0.0, -0.2]
    table = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, v, strict=True)], "key string, x double, v double")
    got = [r.c for r in extensions.fit_tables(table, "gaussians", n=5).orderBy("p").collect()]
    assert np.allclose(got, [3.0, -1.0, -0.5, 0.0, -0.2], atol=1e-3)
    rng = np.random.RandomState(2)
    for _ in range(20):  # no neighbour within the bounds is better
        a, y = rng.normal(size=(12, 4)), rng.normal(size=12)
        low, high = np.array([0, -np.inf, -np.inf, 0.2]), np.array([np.inf, 0, 0.1, 0.5])
        c = extensions.bounded_least_squares(a, y, low, high)
        assert ((c >= low - 1e-12) & (c <= high + 1e-12)).all()
        for _ in range(50):
            other = np.clip(c + 0.01 * rng.normal(size=4), low, high)
            assert ((a @ other - y) ** 2).sum() >= ((a @ c - y) ** 2).sum() - 1e-9


def test_unknown_and_repeated_names_are_errors():
    with pytest.raises(KeyError, match="no fitter"):
        extensions.FITTERS["none"]
    with pytest.raises(ValueError, match="there is a"):
        extensions.FITTERS.add("line", None)


def _two_frames(spark, edge=10.0):
    """The same molecule ids in two frames."""
    rng, rows = np.random.RandomState(3), []
    for frame in (0, 1):
        for mol in (0, 1, 2):
            start = rng.uniform(0, edge, 3)
            for o in range(1, 5):
                u = start + [0.9 * o, 0.3 * (o % 2), 0.1 * o]
                rows.append((frame, mol * 4 + o - 1, mol, o, "AN"[o % 2], *rng.normal(size=3).tolist(), edge, edge, edge, 1.0, *u.tolist(), *(u % edge).tolist()))
    names = "frame_id long, atom_id long, mol_id long, ord long, type string, fx double, fy double, fz double, lx double, ly double, lz double, w double, ux double, uy double, uz double, x double, y double, z double"
    return spark.createDataFrame(rows, names)


def test_optimal_map_meets_its_condition_and_beats_others(spark):
    atoms = force_maps.with_template(_two_frames(spark))
    moments = force_maps.force_moments(atoms)
    rows = moments.toPandas()
    assert (rows.n == 6).all() and (rows.template == 4).all()  # three molecules in each of two frames
    coordinate = spark.createDataFrame([(4, s, a, 0.5) for s, a in ((0, 1), (0, 2), (1, 3), (1, 4))], "template long, site long, atom long, c double")
    got = force_maps.optimal_map(moments, coordinate).toPandas()
    w = got.pivot(index="site", columns="atom", values="weight").to_numpy()
    q = np.zeros((4, 4))
    q[rows.i - 1, rows.j - 1] = q[rows.j - 1, rows.i - 1] = rows.q
    c = np.array([[0.5, 0.5, 0, 0], [0, 0, 0.5, 0.5]])
    assert np.abs(w @ c.T - np.eye(2)).max() <= 1e-7 and got.objective.iloc[0] <= got.given_objective.iloc[0]
    rng, free = np.random.RandomState(4), np.linalg.svd(c)[2][2:]
    for _ in range(50):
        other = w + rng.normal(size=(2, 2)) @ free * 0.1
        assert np.trace(other @ q @ other.T) >= np.trace(w @ q @ w.T) - 1e-9
    bad = spark.createDataFrame([(4, s, a, 0.5) for s in (0, 1) for a in (1, 2)], "template long, site long, atom long, c double")
    with pytest.raises(Exception, match="not independent"):
        force_maps.optimal_map(moments, bad).collect()


def test_groups_and_uniform_maps(spark):
    members = spark.createDataFrame([(t, a) for t in (3, 4) for a in range(1, t + 1)], "template long, atom long")
    pairs = spark.createDataFrame([(4, 1, 2), (4, 2, 4), (3, 2, 3)], "template long, i long, j long")
    groups = force_maps.constraint_groups(members, pairs)
    assert {(r.template, r.atom): r.group for r in groups.collect()} == {(3, 1): 1, (3, 2): 2, (3, 3): 2, (4, 1): 1, (4, 2): 1, (4, 3): 3, (4, 4): 1}
    coordinate = spark.createDataFrame([(4, 0, 1, 1.0), (4, 1, 3, 1.0), (3, 0, 1, 0.5), (3, 0, 2, 0.5)], "template long, site long, atom long, c double")
    got = {(r.template, r.site, r.atom) for r in force_maps.uniform_map(groups, coordinate).collect()}
    assert got == {(4, 0, 1), (4, 0, 2), (4, 0, 4), (4, 1, 3), (3, 0, 1), (3, 0, 2), (3, 0, 3)}


def test_terms_and_components_stay_within_frames(spark):
    atoms = _two_frames(spark)
    bonds = A.terms(atoms, "bond")
    assert bonds.count() == 18 and bonds.filter("a2 <> a1 + 1").count() == 0
    links = bonds.select("frame_id", F.col("a1").alias("i"), F.col("a2").alias("j"))
    found = topology.bonded_components(links)
    assert {(r.frame_id, r.atom_id): r.component for r in found.collect()} == {(f, a): a // 4 * 4 for f in (0, 1) for a in range(12)}
    whole = {(r.frame_id, r.atom_id): r for r in topology.unwrapped(atoms, links, found).collect()}
    assert len(whole) == 24
    for r in atoms.collect():
        first = next(x for x in atoms.filter(f"frame_id = {r.frame_id} AND atom_id = {r.mol_id * 4}").collect())
        assert whole[r.frame_id, r.atom_id].x == pytest.approx(first.x + r.ux - first.ux) and whole[r.frame_id, r.atom_id].z == pytest.approx(first.z + r.uz - first.uz)
    assert {r["count"] for r in force_maps.distance_moments(force_maps.with_template(atoms)).groupBy("n").count().collect()} == {6}


def test_components_move_as_little_as_can_be(spark):
    whole = [(0, 1, 1, 1.0), (0, 2, 1, 3.0), (0, 3, 3, 9.5), (0, 4, 3, 10.5), (0, 5, 5, 4.0), (0, 6, 5, 5.0)]
    atoms = [(0, 1, 1.0), (0, 2, 3.0), (0, 3, 9.5), (0, 4, 0.5), (0, 5, 4.0), (0, 6, 5.0)]
    got = topology.refitted_z(spark.createDataFrame([(f, a, c, 0.0, 0.0, z) for f, a, c, z in whole], "frame_id long, atom_id long, component long, x double, y double, z double"), spark.createDataFrame(atoms, "frame_id long, atom_id long, z double"), 2.0, 10.0)
    assert {r.atom_id: r.z + 8.0 * r.image for r in got.collect()} == {1: 2.0, 2: 4.0, 3: 9.0, 4: 10.0, 5: 4.0, 6: 5.0}
    with pytest.raises(Exception, match="longer than the box"):
        topology.refitted_z(spark.createDataFrame([(0, 1, 1, 0.0), (0, 2, 1, 9.0)], "frame_id long, atom_id long, component long, z double"), spark.createDataFrame(atoms, "frame_id long, atom_id long, z double"), 0.0, 5.0).collect()


def test_templates_links_and_added_sites(spark):
    residues = spark.createDataFrame([(0, 0, "P", -1), (0, 1, "Q", 2), (0, 2, "P", 4)], "frame_id long, residue long, name string, first long")
    templates = spark.createDataFrame([("P", 1, 2), ("P", 2, 3), ("Q", 1, 2), ("Z", 1, 2)], "name string, i long, j long")
    links = spark.createDataFrame([("P", 3, 1), ("Q", 2, 1)], "name string, site long, next_site long")
    got = {(r.i, r.j, r.origin) for r in topology.residue_topology(residues, templates, links).collect()}
    assert got == {(0, 1, "template"), (1, 2, "template"), (3, 4, "template"), (5, 6, "template"), (6, 7, "template"), (2, 3, "link"), (4, 5, "link")}
    labels = spark.createDataFrame([(0, 0, "A", 0), (0, 1, "A", 3), (0, 2, "A", 5)], "frame_id long, residue long, label string, atom_id long")
    last = spark.createDataFrame([(0, 7)], "frame_id long, last long")
    added, bonds = topology.append_sites(residues, spark.createDataFrame([("P", "V2", "A"), ("Q", "V1", "A")], "name string, site_name string, bond_to string"), labels, last)
    assert {(r.residue, r.atom_id, r.code) for r in added.collect()} == {(0, 8, 2), (1, 9, 1), (2, 10, 2)}
    assert {(r.i, r.j) for r in bonds.collect()} == {(0, 8), (3, 9), (5, 10)}
    with pytest.raises(Exception, match="no atom is labelled"):
        topology.append_sites(residues, spark.createDataFrame([("P", "V", "B")], "name string, site_name string, bond_to string"), labels, last)[1].collect()


def test_conditional_gradients_and_step_equal_numpy(spark):
    rng = np.random.RandomState(5)
    n, rows, params, beta = 12, 4, 3, 1.3
    x, w = np.arange(n) % 2, rng.uniform(0.5, 2, n)
    j, f, g, y = rng.normal(size=(n, rows, params)), rng.normal(size=(n, rows)), rng.normal(size=(n, params)), rng.normal(size=(2, rows))
    table = lambda names, data: spark.createDataFrame(data, names)
    found, errors = conditional.conditional_gradients(
        table("frame_id long, x long, w double", [(i, int(x[i]), float(w[i])) for i in range(n)]),
        table("frame_id long, row string, p int, j double", [(i, str(r), p, float(j[i, r, p])) for i in range(n) for r in range(rows) for p in range(params)]),
        table("frame_id long, row string, f double", [(i, str(r), float(f[i, r])) for i in range(n) for r in range(rows)]),
        table("x long, row string, y double", [(k, str(r), float(y[k, r])) for k in (0, 1) for r in range(rows)]),
        table("frame_id long, p int, g double", [(i, p, float(g[i, p])) for i in range(n) for p in range(params)]),
        beta,
    )
    direct, reinforce = np.zeros((2, params)), np.zeros((2, params))
    for k in (0, 1):
        own = w * (x == k) / (w * (x == k)).sum()
        e = own @ f - y[k]
        direct[k] = np.einsum("i,irp,r->p", own, j, e)
        fe = f @ e
        reinforce[k] = -beta * ((own * fe) @ g - (own @ g) * (own @ fe))
        assert errors.filter(f"x = {k}").first().sse == pytest.approx((e * e).sum())
    got = {(r.x, r.p): r for r in found.collect()}
    for k in (0, 1):
        for p in range(params):
            assert got[k, p].direct == pytest.approx(direct[k, p]) and got[k, p].reinforce == pytest.approx(reinforce[k, p])
    d, r = direct.mean(0), reinforce.mean(0)
    r = r * min(1, 0.1 * np.linalg.norm(d) / np.linalg.norm(r))
    step = {s.p: s for s in conditional.conditional_step(found, clip_ratio=0.1).collect()}
    assert all(step[p].gradient == pytest.approx(d[p] + r[p]) for p in range(params))
    weighed = {s.p: s.direct for s in conditional.conditional_step(found.withColumn("wx", 1.0 + F.col("x"))).collect()}
    seen = found.collect()
    total = sum(1.0 + x for x in {r.x for r in seen})
    assert all(v == pytest.approx(sum((1.0 + r.x) * r.direct for r in seen if r.p == p) / total) for p, v in weighed.items())
    frozen = {s.p: s.gradient for s in conditional.conditional_step(found, latent=(1,), mode="direct").collect()}
    assert frozen[1] == 0 and frozen[0] == pytest.approx(d[0])


def test_mean_force_matching(spark):
    model, reference = [(0, 1.0), (1, 2.0), (2, 4.0), (5, 9.0)], [(0, 0.5), (1, 1.0), (2, 1.0), (7, 3.0)]
    mean = [(0, 0, 1.0), (1, 0, 2.0), (2, 1, 3.0), (5, 1, 100.0)]
    gradient, delta = conditional.mean_force_matching(*(spark.createDataFrame(t, "bin int, f double") for t in (model, reference)), spark.createDataFrame(mean, "bin int, p int, g double"))
    assert {r.bin: r.delta for r in delta.collect()} == {0: -1.0, 1: -0.5, 2: 1.5}
    assert {r.p: r.gradient for r in gradient.collect()} == {0: -2.0, 1: 4.5}


def test_table_files_round_trip_and_errors(spark, tmp_path):
    rows = [(k, i, 0.5 + 0.25 * i, 1.0 / (i + 1), -0.1 * i) for k in ("bond:A:B", "dihedral:A:A:A:A") for i in range(4)]
    write_tables(spark.createDataFrame(rows, "key string, i int, x double, v double, f double"), str(tmp_path / "t"))
    got = [(r.key, r.i, r.x, r.v, r.f) for r in load_tables(spark, str(tmp_path / "t")).orderBy("key", "i").collect()]
    assert got == rows
    plain = "# note\n\ndihedral_x\nN 2 NOF\n\n1 0.0 1.0 2.0\n2 3.141592653589793 1.0 2.0\n\nother\nN 1 R 1 1\n\n1 1.0 0.0 -1e-3\n"
    (tmp_path / "one.txt").write_text(plain)
    got = load_tables(spark, str(tmp_path / "one.txt")).orderBy("keyword", "i").collect()
    assert [(r.keyword, r.i) for r in got] == [("dihedral_x", 0), ("dihedral_x", 1), ("other", 0)] and got[1].x == pytest.approx(180.0) and got[1].f == pytest.approx(2 * np.pi / 180) and got[2].f == -1e-3
    for text, message in (
        ("a\nN 1 R 1 1\n1 1 1 1\na\nN 1 R 1 1\n1 1 1 1\n", "occurs twice"),
        ("a\nN 2 R 1 1\n1 1 1 1\n", "another number of rows"),
        ("a\nN 1 R 1 1\n1 1 1\n", "not four numbers"),
        ("a\nN 1 R 1 1\n1 1 nan 1\n", "not four numbers"),
        ("a\nN 2 R 1 1\n1 1 1 1\n2 1 1 1\n", "do not rise"),
    ):
        path = tmp_path / f"{abs(hash(text))}.txt"
        path.write_text(text)
        with pytest.raises(Exception, match=message):
            load_tables(spark, str(path)).collect()


def test_frames_are_numbered_and_split_in_order(spark):
    frames = spark.range(5, 58, 3).withColumnRenamed("id", "frame_id").repartition(4)
    ids = sorted(r.frame_id for r in frames.collect())
    assert {r.frame_id: r.n for r in selection.numbered(frames, "frame_id").collect()} == {f: k for k, f in enumerate(ids)}
    for n in (1, 4, 7, 30):
        got = {r.frame_id: r.part for r in selection.split_frames(frames, n).collect()}
        assert [got[f] for f in ids] == [k for k, part in enumerate(np.array_split(ids, n)) for _ in part]


def test_asking_for_too_much_is_an_error(spark):
    frames = spark.range(3).withColumnRenamed("id", "frame_id")
    with pytest.raises(ValueError, match="there are 3"):
        selection.sample_starts(frames, 4, 1)
    with pytest.raises(ValueError, match="no frame has fx"):
        selection.with_channels(frames.withColumn("fx", F.lit(None).cast("double")), ["fx"])


def test_far_copies_are_an_error(spark):
    atoms = _two_frames(spark)
    copies = atoms.withColumns({"copy": F.lit(1), "nx": F.lit(0.4), "ny": F.lit(0.0), "nz": F.lit(0.0)})
    assert neighbors.copy_pairs(atoms, copies, 2.0, 1.0).count() > 0
    with pytest.raises(Exception, match="more than half of the skin"):
        neighbors.copy_pairs(atoms, copies, 2.0, 0.5).collect()


def test_tables_without_common_points_are_an_error(spark):
    t = spark.createDataFrame([("k", 0, 1.0, 1.0)], "key string, i int, f double, v double")
    with pytest.raises(Exception, match="no point in common"):
        tables.compared(t, t.withColumn("i", F.lit(5))).collect()


@needs_data
def test_fits_of_the_registered_tables_equal_numpy(spark):
    table = _table(spark, DATA).toPandas().sort_values(["key", "x"])
    got = QUERIES["M09"](spark, DATA).toPandas()
    for key, t in table.groupby("key"):
        w = 1.0 + t.i.to_numpy() % 3
        b = S.basis_array(t.x.to_numpy(), S.clamped_knots(t.x.min(), t.x.max(), 5, 3), 3)
        fitted = b @ got[got.key == key].sort_values("p").c.to_numpy()
        best = b @ np.linalg.lstsq(b * np.sqrt(w)[:, None], t.f * np.sqrt(w), rcond=None)[0]
        assert np.allclose(fitted, best, atol=1e-3)
    lines = QUERIES["M11"](spark, DATA).toPandas()
    assert (lines[lines.p == 0].c >= 0).all() and (lines[lines.p > 0].c <= 0).all() and len(lines) == 5 * table.key.nunique()
    sums = QUERIES["M10"](spark, DATA).toPandas().groupby("key").c.sum()
    assert len(sums) and np.allclose(sums, 0, atol=1e-3)


@needs_data
def test_mode_cutoff_equals_numpy(spark):
    c = _coefficients(spark, DATA, 16).toPandas()
    c["wc"] = c.w * c.c
    mean = c.groupby(["key", "mode"]).agg({"wc": "sum", "w": "sum"}).reset_index()
    mean["y"] = np.log(np.abs(mean.wc / mean.w) + 1e-12)
    want = {}
    for key, t in mean.groupby("key"):
        y = t.sort_values("mode").y.to_numpy()
        scored = []
        for k in range(2, len(y) - 2):
            x = np.arange(k + 1)
            line = np.polyfit(x, y[: k + 1], 1)
            scored.append((((np.polyval(line, x) - y[: k + 1]) ** 2).sum() + ((y[k + 1 :] - y[k + 1 :].mean()) ** 2).sum(), k, line[0]))
        _, k, slope = min(scored)
        want[key] = k if slope < 0 else 15
    assert {r.key: r.cutoff for r in QUERIES["A11"](spark, DATA).collect()} == want


@needs_data
def test_pushes_leave_fewer_close_pairs(spark):
    got = QUERIES["V02"](spark, DATA).toPandas()
    assert got.before.sum() > 20 and got.after.sum() < got.before.sum() / 4


def test_two_atoms_are_pushed_to_the_least_distance(spark):
    atoms = _two_frames(spark).filter("ord = 1").withColumns({"x": F.lit(9.9) + 0.3 * F.col("mol_id"), "y": F.lit(1.0), "z": F.lit(1.0)}).filter("mol_id < 2").withColumn("x", F.pmod("x", "lx"))
    moved = neighbors.push_apart(atoms, 0.6)
    assert [round(r.r, 6) for r in neighbors.neighbor_pairs(moved, 0.7).collect()] == [0.6, 0.6]
