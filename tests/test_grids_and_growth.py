"""Unwrapping by doubling, lookups on uneven grids, frames that arrive again, added sites that make room."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesospark.operators import neighbors, tables, topology
from mesospark.streaming.incremental import streamed_frame_histogram

EDGE = 10.0


def _atoms(spark, rows):
    return spark.createDataFrame([(*r, EDGE, EDGE, EDGE) for r in rows], "frame_id long, atom_id long, x double, y double, z double, lx double, ly double, lz double")


@pytest.mark.parametrize("order", ["along", "shuffled"])
def test_a_long_chain_is_made_whole_in_few_passes(spark, monkeypatch, order):
    n, rng = 5000 if order == "along" else 100, np.random.RandomState(1)
    whole = np.cumsum(rng.uniform(-1, 1, (n, 3)), axis=0)
    ids = np.arange(n) if order == "along" else rng.permutation(n)
    start = whole[int(np.argmin(ids))]
    whole = whole - start + np.mod(start, EDGE)  # as seen from the least atom
    atoms = _atoms(spark, [(0, int(ids[k]), *map(float, np.mod(whole[k], EDGE))) for k in range(n)])
    bonds = spark.createDataFrame([(0, int(ids[k]), int(ids[k + 1])) for k in range(n - 1)], "frame_id long, i long, j long")
    components = atoms.select("frame_id", "atom_id", F.lit(0).cast("long").alias("component"))
    passes = []
    joined = topology._joined_to
    monkeypatch.setattr(topology, "_joined_to", lambda hooks, end: (passes.append(end), joined(hooks, end))[1])
    got = {r.atom_id: (r.x, r.y, r.z) for r in topology.unwrapped(atoms, bonds, components).collect()}
    assert np.allclose([got[int(i)] for i in ids], whole, atol=1e-8) and passes.count("on") < 40 and (order != "along" or passes.count("on") < 20)


def test_rings_branches_and_frames_are_made_whole(spark):
    ring = [(9.5, 1.0), (0.5, 1.0), (0.5, 2.0), (9.5, 2.0)]  # across the cell's side
    rows = [(f, k + 1, (x + f) % EDGE, y, 5.0) for f in (0, 1) for k, (x, y) in enumerate(ring)] + [(0, 9, 9.6, 9.7, 0.1), (0, 8, 0.2, 0.3, 9.9)]
    bonds = spark.createDataFrame([(f, i, j) for f in (0, 1) for i, j in ((1, 2), (2, 3), (3, 4), (4, 1))] + [(0, 8, 9), (0, 9, 8), (0, 9, 9)], "frame_id long, i long, j long")
    atoms = _atoms(spark, rows)
    components = topology.bonded_components(bonds.filter("i <> j"))
    got = {(r.frame_id, r.atom_id): (r.component, r.x, r.y, r.z) for r in topology.unwrapped(atoms, bonds, components).collect()}
    assert got[0, 3] == pytest.approx((1, 10.5, 2.0, 5.0)) and got[1, 3] == pytest.approx((1, 1.5, 2.0, 5.0)) and got[0, 9] == pytest.approx((8, -0.4, -0.3, 10.1)) and len(got) == 10
    assert topology.unwrapped(atoms.limit(0), bonds, components).count() == 0


def _table(spark, grids):
    return spark.createDataFrame([(k, float(x), float(f), float(v)) for k, (xs, fs, vs) in grids.items() for x, f, v in zip(xs, fs, vs, strict=True)], "key string, x double, f double, v double")


def _grids(seed, shift=0.0):
    rng = np.random.RandomState(seed)
    out = {}
    for key, n in (("a", 2), ("b", 7), ("c", 60)):
        x = np.sort(np.concatenate([[0.5 + shift, 3.0 + shift], rng.uniform(0.5, 0.5 + 2.5 * rng.rand(), n - 2) + shift]))
        out[key] = (x, np.cos(2 * x), np.sin(x))
    return out


@pytest.mark.parametrize("salts", [1, 3])
def test_uneven_lookup_equals_numpy(spark, salts):
    grids, rng = _grids(4), np.random.RandomState(5)
    xs = [*rng.uniform(-1, 5, 200), 0.5, 3.0, *grids["c"][0][:5]]
    points = spark.createDataFrame([(k, float(x), i) for k in ("a", "b", "c", "none") for i, x in enumerate(xs)] + [("a", None, 999), ("b", float("nan"), 998)], "key string, x double, i int")
    got = {(r.key, r.i): r for r in tables.lookup_uneven(points, _table(spark, grids), salts).collect()}
    assert len(got) == 3 * len(xs)
    for (key, i), r in got.items():
        x, f, v = grids[key]
        assert r.force == pytest.approx(np.interp(xs[i], x, f), abs=1e-9)
        beyond = -f[0] * (xs[i] - x[0]) if xs[i] < x[0] else -f[-1] * (xs[i] - x[-1]) if xs[i] > x[-1] else 0.0
        assert r.energy == pytest.approx(np.interp(xs[i], x, v) + beyond, abs=1e-9)
    assert tables.lookup_uneven(points.limit(0), _table(spark, grids)).count() == 0


def test_tables_are_compared_on_their_overlap(spark):
    one, two = _grids(4), _grids(6, 0.3)
    got = {r.key: r for r in tables.compared_on_overlap(_table(spark, one), _table(spark, two), 50).collect()}
    assert set(got) == {"a", "b", "c"}
    for key, r in got.items():
        x = np.linspace(max(one[key][0][0], two[key][0][0]), min(one[key][0][-1], two[key][0][-1]), 50)
        f, v = ([np.interp(x, t[key][0], t[key][c]) for t in (one, two)] for c in (1, 2))
        assert r.df == pytest.approx(np.abs(f[0] - f[1]).max(), abs=1e-9) and r.dv == pytest.approx(np.abs(v[0] - v[1]).max(), abs=1e-9) and r["shift"] >= 0
    with pytest.raises(Exception, match="no range in common"):
        tables.compared_on_overlap(_table(spark, one), _table(spark, _grids(4, 9.0))).collect()


def test_a_frame_that_comes_again_replaces_itself(spark, tmp_path):
    schema = "frame_id long, key string, value double, w double"
    frame = lambda f, shift: [(f, k, 0.1 + 0.37 * i + shift, 1.0 + f) for i in range(6) for k in "ab"]
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    kind = spark.createDataFrame([], schema).schema
    take = lambda: {(r.key, r.bin): (round(r["count"], 6), r.n) for r in streamed_frame_histogram(spark, f"{tmp_path}/in", kind, f"{tmp_path}/state", 0.0, 3.0, 10).collect()}

    def batch(rows):
        out: dict = {}
        for f, key, value, w in rows:
            if 0 <= value <= 3:
                at = (key, min(int(value / 0.3), 9))
                out[at] = (round(out.get(at, (0, 0))[0] + w, 6), out.get(at, (0, 0))[1] + 1)
        return out

    put("0", frame(0, 0.0) + frame(1, 0.0))
    assert take() == batch(frame(0, 0.0) + frame(1, 0.0))
    put("1", frame(1, 0.5) + frame(2, 0.0))  # frame 1 again
    assert take() == batch(frame(0, 0.0) + frame(1, 0.5) + frame(2, 0.0)) == take()
    put("2", frame(2, 0.2))
    put("3", frame(2, 0.9))  # twice in one batch: the later file counts
    put("4", [(0, "a", 99.0, 1.0)])  # again, with nothing in range
    assert take() == batch(frame(1, 0.5) + frame(2, 0.9))


def test_only_added_sites_move(spark):
    rng = np.random.RandomState(3)
    rows = [(0, k, *map(float, p)) for k, p in enumerate(np.array(np.meshgrid(*[np.arange(1.0, 10, 3)] * 3)).reshape(3, -1).T)]
    added = [(0, 100 + k, *map(float, np.mod(np.array(rows[k % 27][2:]) + rng.uniform(-0.2, 0.2, 3) * (k % 5 > 0), EDGE))) for k in range(40)]
    atoms = _atoms(spark, rows + added)
    got = {r.atom_id: (r.x, r.y, r.z) for r in neighbors.push_added(atoms, F.col("atom_id") >= 100, 0.5, passes=40).collect()}
    assert len(got) == 67 and all(got[r[1]] == r[2:] for r in rows)
    x = np.array([got[k] for k in sorted(got)])
    d = x[:, None] - x[None]
    d = np.linalg.norm(d - EDGE * np.round(d / EDGE), axis=2) + 9 * np.eye(67)
    before = np.array([r[2:] for r in rows + added])
    e = before[:, None] - before[None]
    e = np.linalg.norm(e - EDGE * np.round(e / EDGE), axis=2) + 9 * np.eye(67)
    assert d[27:].min() > 0.45 > e[27:].min() == 0.0
    assert neighbors.push_added(atoms.filter("atom_id < 100"), F.lit(True), 0.5).count() == 27
