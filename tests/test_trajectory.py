"""Every trajectory query with SQL against DuckDB, and closed-form cases of the operators."""

import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mesospark.functions import potentials as P
from mesospark.operators import neighbors, stats, tables, topology
from mesospark.operators.components import connected_components
from mesospark.plans import trajectory_fits, trajectory_forces, trajectory_models, trajectory_more, trajectory_tables  # noqa: F401  (registers)
from mesospark.plans.trajectory import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, DATA).toPandas()
    by = sorted(got.columns)
    want = con.sql(ORACLE[name]).df()
    assert by == sorted(want.columns) and len(got) == len(want) > 0
    got, want = (x[by].sort_values(by, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def _atoms(spark, places, edge=10.0):
    rows = [(0, i, "A", i, 1.0, edge, edge, edge, *map(float, p)) for i, p in enumerate(places)]
    return spark.createDataFrame(rows, "frame_id long, atom_id long, type string, mol_id long, w double, lx double, ly double, lz double, x double, y double, z double")


@pytest.mark.parametrize("cutoff", [1.5, 2.5, 4.9])
def test_pairs_equal_brute_force_and_do_not_change_with_the_origin(spark, cutoff):
    import random

    rng = random.Random(5)
    places = [[rng.random() * 10 for _ in range(3)] for _ in range(60)]

    def brute(ps):
        out = set()
        for i in range(60):
            for j in range(i + 1, 60):
                d = [b - a - 10 * round((b - a) / 10) for a, b in zip(ps[i], ps[j], strict=True)]
                if math.sqrt(sum(x * x for x in d)) <= cutoff:
                    out.add((i, j))
        return out

    for shift in (0.0, 3.7):
        moved = [[(x + shift) % 10 for x in p] for p in places]
        got = {(r.i, r.j) for r in neighbors.neighbor_pairs(_atoms(spark, moved), cutoff).collect()}
        assert got == brute(moved) == brute(places)


def test_too_large_a_cutoff_is_an_error(spark):
    with pytest.raises(Exception, match="half a cell edge"):
        neighbors.neighbor_pairs(_atoms(spark, [[1, 1, 1]]), 5.1).collect()


def test_last_bin_is_closed(spark):
    rows = spark.createDataFrame([("k", v, 2.0) for v in (0.0, 0.5, 1.0, 1.01, -0.1)], "key string, value double, w double")
    assert {(r["bin"], r["count"]) for r in stats.histogram(rows, 0.0, 1.0, 2).collect()} == {(0, 2.0), (1, 4.0)}


def test_density_has_unit_mass(spark):
    rows = spark.createDataFrame([("k", v / 7, 1.5) for v in range(7)], "key string, value double, w double")
    assert stats.density(stats.histogram(rows, 0.0, 1.0, 4), 0.0, 1.0, 4).agg(F.sum("density") * 0.25).first()[0] == pytest.approx(1)


@pytest.mark.parametrize("potential, values", [(P.HARMONIC, (2.0, 1.1)), (P.LJ126, (0.5, 1.2)), (P.LJ96, (0.5, 1.2)), (P.GAUSSIAN, (0.8, 1.2, 0.3)), (P.DOUBLE_GAUSSIAN, (1.0, 0.5, -0.4, 0.2)), (P.COSINE_SOFT, (2.0, 3.0)), (P.SOFT_LJ, (0.5, 1.2, 0.6))])
def test_derivatives_equal_finite_differences(spark, potential, values):
    one = spark.range(1)
    energy = lambda x, vs: potential.energy(F.lit(x), *[F.lit(v) for v in vs])
    h, x = 1e-5, 1.37
    columns = {"force": (potential.force(F.lit(x), *[F.lit(v) for v in values]), (energy(x - h, values) - energy(x + h, values)) / (2 * h))}
    gradient = potential.gradient(F.lit(x), *[F.lit(v) for v in values])
    for k, name in enumerate(potential.names):
        up, down = ([v + s * h * (i == k) for i, v in enumerate(values)] for s in (1, -1))
        columns[name] = (gradient[name], (energy(x, up) - energy(x, down)) / (2 * h))
    row = one.select(*[c.alias(f"{n}{i}") for n, pair in columns.items() for i, c in enumerate(pair)]).first()
    for n in columns:
        assert row[f"{n}0"] == pytest.approx(row[f"{n}1"], rel=1e-5, abs=1e-7)


@pytest.mark.parametrize("style", ["pair", "bond", "angle"])
def test_boundaries_are_continuous_and_forces_are_slopes(spark, style):
    h, places = 1e-6, [0.3, 0.7, 0.95, 1.0, 1.2, 1.6, 1.7, 2.4]
    at = lambda x: P.with_boundary(P.HARMONIC, x, style, 0.8, 1.65, k=F.lit(3.0), r0=F.lit(1.1))
    x = F.col("x")
    rows = spark.createDataFrame([(v,) for v in places], "x double").select("x", at(x)["force"].alias("f"), ((at(x - h)["energy"] - at(x + h)["energy"]) / (2 * h)).alias("slope"), at(x)["k"].alias("g")).collect()
    for r in rows:
        assert r.f == pytest.approx(r.slope, rel=1e-4, abs=1e-4)
        assert (r.g == 0) == (r.x < 0.8 or (style != "pair" and r.x > 1.65))
    for end in (0.8, 1.65):
        low, high = spark.range(1).select(at(F.lit(end - 1e-9))["energy"], at(F.lit(end + 1e-9))["energy"]).first()
        assert low == pytest.approx(high, abs=1e-6)


def test_harmonic_table_is_recovered(spark):
    rows = [("k", i, 0.5 + 0.1 * i, -2 * 3.0 * (0.5 + 0.1 * i - 1.23)) for i in range(16)]
    got = tables.harmonic_fit(spark.createDataFrame(rows, "key string, i int, x double, f double")).first()
    assert got.r0 == pytest.approx(1.23, abs=1e-6) and got.k == pytest.approx(3.0)


def test_lookup_extends_the_table(spark):
    grid = tables.integrated(spark.createDataFrame([("k", i, float(i), 2.0 - i) for i in range(4)], "key string, i int, x double, f double"))
    points = spark.createDataFrame([("k", 0.5), ("k", -1.0), ("k", 5.0)], "key string, x double")
    got = {r.x: r for r in tables.lookup(points, grid, 0.0, 1.0).collect()}
    assert (got[0.5].force, got[-1.0].force, got[5.0].force) == (1.5, 2.0, -1.0)
    assert got[5.0].energy == pytest.approx(2.0) and got[-1.0].energy == pytest.approx(1.5 + 0.5 - 0.5 + 2.0)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(101, 100), (100, 102), (7, 7), (None, 3), (200, 200)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_self_bond_is_an_error(spark):
    with pytest.raises(Exception, match="self bond"):
        topology.angles_from_bonds(spark.createDataFrame([(0, 1, 1), (0, 1, 2)], "frame_id long, i long, j long")).collect()


def test_entry_imports_without_a_session():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "A02" in e.queries()
