"""References of whole molecules, mapped velocities, manifests, limits and slopes of users' parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesospark.functions.potentials import Potential
from mesospark.operators import extensions, mapping, tables
from mesospark.sources import frame_files

ATOM = "frame_id long, mol_id long, atom_id long, ord long, site long, x double, y double, z double, lx double, ly double, lz double"


def _molecule(spark):
    rows = [(0, 7, 1, 1, 0, 9.8, 5.0, 0.1), (0, 7, 2, 2, 0, 0.3, 5.2, 9.9), (0, 7, 3, 3, 1, 1.0, 4.9, 9.5), (0, 7, 4, 4, 1, 4.9, 5.0, 5.0)]
    return spark.createDataFrame([(*r, 10.0, 10.0, 10.0) for r in rows], ATOM)


def test_molecules_are_made_whole_about_each_reference(spark):
    atoms = _molecule(spark)
    x = lambda reference: [r.x for r in mapping.made_whole(atoms, reference).orderBy("atom_id").collect()]
    assert x("first") == pytest.approx([9.8, 10.3, 11.0, 14.9 - 10.0])  # the last is nearer as it stands
    assert x(3) == pytest.approx([-0.2, 0.3, 1.0, 4.9])
    anchors = spark.createDataFrame([(7, 2)], "mol_id long, anchor long")
    assert x(anchors) == pytest.approx([-0.2, 0.3, 1.0, 4.9]) and mapping.made_whole(atoms, anchors).columns == atoms.columns
    assert x("site") == pytest.approx([9.8, 10.3, 1.0, 4.9]) and x(None) == [9.8, 0.3, 1.0, 4.9]
    for missing in (9, spark.createDataFrame([(8, 1)], "mol_id long, anchor long")):
        with pytest.raises(Exception, match="no reference atom in molecule 7"):
            mapping.made_whole(atoms, missing).collect()
    with pytest.raises(ValueError, match="no reference named"):
        mapping.made_whole(atoms, "middle")


def test_velocities_are_weighted_means_and_not_imaged(spark):
    atoms = _molecule(spark).withColumns({"vx": F.col("x") * 2, "vy": F.lit(1.0), "vz": -F.col("z")})
    weights = spark.createDataFrame([(0, 1, 0, 1.0), (0, 2, 0, 3.0), (0, 3, 1, 0.0), (0, 4, 1, 0.0)], "frame_id long, atom_id long, site long, wx double")
    got = {r.site: (r.vx, r.vy, r.vz) for r in mapping.map_velocities(atoms, weights).collect()}
    assert got[0] == pytest.approx((2 * (9.8 + 3 * 0.3) / 4, 1.0, -(0.1 + 3 * 9.9) / 4)) and got[1] == (None, None, None)


def test_manifest_of_tables_on_a_grid(spark):
    x = np.array([1.0, 1.1, 1.35, 1.6, 2.0])
    rows = [(key, i, float(a), float(-2 * (a - 1.4))) for key in ("bond:A:A", "pair:A:A") for i, a in enumerate(x)]
    table = tables.integrated(spark.createDataFrame(rows, "key string, i int, x double, f double"))
    grid = tables.on_grid(table, 21)
    got = {r.key: r for r in tables.manifest(grid).collect()}
    b = got["bond:A:A"]
    assert (b.lo, b.hi, b.n) == (1.0, 2.0, 21) and b.eq == pytest.approx(1.4) and b.slope_lo == pytest.approx(-2) and b.slope_hi == pytest.approx(-2)
    assert got["pair:A:A"].slope_lo is None and got["pair:A:A"].eq == pytest.approx(1.4)
    f = [r.f for r in grid.filter("key = 'bond:A:A'").orderBy("i").collect()]
    assert f == pytest.approx(-2 * (np.linspace(1, 2, 21) - 1.4))
    assert tables.manifest(grid.filter("key = 'none'")).count() == 0


def test_limits_of_a_potential():
    morse = extensions.POTENTIALS["morse"]
    assert morse.clamped(d=-1.0, a=9.0, r0=1.0) == {"d": 0.0, "a": 3.0, "r0": 1.0}
    with pytest.raises(ValueError, match="no parameters named"):
        morse.clamped(q=1.0)
    plain = Potential(("k",), lambda x, k: k * x, lambda x, k: -k, lambda x, k: {"k": x})
    assert plain.clamped(k=1e9) == {"k": 1e9} and plain.frozen == ()


def test_slopes_of_a_basis_are_differences(spark):
    held = extensions.BASES["chebyshev"]
    x = np.linspace(0.05, 1.95, 15)
    assert held.derivative(x, 6) == pytest.approx((held.evaluate(x + 1e-6, 6) - held.evaluate(x - 1e-6, 6)) / 2e-6, abs=1e-5)
    assert held.derivative(np.array([0.0, 2.0, 3.0]), 4) == pytest.approx(np.array([[0, 1, -4, 9], [0, 1, 4, 9], [0, 0, 0, 0]]))
    extensions.BASES.add("powers of the test", lambda x, n: x[:, None] ** np.arange(n))
    row = spark.createDataFrame([(2.0,)], "x double")
    assert row.select(extensions.basis_values(F.col("x"), "powers of the test", 3).alias("b")).first().b == [1.0, 2.0, 4.0]
    with pytest.raises(ValueError, match="no derivative"):
        extensions.basis_values(F.col("x"), "powers of the test", 3, derivative=True)


GROUP = "frame_id long, grp long, anchor long, repeats long, step long, sites array<struct<anchor: long, index: array<long>, w: array<double>>>"


def test_nested_groups_expand_in_order(spark):
    sites = [(1, [0, 2, 0], [0.5, 0.25, 0.25]), (None, [3], [1.0])]
    groups = spark.createDataFrame([(0, 5, 10, 2, 4, sites), (0, 1, None, None, None, [(0, [7], [2.0])]), (1, 1, 0, 0, 3, sites), (1, 2, 0, 1, 0, [(0, [1], [1.0])])], GROUP)
    sizes = spark.createDataFrame([(0, 19), (1, 2)], "frame_id long, n long")
    got = sorted(tuple(r) for r in mapping.expanded(groups, sizes).collect())
    assert got == [(0, 0, 7, 2.0), (0, 1, 11, 0.75), (0, 1, 13, 0.25), (0, 2, 13, 1.0), (0, 3, 15, 0.75), (0, 3, 17, 0.25), (0, 4, 17, 1.0), (1, 0, 1, 1.0)]
    with pytest.raises(Exception, match="no atom 17 in frame 0"):
        mapping.expanded(groups, sizes.replace(19, 17)).collect()
    with pytest.raises(Exception, match="another number of weights"):
        mapping.expanded(spark.createDataFrame([(0, 1, 0, 1, 0, [(0, [1, 2], [1.0])])], GROUP), sizes).collect()
    assert mapping.expanded(groups.limit(0), sizes).count() == 0


def _names(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_files_pair_by_frame(spark, tmp_path):
    for n in ("frame_3.data", "frame_12.data", "notes.txt"):
        (tmp_path / n).write_text("x")
    data = frame_files.listed(spark, str(tmp_path))
    assert sorted(r.name for r in data.collect()) == ["frame_12.data", "frame_3.data", "notes.txt"]
    got = {tuple(r) for r in frame_files.paired(data, _names(spark, "f12_12.txt", "force.3.dat")).collect()}
    assert got == {(3, "frame_3.data", "force.3.dat"), (12, "frame_12.data", "f12_12.txt")}


@pytest.mark.parametrize("force, what", [(["a3"], "no force file of frame 12"), (["a3", "a12", "a4"], "no data file of frame 4"), (["a3", "a12", "b12"], "several files of frame 12"), (["a3", "a12_4"], "no single number in a12_4"), (["a3", "abc"], "no single number in abc")])
def test_files_that_do_not_pair_are_errors(spark, force, what):
    with pytest.raises(Exception, match=what):
        frame_files.paired(_names(spark, "frame_3.data", "frame_12.data"), _names(spark, *force)).collect()
