"""G04, G05: components made whole where their frame is; links from block to block, odd links, shuffles and files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesospark.operators import topology
from mesospark.plans import trajectory_models
from mesospark.plans.trajectory import QUERIES

SMALL = "/root/testdata/sf0.001"


def _shuffles(df):
    """Shuffles by hash, before the adaptive planner coalesces any."""
    spark, key = df.sparkSession, "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.set(key, before)


def _links(spark, rows, places):
    """Links (frame, i, j) with the vectors between unwrapped places and those places in a cell of 10."""
    point = lambda p: tuple(None if x is None else float(x) for x in p)
    less = lambda p, q: tuple(None if None in (x, y) else float(x - y) for x, y in zip(p, q, strict=True))
    inside = {k: tuple(None if x is None else x % 10.0 for x in p) for k, p in places.items()}
    data = [(f, i, j, less(places[j], places[i]), point(inside[i]), point(inside[j])) for f, i, j in rows]
    v = "struct<x: double, y: double, z: double>"
    return spark.createDataFrame(data, f"frame_id long, i long, j long, v {v}, at_i {v}, at_j {v}")


def test_g04_deals_atoms_once_and_writes_nothing(spark, monkeypatch):
    """Each pass of two iterations was dealt and written: 955 MB for each sf0.1."""

    def refused(df):
        raise AssertionError("cut")

    monkeypatch.setattr(topology, "cut", refused)
    monkeypatch.setattr(trajectory_models, "cut", refused)
    found = QUERIES["G04"](spark, SMALL)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString() and _shuffles(found) == 1


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_graphs_of_several_blocks_are_made_whole(spark, monkeypatch, bits):
    monkeypatch.setattr(topology, "BLOCK_BITS", bits)
    rng = np.random.RandomState(bits)
    ids = rng.permutation(60) - 20  # negative ids too
    places = {int(k): rng.uniform(-30, 30, 3) for k in ids}
    chain = [(int(ids[k]), int(ids[k + 1])) for k in range(59) if k % 20 != 19]  # three chains
    more = [(i, j) if rng.rand() < 0.5 else (j, i) for i, j in chain[:30]] + [(i, i) for i, _ in chain[:5]]
    rows = [(f, i, j) for f in (0, 1) for i, j in chain + more]
    got = {(r.frame_id, r.atom_id): (r.component, (r.x, r.y, r.z)) for r in topology.made_whole(_links(spark, rows, places)).collect()}
    assert len(got) == 120
    for f in (0, 1):
        for part in (ids[:20], ids[20:40], ids[40:]):
            least = int(min(part))
            start = np.mod(places[least], 10.0)
            for k in map(int, part):
                assert got[f, k][0] == least and np.allclose(got[f, k][1], start + places[k] - places[least], atol=1e-9)
    bonds = spark.createDataFrame(rows, "frame_id long, i long, j long")
    assert {(r.frame_id, r.atom_id): r.component for r in topology.bonded_components(bonds).collect()} == {k: c for k, (c, _) in got.items()}


@pytest.mark.parametrize("bits", [1, 16])
def test_odd_links(spark, monkeypatch, bits):
    """Null frames and ids and self links add nothing; beyond an unknown place there was a number as if it were 0."""
    monkeypatch.setattr(topology, "BLOCK_BITS", bits)
    places = {1: (9.0, 1.0, 1.0), 2: (11.0, 1.0, 1.0), 3: (None, None, None), 4: (13.0, 2.0, 1.0), 5: (14.0, 2.0, 1.0), 8: (1.0, 1.0, 1.0), 9: (2.0, 1.0, 1.0), None: (0.0, 0.0, 0.0)}
    rows = [(0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 5), (None, 8, 9), (0, 8, None), (0, None, None), (0, 9, 9)]
    got = {(r.frame_id, r.atom_id): (r.component, r.x) for r in topology.made_whole(_links(spark, rows, places)).collect()}
    assert got == {(0, 1): (1, 9.0), (0, 2): (1, 11.0), (0, 3): (1, None), (0, 4): (1, None), (0, 5): (1, None)}
    known = topology.made_whole(_links(spark, rows, places | {3: (12.0, 1.0, 1.0)}).union(_links(spark, [(0, 2, 3)], places)))
    assert {r.atom_id: r.x for r in known.collect()} == {1: 9.0, 2: 11.0, 3: 12.0, 4: 13.0, 5: 14.0}
    assert topology.made_whole(_links(spark, rows, places).limit(0)).count() == 0


def test_unwrapped_keeps_given_components_and_atoms_without_bonds(spark):
    atoms = spark.createDataFrame([(0, k, x, 1.0, 1.0, 10.0, 10.0, 10.0) for k, x in ((1, 9.5), (2, 0.5), (3, 4.0))], "frame_id long, atom_id long, x double, y double, z double, lx double, ly double, lz double")
    bonds = spark.createDataFrame([(0, 1, 2), (0, 2, 7)], "frame_id long, i long, j long")
    got = topology.unwrapped(atoms, bonds, atoms.select("frame_id", "atom_id", F.lit(7).alias("component")))
    assert {r.atom_id: (r.component, r.x) for r in got.collect()} == {1: (7, 9.5), 2: (7, 10.5), 3: (7, 4.0)}


def test_g05_writes_once_and_takes_places_from_its_rows(spark, monkeypatch):
    """The atoms were written, dealt and joined again for where they stood."""
    written = []
    cut = trajectory_models.cut
    for module in (topology, trajectory_models):
        monkeypatch.setattr(module, "cut", lambda df: (written.append(df.columns), cut(df))[1])
    QUERIES["G05"](spark, SMALL)
    assert written == [["frame_id", "atom_id", "component", "z", "at"]]


@pytest.mark.parametrize("bits", [1, 16])
def test_atoms_keep_where_they_stood(spark, monkeypatch, bits):
    monkeypatch.setattr(topology, "BLOCK_BITS", bits)
    places = {k: (1.0, 2.0, 7.5 + k) for k in range(1, 7)}
    whole = topology.made_whole(_links(spark, [(0, k, k + 1) for k in range(1, 6)], places)).localCheckpoint()
    assert {r.atom_id: (r.z, r.at.z) for r in whole.collect()} == {k: (7.5 + k, (7.5 + k) % 10) for k in places}
    atoms = whole.select("frame_id", "atom_id", F.col("at.z").alias("z"))
    rows = [sorted(topology.refitted_z(whole, given, 2.0, 12.0).collect()) for given in (None, atoms)]
    assert rows[0] == rows[1] and len(rows[0]) == 6
