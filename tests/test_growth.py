"""Terms by template and label, links, additional terms, sites at an angle to an axis."""

import numpy as np
import pytest

from mesospark.operators import growth

RESIDUES = "frame_id long, molecule long, kind string, residue long, name string, size long, first long"
TEMPLATES = "name string, style string, sites array<long>"
LINKERS = "name string, left long, right long"
EXTRA = "kind string, style string, parts array<struct<nth: long, site: long>>"


def _residues(spark, *molecules):
    """Molecules (kind, [(name, size), ...]) one after the other in two frames."""
    rows = []
    for frame in (0, 1):
        first, residue = 9, 0
        for m, (kind, held) in enumerate(molecules):
            for name, size in held:
                rows.append((frame, m, kind, residue, name, size, first))
                first, residue = first + size, residue + 1
    return spark.createDataFrame(rows, RESIDUES)


def _terms(df, frame=0):
    return sorted((r.style, r.origin, tuple(a for a in (r.a1, r.a2, r.a3, r.a4) if a is not None)) for r in df.collect() if r.frame_id == frame)


def test_templates_links_and_additional_terms(spark):
    residues = _residues(spark, ("x", [("A", 3), ("B", 2)]), ("x", [("A", 3), ("B", 2)]), ("y", [("A", 3)]))
    templates = spark.createDataFrame([("A", "bond", [1, 2]), ("A", "bond", [3, 2]), ("A", "angle", [3, 2, 1]), ("B", "bond", [2, 1]), ("unused", "bond", [7, 8])], TEMPLATES)
    linkers = spark.createDataFrame([("A", 1, 3), ("B", 1, 2)], LINKERS)
    extra = spark.createDataFrame([("x", "dihedral", [(2, 1), (1, 3), (1, 2), (1, 1)]), ("x", "bond", [(None, 5), (None, 1)]), ("x", "bond", [(1, 2), (1, 1)])], EXTRA)
    got = growth.template_terms(residues, templates, linkers, extra, link_angles=True)
    molecule = [
        ("angle", "template", (0, 1, 2)), ("bond", "template", (0, 1)), ("bond", "template", (1, 2)), ("bond", "template", (3, 4)), ("bond", "link", (2, 3)),
        ("angle", "link", (1, 2, 3)), ("angle", "link", (2, 3, 4)), ("dihedral", "extra", (0, 1, 2, 3)), ("bond", "extra", (0, 4)),
    ]
    alone = [("angle", "template", (0, 1, 2)), ("bond", "template", (0, 1)), ("bond", "template", (1, 2))]
    want = sorted((s, o, tuple(a + base for a in t)) for base, terms in ((10, molecule), (15, molecule), (20, alone)) for s, o, t in terms)
    assert _terms(got) == want == _terms(got, 1)


def test_a_molecule_form_template_is_terms_by_unit_index(spark):
    residues = _residues(spark, ("lipid", [("H", 1), ("T", 3)]), ("lipid", [("H", 1), ("T", 3)]))
    none = spark.createDataFrame([], TEMPLATES)
    extra = spark.createDataFrame([("lipid", "bond", [(None, k), (None, k + 1)]) for k in (1, 2, 3)], EXTRA)
    assert [t for *_, t in _terms(growth.template_terms(residues, none, extra=extra))] == [(10, 11), (11, 12), (12, 13), (14, 15), (15, 16), (16, 17)]
    assert _terms(growth.template_terms(residues, none)) == []


@pytest.mark.parametrize("names, fails", [((("A", 2), ("B", 2)), True), ((("B", 2), ("A", 2)), True), ((("B", 2), ("B", 2)), False), ((("A", 2), ("A", 2)), False)])
def test_mixed_linkability_is_an_error(spark, names, fails):
    residues, linkers = _residues(spark, ("x", list(names)), ("x", [("B", 2)])), spark.createDataFrame([("A", 1, 2)], LINKERS)
    found = growth.template_terms(residues, spark.createDataFrame([], TEMPLATES), linkers)
    if fails:
        with pytest.raises(Exception, match="only one is linkable"):
            found.collect()
    else:
        assert len(_terms(found)) == (names[0][0] == "A")


def test_sites_that_are_not_there_are_errors(spark):
    residues, none = _residues(spark, ("x", [("A", 2)])), spark.createDataFrame([], TEMPLATES)
    with pytest.raises(Exception, match="no such site in residue A"):
        growth.template_terms(residues, spark.createDataFrame([("A", "bond", [1, 3])], TEMPLATES)).collect()
    for part in ((2, 1), (1, 3), (None, 3)):
        with pytest.raises(Exception, match="in molecule 0"):
            growth.template_terms(residues, none, extra=spark.createDataFrame([("x", "bond", [(1, 1), part])], EXTRA)).collect()


def _grown(spark, specs, source_label="c"):
    residues = spark.createDataFrame([(f, r, "A" if r % 2 else "B") for f in (0, 1) for r in (1, 2, 3)], "frame_id long, residue long, name string")
    labels = spark.createDataFrame([(f, r, label, 10 * r + k, label.upper()) for f in (0, 1) for r in (1, 2, 3) for k, label in enumerate(["a", "b", source_label])], "frame_id long, residue long, label string, atom_id long, type string")
    added = spark.createDataFrame([(f, r, s, 100 + 10 * r + k) for f in (0, 1) for r in (1, 3) for k, s in enumerate(["V", "W"])], "frame_id long, residue long, site_name string, atom_id long")
    return growth.labelled_terms(residues, spark.createDataFrame(specs, "name string, style string, labels array<string>"), labels, added)


def test_terms_of_added_sites_by_label(spark):
    got = _grown(spark, [("A", "bond", ["V", "a"]), ("A", "bond", ["V", "W"]), ("A", "angle", ["b", "a", "V"]), ("A", "dihedral", ["W", "V", "a", "c"])])
    rows = {(r.frame_id, r.residue, r.style, tuple(a for a in (r.a1, r.a2, r.a3, r.a4) if a is not None), r.key, r.type_id) for r in got.collect()}
    assert rows == {
        row
        for f in (0, 1)
        for r in (1, 3)
        for row in (
            (f, r, "bond", (100 + 10 * r, 10 * r), "bond:A:V", 1),
            (f, r, "bond", (100 + 10 * r, 101 + 10 * r), "bond:V:W", 2),
            (f, r, "angle", (10 * r + 1, 10 * r, 100 + 10 * r), "angle:B:A:V", 1),
            (f, r, "dihedral", (101 + 10 * r, 100 + 10 * r, 10 * r, 10 * r + 2), "dihedral:C:A:V:W", 1),
        )
    }


@pytest.mark.parametrize("specs, label, what", [([("A", "bond", ["V", "z"])], "c", "no atom is labelled z"), ([("B", "bond", ["V", "a"])], "c", "no atom is labelled V"), ([("A", "angle", ["V", "a"])], "c", "wrong number"), ([("A", "bond", ["V", "W"])], "W", "the source has an atom labelled W")])
def test_labels_that_cannot_be_met_are_errors(spark, specs, label, what):
    with pytest.raises(Exception, match=what):
        _grown(spark, specs, label).collect()


def test_sites_at_an_angle_to_an_axis(spark):
    rng = np.random.RandomState(2)
    places = rng.randn(400, 3, 3)
    places[0, 1] = places[0, 0] + [0, 0, 2.0]  # along z
    rows = [(m % 7, m, k + 1, *map(float, places[m, k])) for m in range(400) for k in range(3)]
    atoms = spark.createDataFrame(rows, "frame_id long, mol_id long, ord long, ux double, uy double, uz double")
    read = lambda df: {r.mol_id: np.array([r.vx, r.vy, r.vz]) for r in df.collect()}
    got = read(growth.axis_seeded_sites(atoms, 0.7, 75.0, 5))
    assert len(got) == 400
    azimuth = []
    for m, site in got.items():
        step, axis = site - places[m, 0], places[m, 1] - places[m, 0]
        axis = axis / np.linalg.norm(axis)
        assert np.linalg.norm(step) == pytest.approx(0.7) and np.degrees(np.arccos(step @ axis / 0.7)) == pytest.approx(75.0)
        probe = np.array([0, 1.0, 0]) if abs(axis[2]) > 0.9 else np.array([0, 0, 1.0])
        p = np.cross(axis, probe) / np.linalg.norm(np.cross(axis, probe))
        azimuth.append(np.arctan2(step @ np.cross(axis, p), step @ p))
    assert np.histogram(azimuth, 4, (-np.pi, np.pi))[0].min() > 70  # 100 expected in each quarter
    again = read(growth.axis_seeded_sites(atoms.repartition(7), 0.7, 75.0, 5))
    assert all((got[m] == again[m]).all() or np.allclose(got[m], again[m], atol=1e-12) for m in got)
    other = read(growth.axis_seeded_sites(atoms, 0.7, 75.0, 6))
    assert not np.allclose(got[3], other[3])


def test_sites_without_an_axis(spark):
    rows = [(0, 1, 1, 0.0, 0.0, 0.0), (0, 1, 3, -2.0, 0.0, 0.0), (0, 2, 1, 1.0, 1.0, 1.0), (0, 3, 2, 0.0, 0.0, 0.0), (0, 4, 1, 1.0, 0.0, 0.0), (0, 4, 2, 1.0, 0.0, 0.0), (0, 4, 3, 1.0, 3.0, 0.0)]
    atoms = spark.createDataFrame(rows, "frame_id long, mol_id long, ord long, ux double, uy double, uz double")
    got = {r.mol_id: (r.vx, r.vy, r.vz) for r in growth.axis_seeded_sites(atoms, 0.5, 90.0, 1).collect()}
    assert sorted(got) == [1, 2, 4]  # the third has no anchor
    assert got[1] == pytest.approx((0.5, 0.0, 0.0)) and got[4] == pytest.approx((1.0, -0.5, 0.0))
    assert np.linalg.norm(np.array(got[2]) - 1.0) == pytest.approx(0.5)
