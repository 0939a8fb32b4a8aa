"""Bonded terms by residue templates and by labels, and seeding of added sites at an angle to an axis."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mesospark.functions.keys import STYLES, canonical_key
from mesospark.operators.topology import angles_through

TERM = ["frame_id", "style", "origin", "a1", "a2", "a3", "a4"]


def _or_error(value: Column, *message: Column) -> Column:
    return F.when(value.isNull(), F.raise_error(F.concat(*message))).otherwise(value)


def _in_order(rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """One row a term of the rows ``at`` (its position, from 0) and the columns: ``<column>1`` to ``<column>4``; a term has at most four."""
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("at") == k, F.col(c))).alias(f"{c}{k + 1}") for c in columns for k in range(4)])


def _least_direction(terms: DataFrame) -> DataFrame:
    """Terms with the lesser of their ends first, each once."""
    last = F.element_at(F.array("a1", "a2", "a3", "a4"), F.when(F.col("style") == "bond", 2).when(F.col("style") == "angle", 3).otherwise(4))
    turn = F.col("a1") > last
    second, third = F.col("a2"), F.col("a3")
    bond, angle = F.col("style") == "bond", F.col("style") == "angle"
    return terms.select(
        "frame_id", "style", "origin", F.when(turn, last).otherwise(F.col("a1")).alias("a1"),
        F.when(turn & bond, F.col("a1")).when(turn & ~angle, third).otherwise(second).alias("a2"),
        F.when(turn & angle, F.col("a1")).when(turn & ~bond, second).otherwise(third).alias("a3"),
        F.when(turn & (F.col("style") == "dihedral"), F.col("a1")).otherwise(F.col("a4")).alias("a4"),
    )


def unit_sites(residues: DataFrame) -> DataFrame:
    """``frame_id, molecule, nth, site, unit, atom_id``: every site by the number of its residue in the molecule and its own there, and by its number in the molecule; all from 1."""
    by = W.partitionBy("frame_id", "molecule").orderBy("residue")
    placed = residues.withColumns({"nth": F.row_number().over(by).cast("long"), "before": F.coalesce(F.sum("size").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")})
    each = placed.filter("size > 0").withColumn("site", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size").cast("long"))))
    return each.select("frame_id", "molecule", "nth", "site", (F.col("before") + F.col("site")).alias("unit"), (F.col("first") + F.col("site")).alias("atom_id"))


def template_terms(residues: DataFrame, templates: DataFrame, linkers: DataFrame | None = None, extra: DataFrame | None = None, *, link_angles: bool = False) -> DataFrame:
    """``frame_id, style, origin, a1, a2, a3, a4``: bonds, angles and dihedrals of all molecules, the lesser end first.

    residues: ``frame_id, molecule, kind, residue, name, size, first`` (the atom before
    its first one), in order of ``residue`` within a molecule. templates: ``name,
    style, sites`` (numbers from 1 in the residue). linkers: ``name, left, right``: the
    right site of a residue is bound to the left site of the next one of its molecule;
    a name without linkers is not linkable, and a linkable residue beside one that is
    not is an error. ``link_angles`` adds the angles with a link among their bonds.
    extra: ``kind, style, parts``, an array of structs ``nth, site`` for every molecule of
    a kind; where ``nth`` is null the site is numbered within the molecule (so a whole
    molecule's template is such terms alone). A site that is not there is an error.
    Empty tables give no terms; terms that come twice are kept once, the template's first.
    """
    inside = residues.join(F.broadcast(templates), "name")  # a join dealt by a few names has as many tasks; what stands for a name is small
    held = F.transform("sites", lambda s: F.when((s < 1) | (s > F.col("size")), F.raise_error(F.concat(F.lit("no such site in residue "), F.col("name").cast("string")))).otherwise(F.col("first") + s))
    made = inside.withColumn("s", held).select("frame_id", "style", F.lit("template").alias("origin"), *[F.get("s", F.lit(k)).alias(f"a{k + 1}") for k in range(4)])
    if linkers is not None:
        by = W.partitionBy("frame_id", "molecule").orderBy("residue")
        known = residues.join(F.broadcast(linkers.select("name", "left", "right")), "name", "left")
        ends = known.select("frame_id", "molecule", (F.col("first") + F.col("right")).alias("i"), F.lead(F.col("first") + F.col("left")).over(by).alias("j"), F.lead("first").over(by).isNotNull().alias("followed"))
        mixed = F.col("followed") & (F.col("i").isNull() != F.col("j").isNull())
        told = F.when(mixed, F.raise_error(F.concat(F.lit("of two residues of molecule "), F.col("molecule").cast("string"), F.lit(" only one is linkable")))).when(F.col("followed") & F.col("i").isNotNull(), F.struct("i", "j"))
        none = F.lit(None).cast("long")
        links = ends.withColumn("link", told).filter("link IS NOT NULL").select("frame_id", F.lit("bond").alias("style"), F.lit("link").alias("origin"), F.col("link.i").alias("a1"), F.col("link.j").alias("a2"), none.alias("a3"), none.alias("a4"))
        if link_angles:
            bonds = made.filter("style = 'bond'").union(links).select("frame_id", F.col("a1").alias("i"), F.col("a2").alias("j"))
            angles = angles_through(bonds, links.select("frame_id", F.col("a1").alias("i"), F.col("a2").alias("j")))
            links = links.union(angles.select("frame_id", F.lit("angle"), F.lit("link"), "i", "j", "k", none))
        made = made.union(links)
    if extra is not None:
        numbered = extra.withColumn("term", F.monotonically_increasing_id())
        wanted = residues.select("frame_id", "molecule", "kind").distinct().join(F.broadcast(numbered), "kind").select("frame_id", "molecule", "term", "style", F.posexplode("parts").alias("at", "p")).select("*", "p.nth", "p.site").drop("p")
        sites = unit_sites(residues)
        keys = ["frame_id", "molecule"]
        direct = wanted.filter("nth IS NOT NULL").join(sites.drop("unit"), [*keys, "nth", "site"], "left").select(*keys, "term", "style", "at", "site", "atom_id")
        counted = wanted.filter("nth IS NULL").drop("nth").join(sites.select(*keys, F.col("unit").alias("site"), "atom_id"), [*keys, "site"], "left").select(*keys, "term", "style", "at", "site", "atom_id")
        there = _or_error(F.col("atom_id"), F.lit("no site "), F.col("site").cast("string"), F.lit(" in molecule "), F.col("molecule").cast("string"))
        met = _in_order(direct.union(counted).withColumn("a", there), [*keys, "term", "style"], "a")
        made = made.union(met.select("frame_id", "style", F.lit("extra"), "a1", "a2", "a3", "a4"))
    rank = F.max("origin")  # template, link, extra: the last in the alphabet comes first
    return _least_direction(made).groupBy("frame_id", "style", "a1", "a2", "a3", "a4").agg(rank.alias("origin")).select(*TERM)


def labelled_terms(residues: DataFrame, specs: DataFrame, labels: DataFrame, added: DataFrame) -> DataFrame:
    """``frame_id, residue, style, a1, a2, a3, a4, key, type_id``: terms of added sites, resolved by label in each carrier residue.

    residues: ``frame_id, residue, name``; specs: ``name, style, labels``, for each
    carrier residue the labels of a term, at least one of them an added site's; labels:
    ``frame_id, residue, label, atom_id, type`` of the source's atoms; added: ``frame_id,
    residue, site_name, atom_id``, whose type is the site's name. Type ids number
    the keys of a style from 1. A label that a residue lacks, a wrong number of labels, and a
    source that has a label of an added site's name already are errors.
    """
    names = added.select(F.col("site_name").alias("label")).distinct().withColumn("taken", F.lit(True))
    free = F.when(F.col("taken"), F.raise_error(F.concat(F.lit("the source has an atom labelled "), F.col("label")))).otherwise(F.col("label"))
    source = labels.join(F.broadcast(names), "label", "left").select("frame_id", "residue", free.alias("label"), "atom_id", "type")
    every = source.union(added.select("frame_id", "residue", "site_name", "atom_id", "site_name"))
    count = F.when(F.col("style") == "bond", 2).when(F.col("style") == "angle", 3).when(F.col("style") == "dihedral", 4)
    right = F.when(F.size("labels") == count, F.col("labels")).otherwise(F.raise_error(F.concat(F.lit("wrong number of labels in a term of style "), F.col("style"))))
    wanted = residues.join(F.broadcast(specs.withColumn("term", F.monotonically_increasing_id())), "name").select("frame_id", "residue", "term", "style", F.posexplode(right).alias("at", "label"))
    met = wanted.join(every, ["frame_id", "residue", "label"], "left")
    there = _or_error(F.col("atom_id"), F.lit("no atom is labelled "), F.col("label"))
    terms = _in_order(met.withColumn("a", there).withColumn("t", F.col("type")), ["frame_id", "residue", "term", "style"], "a", "t")
    key = F.coalesce(*[F.when(F.col("style") == s, canonical_key(s, *[F.col(f"t{k + 1}") for k in range(n)])) for s, n in STYLES.items() if s != "pair"])
    keyed = terms.withColumn("key", key)
    ids = keyed.select("style", "key").distinct().withColumn("type_id", F.dense_rank().over(W.partitionBy("style").orderBy("key")))
    return keyed.join(F.broadcast(ids), ["style", "key"]).select("frame_id", "residue", "style", "a1", "a2", "a3", "a4", "key", "type_id")


def _hashed(seed: int, what: str, *ids: Column) -> Column:
    """A number in [0, 1) from MD5 of seed, purpose and ids."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(what), *[i.cast("string") for i in ids]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def _scaled(v: list[Column], least: float = 1e-12) -> list[Column]:
    """The vector with length 1; null where it has none."""
    size = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return [x / F.when(size > least, size) for x in v]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def axis_seeded_sites(atoms: DataFrame, distance: float, angle: float, seed: int, *, anchor: int = 1, reference: int = 2) -> DataFrame:
    """``frame_id, mol_id, vx, vy, vz``: a site for each molecule that has its anchor, at the angle (degrees) between reference, anchor and site.

    Anchor and reference are atoms by ``ord``. The azimuth about the axis is uniform, from
    MD5 of seed, frame and molecule, so it is the same on any partitioning. Without a
    reference, or with one on the anchor, the site lies away from the molecule's centre;
    where that is the anchor too, in a direction uniform on the sphere.
    """
    at = lambda k, name: [F.max(F.when(F.col("ord") == k, F.col(f"u{x}"))).alias(f"{name}{x}") for x in "xyz"]
    m = atoms.groupBy("frame_id", "mol_id").agg(*at(anchor, "a"), *at(reference, "b"), *[F.avg(f"u{x}").alias(f"c{x}") for x in "xyz"]).filter("ax IS NOT NULL")
    turn, lift = (_hashed(seed, what, F.col("frame_id"), F.col("mol_id")) for what in ("azimuth", "height"))
    m = m.withColumns({"turn": turn * 2 * F.pi(), "lift": lift * 2 - 1})
    names = lambda p: [F.col(p + x) for x in "xyz"]
    m = m.withColumns({f"e{x}": e for x, e in zip("xyz", _scaled([F.col(f"b{x}") - F.col(f"a{x}") for x in "xyz"]), strict=True)})
    steep = F.abs(F.col("ez")) > 0.9
    probe = [F.lit(0.0), F.when(steep, 1.0).otherwise(0.0), F.when(steep, 0.0).otherwise(1.0)]
    m = m.withColumns({f"p{x}": p for x, p in zip("xyz", _scaled(_cross(names("e"), probe)), strict=True)})
    m = m.withColumns({f"q{x}": q for x, q in zip("xyz", _cross(names("e"), names("p")), strict=True)})
    m = m.withColumns({f"o{x}": o for x, o in zip("xyz", _scaled([F.col(f"a{x}") - F.col(f"c{x}") for x in "xyz"]), strict=True)})
    flat = F.sqrt(1 - F.col("lift") * F.col("lift"))
    sphere = [flat * F.cos("turn"), flat * F.sin("turn"), F.col("lift")]
    cos, sin = F.cos(F.radians(F.lit(float(angle)))), F.sin(F.radians(F.lit(float(angle))))
    leaning = [cos * e + sin * (F.cos("turn") * p + F.sin("turn") * q) for e, p, q in zip(names("e"), names("p"), names("q"), strict=True)]
    way = [F.coalesce(a, o, s) for a, o, s in zip(leaning, names("o"), sphere, strict=True)]
    return m.select("frame_id", "mol_id", *[(F.col(f"a{x}") + distance * v).alias(f"v{x}") for x, v in zip("xyz", way, strict=True)])
