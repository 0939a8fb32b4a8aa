"""Coarse sites from atoms: positions, forces and velocities."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mesospark.functions.imaging import minimum_image, wrap


def adapter_map(atoms: DataFrame) -> DataFrame:
    """Two consecutive atoms of a molecule make a site: ``frame_id, atom_id, mol_id, site, wx, wf``."""
    return atoms.select("frame_id", "atom_id", "mol_id", F.floor((F.col("ord") - 1) / 2.0).cast("long").alias("site"), F.col("mass").alias("wx"), F.lit(1.0).alias("wf"))


def expanded(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """``frame_id, site, atom_id, w``: nested groups as one row for each site and atom.

    groups: ``frame_id, grp, anchor, repeats, step, sites``, the sites an array of structs
    ``anchor, index, w`` with arrays of atoms and weights; anchor, repeats and step are 0,
    1 and 0 where null. An atom is the group's anchor + repeat x step + site's anchor + index. Sites are
    numbered from 0 in a frame by group, repeat and place; an index that comes twice
    in a site adds up. sizes: ``frame_id, n``, the atoms of each frame; an atom not from 0
    to n - 1 is an error, as are index and weights of different lengths.
    """
    held = groups.withColumns({"anchor": F.coalesce("anchor", F.lit(0)), "repeats": F.coalesce("repeats", F.lit(1)), "step": F.coalesce("step", F.lit(0)), "each": F.size("sites")})
    earlier = W.partitionBy("frame_id").orderBy("grp").rowsBetween(W.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum(F.col("repeats") * F.col("each")).over(earlier), F.lit(0)).cast("long"))
    repeats = held.filter("repeats > 0").withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats").cast("long") - 1)))
    sites = repeats.select("frame_id", "before", "r", "each", (F.col("anchor") + F.col("r") * F.col("step")).alias("base"), F.posexplode("sites").alias("u", "s"))
    even = F.when(F.size("s.index") == F.size("s.w"), F.arrays_zip(F.col("s.index").alias("index"), F.col("s.w").alias("w"))).otherwise(F.raise_error(F.lit("a site has another number of weights than of atoms")))
    rows = sites.select("frame_id", (F.col("before") + F.col("r") * F.col("each") + F.col("u")).alias("site"), (F.col("base") + F.coalesce("s.anchor", F.lit(0))).alias("base"), F.explode(even).alias("k"))
    rows = rows.select("frame_id", "site", (F.col("base") + F.col("k.index")).cast("long").alias("atom_id"), F.col("k.w").alias("w")).join(sizes.select("frame_id", "n"), "frame_id", "left")
    inside = (F.col("atom_id") >= 0) & (F.col("atom_id") < F.coalesce("n", F.lit(0)))
    told = F.when(inside, F.col("atom_id")).otherwise(F.raise_error(F.concat(F.lit("no atom "), F.col("atom_id").cast("string"), F.lit(" in frame "), F.col("frame_id").cast("string"))).cast("long"))
    return rows.withColumn("atom_id", told).groupBy("frame_id", "site", "atom_id").agg(F.sum("w").alias("w"))


def made_whole(atoms: DataFrame, reference: str | int | DataFrame | None = "first") -> DataFrame:
    """Atoms with ``x, y, z`` at the image nearest to a reference atom of their molecule.

    ``reference``: "first" (the least ``ord`` of the molecule), a number (the atom with
    that ``ord``), a table of anchors ``mol_id, anchor`` (an ``ord`` for each molecule),
    "site" (the first atom of the atom's own ``site``) or None (places stay). A molecule
    without its reference atom is an error.
    """
    if reference is None:
        return atoms
    columns, keys = atoms.columns, ["frame_id", "mol_id"] + (["site"] if isinstance(reference, str) and reference == "site" else [])
    place = F.struct("x", "y", "z")
    if isinstance(reference, str):
        if reference not in ("first", "site"):
            raise ValueError(f"no reference named {reference}")
        found = F.min_by(place, "ord")
    elif isinstance(reference, int):
        found = F.max(F.when(F.col("ord") == reference, place))
    else:
        atoms = atoms.join(reference.select("mol_id", F.col("anchor").alias("_anchor")), "mol_id", "left")
        found = F.max(F.when(F.col("ord") == F.col("_anchor"), place))
    told = F.coalesce("_ref", F.raise_error(F.concat(F.lit("no reference atom in molecule "), F.col("mol_id").cast("string"))).cast("struct<x: double, y: double, z: double>"))
    met = atoms.join(atoms.groupBy(*keys).agg(found.alias("_ref")), keys).withColumn("_ref", told)
    return met.withColumns({a: F.col(f"_ref.{a}") + minimum_image(F.col(a) - F.col(f"_ref.{a}"), F.col(f"l{a}")) for a in "xyz"}).select(*columns)


def map_velocities(atoms: DataFrame, mapping: DataFrame) -> DataFrame:
    """``frame_id, mol_id, site, vx, vy, vz``: means of the atoms' velocities with the weights of the positions, not imaged; null where these add up to 0."""
    moving = atoms.select("frame_id", "mol_id", "atom_id", "vx", "vy", "vz")
    met = moving.join(mapping.select("frame_id", "atom_id", "site", "wx"), ["frame_id", "atom_id"])
    return met.groupBy("frame_id", "mol_id", "site").agg(*[(F.sum(F.col("wx") * F.col(f"v{a}")) / F.nullif(F.sum("wx"), F.lit(0.0))).alias(f"v{a}") for a in "xyz"])


def map_sites(atoms: DataFrame, mapping: DataFrame) -> DataFrame:
    """``frame_id, mol_id, site, x, y, z, fx, fy, fz, n``.

    Atoms are made whole about the first atom of their site, positions are
    means with normalised weights, wrapped into the cell; forces are raw
    weighted sums. The reference atom travels in the aggregate itself
    (min_by), so a frame is joined once and grouped twice on one partitioning.
    """
    keys = ["frame_id", "mol_id", "site"]
    joined = atoms.join(mapping.select("frame_id", "atom_id", "site", "wx", "wf"), ["frame_id", "atom_id"])
    first = joined.groupBy(*keys).agg(F.min_by(F.struct("x", "y", "z"), "atom_id").alias("ref"))
    whole = joined.join(first, keys)
    moved = {f"m{a}": F.col(f"ref.{a}") + minimum_image(F.col(a) - F.col(f"ref.{a}"), F.col(f"l{a}")) for a in "xyz"}
    out = whole.withColumns(moved).groupBy(*keys).agg(
        *[(F.sum(F.col("wx") * F.col(f"m{a}")) / F.nullif(F.sum("wx"), F.lit(0.0))).alias(a) for a in "xyz"],
        *[F.sum(F.col("wf") * F.col(f"f{a}")).alias(f"f{a}") for a in "xyz"],
        *[F.first(f"l{a}").alias(f"l{a}") for a in "xyz"], F.count("*").alias("n"),
    )
    return out.withColumns({a: wrap(F.col(a), F.col(f"l{a}")) for a in "xyz"}).drop("lx", "ly", "lz")
