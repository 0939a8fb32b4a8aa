"""Graph-shaped joins over bonds, topologies from templates, added sites, and making components whole."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mesospark.functions.imaging import minimum_image
from mesospark.plans.lineage import cut


def residue_topology(residues: DataFrame, templates: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``frame_id, i, j, origin``: bonds of each residue's template, and links from residue to residue, with i < j.

    residues: ``frame_id, residue, name, first`` (the atom before its first one),
    in order of ``residue``. templates: ``name, i, j`` with sites from 1; only those
    that a residue names are used. links: ``name, site, next_site``: what binds a
    residue to the next one of its frame.
    """
    inner = residues.join(F.broadcast(templates), "name").select("frame_id", (F.col("first") + F.col("i")).alias("i"), (F.col("first") + F.col("j")).alias("j"), F.lit("template").alias("origin"))
    if links is not None:
        following = residues.withColumn("next", F.lead("first").over(W.partitionBy("frame_id").orderBy("residue"))).filter("next IS NOT NULL")
        inner = inner.union(following.join(F.broadcast(links), "name").select("frame_id", F.col("first") + F.col("site"), F.col("next") + F.col("next_site"), F.lit("link")))
    return inner.select("frame_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "origin")


def append_sites(residues: DataFrame, sites: DataFrame, labels: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Added atoms ``frame_id, residue, site_name, atom_id, code`` and their bonds ``frame_id, i, j``.

    residues: ``frame_id, residue, name``; sites: ``name, site_name, bond_to``, for
    each carrier residue the sites it gets and the label they are bound to; labels:
    ``frame_id, residue, label, atom_id``; last: ``frame_id, last``, the greatest
    atom id of each frame. Ids go on from the last, in order of residue and site
    name; codes number the site names. A label that a residue lacks is an error.
    """
    nth = F.row_number().over(W.partitionBy("frame_id").orderBy("residue", "site_name"))
    codes = sites.select("site_name").distinct().withColumn("code", F.dense_rank().over(W.orderBy("site_name")).cast("int"))
    added = residues.join(F.broadcast(sites), "name").withColumn("nth", nth).join(last, "frame_id").join(F.broadcast(codes), "site_name")
    added = added.select("frame_id", "residue", "site_name", "bond_to", (F.col("last") + F.col("nth")).alias("atom_id"), "code")
    met = added.join(labels.select("frame_id", "residue", F.col("label").alias("bond_to"), F.col("atom_id").alias("to")), ["frame_id", "residue", "bond_to"], "left")
    there = F.when(F.col("to").isNull(), F.raise_error(F.concat(F.lit("no atom is labelled "), "bond_to"))).otherwise(F.col("to"))
    return added.drop("bond_to"), met.select("frame_id", there.alias("i"), F.col("atom_id").alias("j"))


#: Bits of an atom id within its block; a block's atoms are tied together in one group, links between blocks are followed by joins.
BLOCK_BITS = 16


def _none() -> Column:
    return F.struct(*[F.lit(0.0).alias(a) for a in "xyz"])


def bonded_components(bonds: DataFrame) -> DataFrame:
    """``frame_id, atom_id, component``: atoms that bonds ``frame_id, i, j`` hold together, named by the least atom; frames apart."""
    links = cut(bonds.select("frame_id", "i", "j"))
    return made_whole(links.select("*", _none().alias("v"), _none().alias("at_i"), _none().alias("at_j"))).select("frame_id", "atom_id", "component")


def _joined_to(hooks: DataFrame, end: str) -> DataFrame:
    """Hooks as what the node in column ``end`` hangs on: ``<end>_on`` and its vector ``<end>_off``."""
    return hooks.select("frame_id", F.col("node").alias(end), F.col("on").alias(f"{end}_on"), F.col("off").alias(f"{end}_off"))


def _sum(u, v, sign: int = 1):
    """No vector ``v`` counts as 0; one that is not known leaves the sum unknown."""
    return F.struct(*[(F.col(f"{u}.{a}") + sign * F.when(F.col(v).isNull(), 0.0).otherwise(F.col(f"{v}.{a}"))).alias(a) for a in "xyz"])


def _hooks(links: DataFrame) -> DataFrame:
    """``node, on, off``: each node with a lesser neighbour hangs on its least one, with the vector from there, a known one if there are several; cut. None is left when links are empty."""
    up = F.col("i") > F.col("j")
    ends = links.select("frame_id", F.when(up, F.col("i")).otherwise(F.col("j")).alias("node"), F.when(up, F.col("j")).otherwise(F.col("i")).alias("on"), F.struct(*[F.when(up, -F.col(f"v.{a}")).otherwise(F.col(f"v.{a}")).alias(a) for a in "xyz"]).alias("off"))
    unknown = F.isnull(F.col("off.x") + F.col("off.y") + F.col("off.z")).alias("unknown")
    least = ends.groupBy("frame_id", "node").agg(F.min(F.struct("on", unknown, "off")).alias("h"))
    return cut(least.select("frame_id", "node", "h.on", "h.off"))


def _to_the_top(hooks: DataFrame, max_passes: int) -> DataFrame:
    """Hooks on the first node of each chain: a pass doubles how far each reaches."""
    for _ in range(max_passes):
        seen = Observation()
        met = hooks.join(_joined_to(hooks, "on"), ["frame_id", "on"], "left")
        further = met.select("frame_id", "node", F.coalesce("on_on", "on").alias("on"), _sum("off", "on_off").alias("off"), F.col("on_on").isNotNull().alias("moved"))
        hooks = cut(further.observe(seen, F.count_if("moved").alias("n")).drop("moved"))
        if not seen.get["n"]:
            return hooks
    raise RuntimeError(f"chains still double after {max_passes} passes")


def _forest(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of links i-j in order, where among them the least node is that each is tied to, and the vector from there.

    A round hangs each node on its least neighbour, follows chains to their tops by
    doubling, and goes on with the links between tops.
    """
    nodes, ends = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = ends[: len(i)], ends[len(i) :]
    top, off = np.arange(len(nodes)), np.zeros((len(nodes), 3))
    while (apart := i != j).any():
        i, j, v = i[apart], j[apart], v[apart]
        low, high, v = np.minimum(i, j), np.maximum(i, j), np.where((i > j)[:, None], -v, v)
        order = np.lexsort((v[:, 2], v[:, 1], v[:, 0], np.isnan(v).any(axis=1), low, high))
        least = order[np.unique(high[order], return_index=True)[1]]
        on, hung = np.arange(len(nodes)), np.zeros((len(nodes), 3))
        on[high[least]], hung[high[least]] = low[least], v[least]
        while (on[on] != on).any():
            hung, on = hung + hung[on], on[on]
        top, off = on[top], off + hung[top]
        i, j, v = on[low], on[high], v + hung[low] - hung[high]
    return nodes, top, off


def _tied(rows: pd.DataFrame) -> pd.DataFrame:
    """The atoms of one block, each with its top, its vector from there, where the top is and where it is itself."""
    i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
    nodes, top, off = _forest(i, j, rows[["vx", "vy", "vz"]].to_numpy())
    at = np.empty_like(off)
    for node, end in ((i, "i"), (j, "j")):
        at[np.searchsorted(nodes, node)] = rows[[f"{a}{end}" for a in "xyz"]].to_numpy()
    vectors = {f"{a}{k}": m[:, n] for k, m in (("off", off), ("top", at[top]), ("at", at)) for n, a in enumerate("xyz")}
    return pd.DataFrame({"frame_id": rows["frame_id"].iloc[0], "atom_id": nodes, "top": nodes[top], **vectors})


def _tied_in_blocks(links: DataFrame) -> DataFrame:
    """``frame_id, atom_id, top, off, start, at``: the atoms of links within blocks, each with its vector from its top, where the top is and where it is itself."""
    flat = [F.col(f"{c}.{a}").alias(k.format(a)) for c, k in (("v", "v{}"), ("at_i", "{}i"), ("at_j", "{}j")) for a in "xyz"]
    rows = links.select("frame_id", F.shiftright("i", BLOCK_BITS).alias("block"), "i", "j", *flat)
    schema = f"frame_id {dict(links.dtypes)['frame_id']}, atom_id long, top long, " + ", ".join(f"{a}{k} double" for k in ("off", "top", "at") for a in "xyz")
    tied = rows.groupBy("frame_id", "block").applyInPandas(_tied, schema)
    return tied.select("frame_id", "atom_id", "top", *[F.struct(*[F.col(f"{a}{k}").alias(a) for a in "xyz"]).alias(c) for k, c in (("off", "off"), ("top", "start"), ("at", "at"))])


def _between_tops(links: DataFrame, hooks: DataFrame) -> DataFrame:
    """Links moved from their ends to what these hang on; those within a tree go."""
    moved = links.join(_joined_to(hooks, "i"), ["frame_id", "i"], "left").join(_joined_to(hooks, "j"), ["frame_id", "j"], "left")
    moved = moved.withColumn("v", _sum("v", "i_off")).withColumn("v", _sum("v", "j_off", -1))
    return cut(moved.select("frame_id", F.coalesce("i_on", "i").alias("i"), F.coalesce("j_on", "j").alias("j"), "v").filter("i <> j"))


def _tied_across(tree: DataFrame, across: DataFrame, max_passes: int) -> DataFrame:
    """The tree of the blocks with the links between them followed, by joins that are cut."""
    ends = across.select("frame_id", F.explode(F.array(*[F.struct(F.col(e).alias("atom_id"), F.col(f"at_{e}").alias("at")) for e in "ij"])).alias("e"))
    alone = ends.select("frame_id", "e.atom_id", F.col("e.atom_id").alias("top"), _none().alias("off"), F.col("e.at").alias("start"), "e.at")
    tied = tree.unionByName(alone).groupBy("frame_id", "atom_id").agg(F.min_by(F.struct("top", "off", "start", "at"), "top").alias("t"))
    tree = cut(tied.select("frame_id", "atom_id", "t.*"))
    starts = tree.filter("atom_id = top").select("frame_id", "top", "start")
    links = _between_tops(across.select("frame_id", "i", "j", "v"), tree.filter("atom_id <> top").select("frame_id", F.col("atom_id").alias("node"), F.col("top").alias("on"), "off"))
    tree = tree.drop("start")
    for _ in range(max_passes):
        hooks = _hooks(links)
        if hooks.isEmpty():
            return tree.join(starts, ["frame_id", "top"])
        hooks = _to_the_top(hooks, max_passes)
        hung = tree.join(_joined_to(hooks, "top"), ["frame_id", "top"], "left")
        tree = cut(hung.select("frame_id", "atom_id", F.coalesce("top_on", "top").alias("top"), _sum("off", "top_off").alias("off"), "at"))
        links = _between_tops(links, hooks)
    raise RuntimeError(f"components still join after {max_passes} passes")


def made_whole(links: DataFrame, max_passes: int = 60) -> DataFrame:
    """``frame_id, atom_id, component, x, y, z, at``: what links hold together, made whole and placed where its least atom is, whose id names it; ``at`` is where the atom stood.

    links: ``frame_id, i, j, v`` (vector from i to j), ``at_i, at_j`` (where the ends
    are); read twice. Every atom carries its vector from the node that it hangs on.
    Atoms of a block of 2^16 ids are tied together where their frame is, so molecules
    of near ids are neither joined nor written. Only links from block to block are
    followed by joins: each node hangs on its least neighbour, chains are followed by
    doubling, about log2(n) passes for a chain through n blocks, each cut. In a ring round the
    cell, which has no whole, the vectors within blocks and then those through least
    neighbours count. Atoms of no link, and those linked to themselves alone, are absent; beyond
    a vector that is not known, places are null.
    """
    xyz = lambda c: F.struct(*[F.col(f"{c}.{a}").cast("double").alias(a) for a in "xyz"]).alias(c)
    links = links.filter("frame_id IS NOT NULL AND i <> j").select("frame_id", *[F.col(c).cast("long").alias(c) for c in "ij"], xyz("v"), xyz("at_i"), xyz("at_j"))
    same = F.shiftright("i", BLOCK_BITS) == F.shiftright("j", BLOCK_BITS)
    tree, across = _tied_in_blocks(links.filter(same)), links.filter(~same)
    if not across.isEmpty():
        tree = _tied_across(tree, cut(across), max_passes)
    return tree.select("frame_id", "atom_id", F.col("top").alias("component"), *[(F.col(f"start.{a}") + F.col(f"off.{a}")).alias(a) for a in "xyz"], "at")


def image_vector(i: str, j: str, edge: str) -> Column:
    """The vector from the place in column ``i`` to that in ``j``, as its nearest image in a rectangular cell."""
    return F.struct(*[minimum_image(F.col(f"{j}.{a}") - F.col(f"{i}.{a}"), F.col(f"{edge}.l{a}")).alias(a) for a in "xyz"])


def unwrapped(atoms: DataFrame, bonds: DataFrame, components: DataFrame, max_passes: int = 60) -> DataFrame:
    """``frame_id, atom_id, component, x, y, z``: given components made whole, each placed where its least atom is.

    For bonds without places, which take them from the atoms by joins; else as ``made_whole``.
    """
    place = atoms.select("frame_id", "atom_id", F.struct("x", "y", "z").alias("at"), F.struct("lx", "ly", "lz").alias("edge"))
    members = cut(components.join(place, ["frame_id", "atom_id"]))
    end = lambda c: members.select("frame_id", F.col("atom_id").alias(c), F.col("at").alias(f"at_{c}"), F.col("edge").alias(f"edge_{c}"))
    links = bonds.select("frame_id", "i", "j").join(end("i"), ["frame_id", "i"]).join(end("j"), ["frame_id", "j"])
    whole = made_whole(cut(links.select("frame_id", "i", "j", image_vector("at_i", "at_j", "edge_i").alias("v"), "at_i", "at_j")), max_passes)
    met = members.join(whole.select("frame_id", "atom_id", F.struct("x", "y", "z").alias("to")), ["frame_id", "atom_id"], "left")
    at = F.when(F.col("to").isNotNull(), F.col("to")).otherwise(F.col("at"))
    return met.select("frame_id", "atom_id", "component", *[at[a].alias(a) for a in "xyz"])


def refitted_z(whole: DataFrame, atoms: DataFrame | None, lo: float, hi: float) -> DataFrame:
    """``frame_id, atom_id, component, shift, z, image``: components moved along z into [lo, hi), as little as can be.

    ``whole``: components made whole, read several times; ``atoms``: where their atoms
    stood, None if ``whole`` has it in ``at`` and need not be joined. A
    component that fits as it is stays. Else its shift is, of the two that put it
    at either end and those that leave one of its atoms in place (held between
    the two), that which moves the fewest atoms, then the least in sum, then the
    shortest. One that is longer than the box is an error.
    """
    key = ["frame_id", "component"]
    if atoms is None:
        rows = whole.select("frame_id", "atom_id", "component", F.col("z").alias("u"), F.col("at.z").alias("z0"))
    else:
        rows = whole.select("frame_id", "atom_id", "component", F.col("z").alias("u")).join(atoms.select("frame_id", "atom_id", F.col("z").alias("z0")), ["frame_id", "atom_id"])
    span = rows.groupBy(*key).agg((F.lit(lo) - F.min("u")).alias("low"), (F.lit(hi) - F.max("u")).alias("high"))
    span = span.withColumn("low", F.when(F.col("low") > F.col("high"), F.raise_error(F.lit("a component is longer than the box"))).otherwise(F.col("low")))
    still = span.filter("low <= 0 AND high >= 0").select(*key, F.lit(0.0).alias("shift"))
    moving = span.filter("NOT (low <= 0 AND high >= 0)")
    held = rows.join(moving, key).select(*key, F.greatest("low", F.least("high", F.col("z0") - F.col("u"))).alias("shift"))
    tried = moving.select(*key, F.explode(F.array("low", "high")).alias("shift")).union(held).distinct()
    off = F.abs(F.col("u") + F.col("shift") - F.col("z0"))
    scored = rows.join(tried, key).groupBy(*key, "shift").agg(F.count_if(off > 1e-5).alias("moved"), F.round(F.sum(off), 9).alias("far"))  # equal sums may differ in the last bits
    best = scored.groupBy(*key).agg(F.min_by("shift", F.struct("moved", "far", F.abs("shift"))).alias("shift")).union(still)
    z = F.col("u") + F.col("shift")
    image = F.floor((z - lo) / (hi - lo))
    return rows.join(best, key).select("frame_id", "atom_id", "component", "shift", (z - image * (hi - lo)).alias("z"), image.cast("int").alias("image"))


def _both(bonds: DataFrame) -> DataFrame:
    checked = F.when(F.col("i") == F.col("j"), F.raise_error(F.lit("self bond"))).otherwise(F.col("i"))
    one = bonds.select("frame_id", checked.alias("i"), "j")
    return one.union(one.select("frame_id", "j", "i"))


def angles_from_bonds(bonds: DataFrame) -> DataFrame:
    """Every ``i, j, k`` with bonds i-j and j-k and i < k."""
    b = _both(bonds)
    left, right = b.select("frame_id", F.col("i").alias("c"), F.col("j").alias("x")), b.select("frame_id", F.col("i").alias("c"), F.col("j").alias("y"))
    return left.join(right, ["frame_id", "c"]).filter("x < y").select("frame_id", F.col("x").alias("i"), F.col("c").alias("j"), F.col("y").alias("k"))


def dihedrals_from_bonds(bonds: DataFrame) -> DataFrame:
    """Every chain ``i, j, k, l`` of three bonds once up to reversal; i <> k and l <> j."""
    b = _both(bonds)
    middle = bonds.select("frame_id", F.least("i", "j").alias("j"), F.greatest("i", "j").alias("k")).distinct()
    head = b.select("frame_id", F.col("i").alias("j"), F.col("j").alias("h"))
    tail = b.select("frame_id", F.col("i").alias("k"), F.col("j").alias("l"))
    out = middle.join(head, ["frame_id", "j"]).join(tail, ["frame_id", "k"]).filter("h <> k AND l <> j")
    turn = F.col("h") > F.col("l")
    pick = lambda a, c: F.when(turn, F.col(c)).otherwise(F.col(a))
    return out.select("frame_id", pick("h", "l").alias("i"), pick("j", "k").alias("j"), pick("k", "j").alias("k"), pick("l", "h").alias("l")).distinct()


def angles_through(bonds: DataFrame, links: DataFrame) -> DataFrame:
    """Angles with at least one bond among ``links`` (``frame_id, i, j``)."""
    marked = links.select("frame_id", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q")).distinct().withColumn("linked", F.lit(1))
    out = angles_from_bonds(bonds)
    for a, b, name in (("i", "j", "x"), ("j", "k", "y")):
        side = marked.withColumnRenamed("linked", name)
        out = out.withColumns({"p": F.least(a, b), "q": F.greatest(a, b)}).join(side, ["frame_id", "p", "q"], "left").drop("p", "q")
    return out.filter("x = 1 OR y = 1").drop("x", "y")


def _molecule():
    return W.partitionBy("frame_id", "mol_id").orderBy("ord")


def parents(atoms: DataFrame, heavy) -> DataFrame:
    """Adds ``parent``: the nearest heavy atom of the molecule at or before each atom, by ``ord``; null before the first."""
    before = _molecule().rowsBetween(W.unboundedPreceding, 0)
    return atoms.withColumn("parent", F.last(F.when(heavy, F.col("ord")), ignorenulls=True).over(before))


def runs(atoms: DataFrame, value: str) -> DataFrame:
    """``frame_id, mol_id``, the value, ``first_ord, repeat``: neighbours in a molecule with one value as one group."""
    starts = F.when(F.lag(value).over(_molecule()) == F.col(value), 0).otherwise(1)
    numbered = atoms.select("frame_id", "mol_id", "ord", value, starts.alias("starts")).withColumn("run", F.sum("starts").over(_molecule()))
    return numbered.groupBy("frame_id", "mol_id", "run", value).agg(F.min("ord").alias("first_ord"), F.count("*").alias("repeat")).drop("run")


def next_residues(residues: DataFrame) -> DataFrame:
    """``frame_id, mol_id, next_mol``: each residue and the next one of its frame."""
    following = F.lead("mol_id").over(W.partitionBy("frame_id").orderBy("mol_id"))
    return residues.withColumn("next_mol", following).filter("next_mol IS NOT NULL")


def seeded_sites(atoms: DataFrame, distance: float, per_frame: tuple[str, ...] = ()) -> DataFrame:
    """``frame_id, mol_id, n, ax, ay, az, vx, vy, vz`` and the per-frame columns: a site for each molecule, off its first atom and away from its centre.

    Where the two coincide the site lies along x.
    """
    places = [F.avg(f"u{x}").alias(f"c{x}") for x in "xyz"] + [F.min_by(f"u{x}", "ord").alias(f"a{x}") for x in "xyz"]
    a = atoms.groupBy("frame_id", "mol_id").agg(F.count("*").alias("n"), *places, *[F.first(c).alias(c) for c in per_frame])
    size = F.sqrt(sum(((F.col(f"a{x}") - F.col(f"c{x}")) * (F.col(f"a{x}") - F.col(f"c{x}")) for x in "xyz"), F.lit(0.0)))
    step = {x: F.coalesce(distance * (F.col(f"a{x}") - F.col(f"c{x}")) / F.nullif(size, F.lit(0.0)), F.lit(distance if x == "x" else 0.0)) for x in "xyz"}
    return a.withColumns({f"v{x}": F.col(f"a{x}") + step[x] for x in "xyz"}).drop("cx", "cy", "cz")
