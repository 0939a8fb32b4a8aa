"""Registered queries: references for whole molecules, mapped velocities, exported tables and their manifest, parts of users with all they give."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mesospark.operators import extensions, mapping, tables
from mesospark.plans.lineage import cut
from mesospark.plans.trajectory import BONDS, TABLE, W01_SQL, _bonds, _table, query
from mesospark.plans.trajectory_more import _scratch
from mesospark.plans.trajectory_tables import _EQ, _lookup_sql
from mesospark.sources import adapters as A
from mesospark.sources.frame_files import listed, paired
from mesospark.sources.table_files import load_tables, write_tables

_KINDS = ("first", "third", "anchor", "site")


@query("J09_references", "v_lead AS MATERIALIZED (SELECT frame_id, mol_id, count(*) AS n, max(CASE WHEN ord = 1 THEN x END) AS x1, max(CASE WHEN ord = 3 THEN x END) AS x3, arg_max(x, ord) AS xn FROM v_atoms GROUP BY 1, 2)",
 "v_s AS MATERIALIZED (SELECT frame_id, mol_id, floor((ord - 1) / 2.0) AS site, arg_min(x, ord) AS xs FROM v_atoms GROUP BY 1, 2, 3)",
 select="""SELECT a.frame_id, a.mol_id, """ + ", ".join(f"round(sum(abs((a.x - {x}) - a.lx * round_even((a.x - {x}) / a.lx, 0))), 4) AS {name}" for x, name in zip(("x1", "x3", "xn", "xs"), _KINDS, strict=True)) + """ FROM v_atoms a JOIN v_lead b ON a.frame_id = b.frame_id AND a.mol_id = b.mol_id JOIN v_s s ON s.frame_id = a.frame_id AND s.mol_id = a.mol_id AND s.site = floor((a.ord - 1) / 2.0) WHERE n >= 3 GROUP BY 1, 2""")
def j09_references(spark, d):
    """How far the atoms of molecules of three and more are from each kind of reference, along x."""
    every = A.atoms(spark, d)
    sizes = every.groupBy("frame_id", "mol_id").agg(F.count("*").alias("size"))
    held = every.join(sizes.filter("size >= 3"), ["frame_id", "mol_id"])
    atoms = cut(held.select("frame_id", "mol_id", "atom_id", "ord", "size", "x", "y", "z", "lx", "ly", "lz", F.floor((F.col("ord") - 1) / 2.0).alias("site")))
    anchors = atoms.select("mol_id", F.col("size").alias("anchor")).distinct()
    out = None
    for name, reference in zip(_KINDS, ("first", 3, anchors, "site"), strict=True):
        whole = mapping.made_whole(atoms, reference)
        if name == "site":
            home = F.min_by("x", "ord")
            keys = ["frame_id", "mol_id", "site"]
        else:
            home = F.max(F.when(F.col("ord") == {"first": F.lit(1), "third": F.lit(3), "anchor": F.col("size")}[name], F.col("x")))
            keys = ["frame_id", "mol_id"]
        off = whole.join(whole.groupBy(*keys).agg(home.alias("home")), keys).groupBy("frame_id", "mol_id").agg(F.round(F.sum(F.abs(F.col("x") - F.col("home"))), 4).alias(name))
        out = off if out is None else out.join(off, ["frame_id", "mol_id"])
    return out


@query("A32_velocities", select="SELECT frame_id, mol_id, CAST(floor((ord - 1) / 2.0) AS BIGINT) AS site, " + ", ".join(f"round(sum(mass * {v}) / sum(mass), 8) + 0.0 AS v{a}" for a, v in zip("xyz", ("(fy - fz)", "(fz - fx)", "(fx - fy)"), strict=True)) + " FROM v_atoms GROUP BY 1, 2, 3")
def a32_velocities(spark, d):
    """Velocities (differences of force components stand for them) of sites of two atoms."""
    atoms = A.atoms(spark, d)
    moving = atoms.withColumns({"vx": F.col("fy") - F.col("fz"), "vy": F.col("fz") - F.col("fx"), "vz": F.col("fx") - F.col("fy")})
    return mapping.map_velocities(moving, mapping.adapter_map(atoms)).select("frame_id", "mol_id", "site", *[(F.round(f"v{a}", 8) + 0.0).alias(f"v{a}") for a in "xyz"])


_N = 41


@query("S16_manifest", BONDS, TABLE, W01_SQL, f"v_points AS (SELECT key, i, CASE WHEN i = {_N - 1} THEN hi ELSE lo + (hi - lo) * i / {_N - 1} END AS q FROM (SELECT key, min(x) AS lo, max(x) AS hi FROM v_int GROUP BY 1), (SELECT unnest(range({_N})) AS i))",
 _lookup_sql("v_p", "v_points", "v_int"), _EQ.format("p"), select="""SELECT key, round(lo, 6) AS lo, round(hi, 6) AS hi, n, round(x0, 5) AS eq, round(a, 4) + 0.0 AS slope_lo, round(b, 4) + 0.0 AS slope_hi FROM (SELECT key, min(q) AS lo, max(q) AS hi, count(*) AS n, arg_min(s, q) AS a, arg_max(s, q) AS b FROM (SELECT key, q,
 (coalesce(lead(force) OVER k, force) - coalesce(lag(force) OVER k, force)) / (coalesce(lead(q) OVER k, q) - coalesce(lag(q) OVER k, q)) AS s FROM v_p WINDOW k AS (PARTITION BY key ORDER BY q)) GROUP BY 1) JOIN v_pe USING (key)""")
def s16_manifest(spark, d):
    """Every table on its output grid, written in the section format, read back and described."""
    path = _scratch(spark, "manifest")
    write_tables(tables.on_grid(cut(tables.integrated(_table(spark, d))), _N), path)
    found = tables.manifest(load_tables(spark, path))
    return found.select("key", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n", F.round("eq", 5).alias("eq"), *[(F.round(c, 4) + 0.0).alias(c) for c in ("slope_lo", "slope_hi")])


@query("X02_limits", BONDS, select="SELECT key, round(sum((1 - e) ** 2), 4) AS d, round(sum(4.0 * (1 - e) * e * (value - 1.2)), 4) + 0.0 AS a FROM (SELECT key, value, exp(-3.0 * (value - 1.2)) AS e FROM v_bonds) GROUP BY 1")
def x02_limits(spark, d):
    """The gradient of a user's potential by the parameters that a fit may move, at values held inside its bounds (a = 9 is 3)."""
    morse = extensions.POTENTIALS["morse"]
    slopes = morse.free_gradient(F.col("value"), **morse.clamped(d=2.0, a=9.0, r0=1.2))
    return _bonds(spark, d).groupBy("key").agg(*[(F.round(F.sum(g), 4) + 0.0).alias(n) for n, g in slopes.items()])


@query("X04_slopes", BONDS, select="SELECT key, m, round(sum(CASE WHEN abs(value - 1) < 1 THEN m * sin(m * acos(value - 1)) / sin(acos(value - 1)) ELSE 0 END), 3) + 0.0 AS s FROM v_bonds CROSS JOIN (SELECT CAST(unnest(range(4)) AS INTEGER) AS m) GROUP BY 1, 2")
def x04_slopes(spark, d):
    """Derivatives of a user's basis."""
    rows = _bonds(spark, d).select("key", extensions.basis_values(F.col("value"), "chebyshev", 4, derivative=True).alias("b"))
    sums = rows.groupBy("key").agg(F.array(*[F.sum(F.col("b")[k]) for k in range(4)]).alias("s"))
    return sums.select("key", F.posexplode("s").alias("m", "s")).select("key", "m", (F.round("s", 3) + 0.0).alias("s"))


@query("S11_expansion", """v_rank AS (SELECT frame_id, mol_id, mass, ord, row_number() OVER (PARTITION BY frame_id ORDER BY mol_id, ord) - 1 AS atom_id, floor((ord - 1) / 2.0) AS s, count(*) OVER (PARTITION BY frame_id, mol_id) AS size FROM v_atoms)""",
 select="""SELECT frame_id, CAST(dense_rank() OVER (PARTITION BY frame_id ORDER BY mol_id, s) - 1 AS BIGINT) AS site, CAST(atom_id AS BIGINT) AS atom_id, CASE WHEN ord % 2 = 1 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END AS w FROM v_rank WHERE s < floor(size / 2)""")
def s11_expansion(spark, d):
    """Each molecule is a group of repeated pairs: anchor, repeats and offsets come from the table, and the atoms are those of its frames."""
    size = A.atoms(spark, d).groupBy("frame_id", F.col("mol_id").alias("grp")).agg(F.count("*").alias("size"))
    earlier = W.partitionBy("frame_id").orderBy("grp").rowsBetween(W.unboundedPreceding, -1)
    pair = F.array(F.struct(F.lit(None).cast("long").alias("anchor"), F.array(F.lit(0), F.lit(1)).alias("index"), F.array(F.lit(0.25), F.lit(0.75)).alias("w")))
    groups = size.select("frame_id", "grp", F.sum("size").over(earlier).alias("anchor"), F.floor(F.col("size") / 2).alias("repeats"), F.lit(2).alias("step"), pair.alias("sites"))
    return mapping.expanded(groups, size.groupBy("frame_id").agg(F.sum("size").alias("n")))


@query("J10_files", select="SELECT frame_id, 'frame_' || frame_id || '.data' AS data, 'force_' || frame_id || '.txt' AS force FROM v_frames")
def j10_files(spark, d):
    """Configurations and forces of every frame, written as files of single frames, listed and paired by the ids in their names."""
    path, atoms = _scratch(spark, "frames"), A.atoms(spark, d)
    for kind, columns, before, after in (("data", "xyz", "frame_", ".data"), ("force", ("fx", "fy", "fz"), "force_", ".txt")):
        name = F.concat(F.lit(before), F.col("frame_id").cast("string"), F.lit(after)).alias("name")
        rows = atoms.repartition("frame_id").select(name, F.concat_ws(" ", "atom_id", *columns).alias("value"))
        rows.write.partitionBy("name").text(f"{path}/{kind}")
    return paired(listed(spark, f"{path}/data"), listed(spark, f"{path}/force"))
