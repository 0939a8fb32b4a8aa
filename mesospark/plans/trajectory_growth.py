"""Registered queries: bonded terms by templates, links and labels; added sites at an angle to an axis."""

from pyspark.sql import functions as F

from mesospark.operators import growth, topology
from mesospark.plans.lineage import cut
from mesospark.plans.trajectory import query
from mesospark.sources import adapters as A

_UNITS = """v_unit AS (SELECT *, CAST(floor(mol_id / 5.0) AS BIGINT) AS molecule, dense_rank() OVER (PARTITION BY frame_id, floor(mol_id / 5.0) ORDER BY mol_id) AS nth, row_number() OVER (PARTITION BY frame_id, floor(mol_id / 5.0) ORDER BY mol_id, ord) AS unit FROM v_atoms),
v_big AS (SELECT frame_id, molecule FROM v_unit GROUP BY 1, 2 HAVING max(nth) >= 2 AND count(*) >= 4),
v_chain AS (SELECT frame_id, atom_id AS a1, lead(atom_id) OVER k AS a2, lead(atom_id, 2) OVER k AS a3 FROM v_atoms WINDOW k AS (PARTITION BY frame_id, mol_id ORDER BY ord)),
v_link AS (SELECT frame_id, last AS i, lead(first) OVER (PARTITION BY frame_id, molecule ORDER BY mol_id) AS j FROM (SELECT frame_id, molecule, mol_id, min(atom_id) AS first, max(atom_id) AS last FROM v_unit GROUP BY 1, 2, 3)),
v_ways AS (SELECT frame_id, a1 AS i, a2 AS j, 0 AS linked FROM v_chain WHERE a2 IS NOT NULL UNION ALL SELECT frame_id, a2, a1, 0 FROM v_chain WHERE a2 IS NOT NULL UNION ALL SELECT frame_id, i, j, 1 FROM v_link WHERE j IS NOT NULL UNION ALL SELECT frame_id, j, i, 1 FROM v_link WHERE j IS NOT NULL)"""


@query("S18_terms", _UNITS, select="""SELECT frame_id, style, origin, a1, a2, coalesce(a3, -1) AS a3, coalesce(a4, -1) AS a4 FROM (
 SELECT frame_id, 'bond' AS style, 'template' AS origin, a1, a2, NULL AS a3, NULL AS a4 FROM v_chain WHERE a2 IS NOT NULL UNION ALL SELECT frame_id, 'angle', 'template', a1, a2, a3, NULL FROM v_chain WHERE a3 IS NOT NULL
 UNION ALL SELECT frame_id, 'bond', 'link', i, j, NULL, NULL FROM v_link WHERE j IS NOT NULL
 UNION ALL SELECT DISTINCT x.frame_id, 'angle', 'link', x.j, x.i, y.j, NULL FROM v_ways x JOIN v_ways y ON x.frame_id = y.frame_id AND x.i = y.i AND x.j < y.j WHERE x.linked + y.linked > 0
 UNION ALL SELECT frame_id, 'dihedral', 'extra', max(CASE WHEN unit = 1 THEN atom_id END), max(CASE WHEN unit = 2 THEN atom_id END), max(CASE WHEN unit = 3 THEN atom_id END), max(CASE WHEN unit = 4 THEN atom_id END) FROM v_unit JOIN v_big USING (frame_id, molecule) GROUP BY frame_id, molecule
 UNION ALL SELECT frame_id, 'bond', 'extra', max(CASE WHEN nth = 1 THEN atom_id END) AS p, max(CASE WHEN nth = 2 THEN atom_id END) AS q, NULL, NULL FROM v_unit JOIN v_big USING (frame_id, molecule) WHERE ord = 1 GROUP BY frame_id, molecule HAVING (frame_id, p, q) NOT IN (SELECT frame_id, i, j FROM v_link WHERE j IS NOT NULL))""")
def s18_terms(spark, d):
    """Orders are residues, five successive order numbers a molecule: chains of bonds and angles, links, their angles, and terms by (residue, site) and by unit index."""
    atoms = A.atoms(spark, d)
    plain = atoms.groupBy("frame_id", F.floor(F.col("mol_id") / 5.0).cast("long").alias("molecule"), F.col("mol_id").alias("residue")).agg(F.count("*").alias("size"), (F.min("atom_id") - 1).alias("first"))
    kinds = plain.groupBy("frame_id", "molecule").agg(F.when((F.count("*") >= 2) & (F.sum("size") >= 4), "big").otherwise("small").alias("kind"))
    residues = cut(plain.withColumn("name", F.col("size")).join(kinds, ["frame_id", "molecule"]))
    sizes = residues.select("name").distinct()
    run = lambda n: F.sequence(F.lit(1).cast("long"), F.col("name") - (n - 1))
    chain = lambda n, style: sizes.filter(F.col("name") >= n).select("name", F.lit(style).alias("style"), F.explode(F.transform(run(n), lambda i: F.array(*[i + k for k in range(n)]))).alias("sites"))
    linkers = sizes.select("name", F.lit(1).alias("left"), F.col("name").alias("right"))
    extra = spark.createDataFrame([("big", "bond", [(1, 1), (2, 1)]), ("big", "dihedral", [(None, k) for k in (1, 2, 3, 4)])], "kind string, style string, parts array<struct<nth: long, site: long>>")
    found = growth.template_terms(residues, chain(2, "bond").union(chain(3, "angle")), linkers, extra, link_angles=True)
    return found.select("frame_id", "style", "origin", "a1", "a2", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("a3", "a4")])


_GROWN = """v_res AS (SELECT frame_id, mol_id, count(*) AS size, min(atom_id) AS first FROM v_atoms GROUP BY 1, 2 HAVING count(*) >= 4),
v_new AS (SELECT r.*, last + row_number() OVER (PARTITION BY r.frame_id ORDER BY mol_id) AS site FROM v_res r JOIN (SELECT frame_id, max(atom_id) AS last FROM v_atoms GROUP BY 1) l ON l.frame_id = r.frame_id),
v_typed AS (SELECT n.*, a.type AS t1, b.type AS t2, c.type AS t3 FROM v_new n JOIN v_atoms a ON a.frame_id = n.frame_id AND a.mol_id = n.mol_id AND a.ord = 1 JOIN v_atoms b ON b.frame_id = n.frame_id AND b.mol_id = n.mol_id AND b.ord = 2 JOIN v_atoms c ON c.frame_id = n.frame_id AND c.mol_id = n.mol_id AND c.ord = 3),
v_keyed AS (SELECT frame_id, mol_id, 'bond' AS style, site AS a1, first AS a2, -1 AS a3, -1 AS a4, 'bond:' || least(t1, 'VA') || ':' || greatest(t1, 'VA') AS key FROM v_typed
 UNION ALL SELECT frame_id, mol_id, 'angle', first + 1, first, site, -1, 'angle:' || least(t2, 'VA') || ':' || t1 || ':' || greatest(t2, 'VA') FROM v_typed
 UNION ALL SELECT frame_id, mol_id, 'dihedral', site, first, first + 1, first + 2, 'dihedral:' || CASE WHEN 'VA' > t3 THEN t3 || ':' || t2 || ':' || t1 || ':VA' ELSE 'VA:' || t1 || ':' || t2 || ':' || t3 END FROM v_typed)"""


@query("V00_terms", _GROWN, select="SELECT frame_id, mol_id AS residue, style, a1, a2, a3, a4, key, CAST(dense_rank() OVER (PARTITION BY style ORDER BY key) AS INTEGER) AS type_id FROM v_keyed")
def v00_terms(spark, d):
    """Molecules of four atoms and more get a site with a bond, an angle and a dihedral, named by label."""
    atoms = A.atoms(spark, d)
    residues = cut(atoms.groupBy("frame_id", F.col("mol_id").alias("residue")).agg(F.count("*").alias("name")).filter("name >= 4"))
    names = residues.select("name").distinct()
    specs = names.select("name", F.explode(F.array(*[F.struct(F.lit(s).alias("style"), F.array(*map(F.lit, of)).alias("labels")) for s, of in (("bond", ("VA", "1")), ("angle", ("2", "1", "VA")), ("dihedral", ("VA", "1", "2", "3")))])).alias("s")).select("name", "s.*")
    labels = atoms.select("frame_id", F.col("mol_id").alias("residue"), F.col("ord").cast("string").alias("label"), "atom_id", "type")
    last = atoms.groupBy("frame_id").agg(F.max("atom_id").alias("last"))
    added, _ = topology.append_sites(residues, names.select("name", F.lit("VA").alias("site_name"), F.lit("1").alias("bond_to")), labels, last)
    found = growth.labelled_terms(residues, specs, labels, added)
    return found.select("frame_id", "residue", "style", "a1", "a2", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("a3", "a4")], "key", "type_id")


_U = "CAST(('0x' || substr(md5('23:{}:' || frame_id || ':' || mol_id), 1, 13)) AS BIGINT) / 4503599627370496.0"
_AXIS = f"""v_m AS (SELECT frame_id, mol_id, max(CASE WHEN ord = 1 THEN ux END) AS ax, max(CASE WHEN ord = 1 THEN uy END) AS ay, max(CASE WHEN ord = 1 THEN uz END) AS az, max(CASE WHEN ord = 2 THEN ux END) AS bx, max(CASE WHEN ord = 2 THEN uy END) AS by_, max(CASE WHEN ord = 2 THEN uz END) AS bz FROM v_atoms GROUP BY 1, 2),
v_h AS (SELECT *, {_U.format("azimuth")} * 2 * pi() AS turn, {_U.format("height")} * 2 - 1 AS lift, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2 + (bz - az) ** 2) AS r FROM v_m),
v_e AS (SELECT *, (bx - ax) / r AS e1, (by_ - ay) / r AS e2, (bz - az) / r AS e3 FROM v_h),
v_p AS (SELECT *, CASE WHEN abs(e3) > 0.9 THEN -e3 ELSE e2 END / s AS p1, CASE WHEN abs(e3) > 0.9 THEN 0 ELSE -e1 END / s AS p2, CASE WHEN abs(e3) > 0.9 THEN e1 ELSE 0 END / s AS p3 FROM (SELECT *, CASE WHEN abs(e3) > 0.9 THEN sqrt(e3 * e3 + e1 * e1) ELSE sqrt(e1 * e1 + e2 * e2) END AS s FROM v_e))"""


@query("V01_axis", _AXIS, select="""SELECT frame_id, mol_id, round(CASE WHEN r IS NULL THEN ax + 0.5 * sqrt(1 - lift * lift) * cos(turn) ELSE ax + 0.5 * (cos(radians(110)) * e1 + sin(radians(110)) * (cos(turn) * p1 + sin(turn) * (e2 * p3 - e3 * p2))) END, 5) + 0.0 AS vx,
 round(CASE WHEN r IS NULL THEN az + 0.5 * lift ELSE az + 0.5 * (cos(radians(110)) * e3 + sin(radians(110)) * (cos(turn) * p3 + sin(turn) * (e1 * p2 - e2 * p1))) END, 5) + 0.0 AS vz FROM v_p""")
def v01_axis(spark, d):
    """A site a molecule at 0.5 from its first atom and 110 degrees from its second, at a seeded azimuth."""
    placed = growth.axis_seeded_sites(A.atoms(spark, d), 0.5, 110.0, 23)
    return placed.select("frame_id", "mol_id", (F.round("vx", 5) + 0.0).alias("vx"), (F.round("vz", 5) + 0.0).alias("vz"))
