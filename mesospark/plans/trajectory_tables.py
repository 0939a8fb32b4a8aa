"""Registered queries: tables on uneven grids, frames that arrive again, added sites that make room."""

from pyspark.sql import functions as F

from mesospark.operators import neighbors, tables, topology
from mesospark.plans.lineage import cut, ensure_checkpoint_dir
from mesospark.plans.trajectory import BONDS, TABLE, W01_SQL, _bonds, _table, query
from mesospark.sources import adapters as A
from mesospark.streaming.incremental import streamed_frame_histogram

#: Two tables with different uneven grids, made from the binned one: some knots are left out, others moved.
_LEFT_OUT = "(i * i + 2 * i) % 5 = 1"
UNEVEN = f"v_one AS (SELECT key, x, f, v FROM v_int WHERE NOT ({_LEFT_OUT})), v_two AS (SELECT key, x + 0.013 * ((i * 7) % 3) AS x, f * 1.1 - 0.02 AS f, v * 1.1 AS v FROM v_int WHERE i % 4 <> 2)"
_INTERPOLATED = "CASE WHEN t < 0 THEN f WHEN t > 1 THEN f1 ELSE f + t * (f1 - f) END AS force, CASE WHEN t < 0 THEN v - f * (q - x) WHEN t > 1 THEN v1 - f1 * (q - x1) ELSE v + t * (v1 - v) END AS energy"


def _lookup_sql(name: str, points: str, table: str) -> str:
    """Points ``key, q`` and the last knot at or before each, or the first."""
    return f"""{name}_c AS (SELECT *, CASE WHEN nth = 1 THEN -1e300 ELSE x END AS begins FROM (SELECT *, lead(x) OVER k AS x1, lead(f) OVER k AS f1, lead(v) OVER k AS v1, row_number() OVER k AS nth FROM {table} WINDOW k AS (PARTITION BY key ORDER BY x)) WHERE x1 IS NOT NULL),
{name} AS (SELECT *, {_INTERPOLATED} FROM (SELECT p.*, c.* EXCLUDE (key, begins, nth), (p.q - c.x) / (c.x1 - c.x) AS t FROM {points} p ASOF JOIN {name}_c c ON p.key = c.key AND p.q >= c.begins))"""


def _uneven(spark, d):
    t = cut(tables.integrated(_table(spark, d)))
    two = t.filter("i % 4 <> 2").select("key", (F.col("x") + 0.013 * ((F.col("i") * 7) % 3)).alias("x"), (F.col("f") * 1.1 - 0.02).alias("f"), (F.col("v") * 1.1).alias("v"))
    return t.filter(f"NOT ({_LEFT_OUT})").select("key", "x", "f", "v"), two


@query("J12_uneven", BONDS, TABLE, W01_SQL, UNEVEN, "v_points AS (SELECT key, value AS q FROM v_bonds)", _lookup_sql("v_met", "v_points", "v_one"), select="SELECT key, count(*) AS n, round(sum(force), 3) + 0.0 AS force, round(sum(energy), 3) + 0.0 AS energy FROM v_met GROUP BY 1")
def j12_uneven(spark, d):
    """Bond lengths looked up in tables without an even step."""
    one, _ = _uneven(spark, d)
    found = tables.lookup_uneven(_bonds(spark, d).select("key", F.col("value").alias("x"), "frame_id", "a1"), one)
    return found.groupBy("key").agg(F.count("*").alias("n"), (F.round(F.sum("force"), 3) + 0.0).alias("force"), (F.round(F.sum("energy"), 3) + 0.0).alias("energy"))


_N = 101
_EQ = """v_{0}i AS (SELECT *, sum(s) OVER (PARTITION BY key ORDER BY x DESC ROWS UNBOUNDED PRECEDING) AS w FROM (SELECT *, coalesce((lead(x) OVER k - x) * (lead(f) OVER k + f) / 2, 0) AS s FROM (SELECT key, q AS x, force AS f FROM v_{0}) WINDOW k AS (PARTITION BY key ORDER BY x))),
v_{0}e AS (SELECT key, CASE WHEN top BETWEEN xl AND xr THEN top ELSE x END AS x0 FROM (SELECT *, x - ((x - xl) ** 2 * (w - wr) - (x - xr) ** 2 * (w - wl)) / (2 * ((x - xl) * (w - wr) - (x - xr) * (w - wl))) AS top FROM (SELECT *, lag(x) OVER k AS xl, lead(x) OVER k AS xr, lag(w) OVER k AS wl, lead(w) OVER k AS wr,
 row_number() OVER (PARTITION BY key ORDER BY w, x) AS rank FROM v_{0}i WINDOW k AS (PARTITION BY key ORDER BY x)) WHERE rank = 1))"""
_SPAN = "v_span AS (SELECT key, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM (SELECT key, min(x) AS lo, max(x) AS hi FROM v_one GROUP BY 1) a JOIN (SELECT key, min(x) AS lo, max(x) AS hi FROM v_two GROUP BY 1) b USING (key))"


@query("J13_overlap", BONDS, TABLE, W01_SQL, UNEVEN, _SPAN, f"v_points AS (SELECT key, i, CASE WHEN i = {_N - 1} THEN hi ELSE lo + (hi - lo) * i / {_N - 1} END AS q FROM v_span, (SELECT unnest(range({_N})) AS i))",
 _lookup_sql("v_p", "v_points", "v_one"), _lookup_sql("v_r", "v_points", "v_two"), _EQ.format("p"), _EQ.format("r"), select="""SELECT d.key, df, dv, round(abs(r.x0 - p.x0), 4) + 0.0 AS shift FROM (SELECT p.key, round(max(abs(p.force - r.force)), 5) AS df, round(max(abs(p.energy - r.energy)), 5) AS dv FROM v_p p JOIN v_r r ON p.key = r.key AND p.i = r.i GROUP BY 1) d JOIN v_pe p USING (key) JOIN v_re r USING (key)""")
def j13_overlap(spark, d):
    """Two tables with different uneven grids compared on their common range."""
    out = tables.compared_on_overlap(*_uneven(spark, d), _N)
    return out.select("key", F.round("df", 5).alias("df"), F.round("dv", 5).alias("dv"), (F.round("shift", 4) + 0.0).alias("shift"))


@query("Q01_overwrite", BONDS, select="SELECT key, CAST(least(floor(value / 0.05), 59) AS INTEGER) AS bin, round(sum(w), 4) AS count, count(*) AS n FROM v_bonds WHERE value BETWEEN 0 AND 3 GROUP BY 1, 2")
def q01_overwrite(spark, d):
    """Every third frame arrives with wrong values first and again later; totals are those of the batch."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    rows = cut(_bonds(spark, d).select("frame_id", "key", "value", "w"))
    early = rows.withColumn("value", F.when(F.col("frame_id") % 3 == 0, F.col("value") + 0.2).otherwise(F.col("value")))
    take = lambda: streamed_frame_histogram(spark, f"{base}/in", rows.schema, f"{base}/state", 0.0, 3.0, 60)
    early.repartition("frame_id").write.parquet(f"{base}/in/first")
    take()
    rows.filter("frame_id % 3 = 0").repartition("frame_id").write.parquet(f"{base}/in/late")
    return take().select("key", "bin", F.round("count", 4).alias("count"), "n")


@query("V02_added", select="SELECT frame_id, count(*) AS n, round(sum(x), 3) AS sx, round(sum(y), 3) AS sy FROM v_atoms GROUP BY 1")
def v02_added(spark, d):
    """Sites added beside the first atom of each molecule make room by moving; the atoms of the frames, whose places are returned, stay."""
    atoms = A.atoms(spark, d, A.ATOMS_A_TASK // 5)  # chained passes hold the cells of a task several times
    sites = topology.seeded_sites(atoms, 0.5, ("lx", "ly", "lz"))
    placed = [F.pmod(F.col(f"v{a}"), F.col(f"l{a}")).alias(a) for a in "xyz"]
    every = atoms.select("frame_id", "atom_id", "x", "y", "z", "lx", "ly", "lz").unionByName(sites.select("frame_id", (F.col("mol_id") % 250 + 1_000_000).alias("atom_id"), *placed, "lx", "ly", "lz"))
    moved = neighbors.push_added(every, F.col("atom_id") >= 1_000_000, 0.6, passes=4)
    return moved.filter("atom_id < 1000000").groupBy("frame_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("sx"), F.round(F.sum("y"), 3).alias("sy"))
