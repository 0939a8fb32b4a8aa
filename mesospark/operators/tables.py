"""Potential tables ``key, i, x, f``: integrals, slopes, equilibria, lookups."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _by():
    return W.partitionBy("key").orderBy("x")


def integrated(tables: DataFrame) -> DataFrame:
    """Adds ``v``: the reverse cumulative trapezoid of the force, 0 at the last point."""
    step = (F.lead("x").over(_by()) - F.col("x")) * (F.lead("f").over(_by()) + F.col("f")) / 2
    stepped = tables.withColumn("_s", F.coalesce(step, F.lit(0.0)))
    return stepped.withColumn("v", F.sum("_s").over(W.partitionBy("key").orderBy(F.desc("x")).rowsBetween(W.unboundedPreceding, 0))).drop("_s")


def slopes(tables: DataFrame, value: str = "f") -> DataFrame:
    """Adds ``slope``: central differences inside, one-sided at the ends."""
    low, high = F.coalesce(F.lag("x").over(_by()), F.col("x")), F.coalesce(F.lead("x").over(_by()), F.col("x"))
    a, b = F.coalesce(F.lag(value).over(_by()), F.col(value)), F.coalesce(F.lead(value).over(_by()), F.col(value))
    return tables.withColumn("slope", (b - a) / F.nullif(high - low, F.lit(0.0)))


def equilibrium(tables: DataFrame) -> DataFrame:
    """``key, x0``: vertex of the parabola through the least v and its neighbours if it lies between them, else the grid point."""
    v = integrated(tables)
    near = v.withColumns({"xl": F.lag("x").over(_by()), "xr": F.lead("x").over(_by()), "vl": F.lag("v").over(_by()), "vr": F.lead("v").over(_by())})
    best = near.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy("v", "x"))).filter("rank = 1")
    p, q = (F.col("x") - F.col("xl")), (F.col("x") - F.col("xr"))
    top = p * p * (F.col("v") - F.col("vr")) - q * q * (F.col("v") - F.col("vl"))
    vertex = F.col("x") - top / F.nullif(2 * (p * (F.col("v") - F.col("vr")) - q * (F.col("v") - F.col("vl"))), F.lit(0.0))
    return best.select("key", F.when((vertex >= F.col("xl")) & (vertex <= F.col("xr")), vertex).otherwise(F.col("x")).alias("x0"))


def on_grid(tables: DataFrame, n: int) -> DataFrame:
    """``key, i, x, f, v``: tables (with ``v``) at n even points between their ends, linear between their knots."""
    ends = tables.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    points = ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    x = F.when(F.col("i") == n - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (n - 1))
    found = lookup_uneven(points.select("key", "i", x.alias("x")), tables)
    return found.select("key", "i", "x", F.col("force").alias("f"), F.col("energy").alias("v"))


def manifest(tables: DataFrame) -> DataFrame:
    """``key, lo, hi, n, eq, slope_lo, slope_hi``: range, points, equilibrium and, of bonds and angles, the slopes of the force at both ends.

    A table of one point has no slopes; an empty table has no row.
    """
    sloped = slopes(tables)
    ends = sloped.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"), F.min_by("slope", "x").alias("slope_lo"), F.max_by("slope", "x").alias("slope_hi"))
    bonded = F.substring_index("key", ":", 1).isin("bond", "angle")
    return ends.join(equilibrium(tables), "key").select("key", "lo", "hi", "n", F.col("x0").alias("eq"), *[F.when(bonded, F.col(c)).alias(c) for c in ("slope_lo", "slope_hi")])


def trimmed(tables: DataFrame, style: str) -> DataFrame:
    """From the first positive force on; for bonds to the last negative one; everything where there is none."""
    marks = tables.groupBy("key").agg(F.min(F.when(F.col("f") > 0, F.col("x"))).alias("lo"), F.max(F.when(F.col("f") < 0, F.col("x"))).alias("hi"))
    keep = F.col("x") >= F.coalesce("lo", F.lit(float("-inf")))
    keep = keep & (F.col("x") <= F.coalesce("hi", F.lit(float("inf")))) if style == "bond" else keep
    return tables.join(marks, "key").filter(keep).drop("lo", "hi")


def lookup(points: DataFrame, tables: DataFrame, lo: float, step: float) -> DataFrame:
    """Linear interpolation of f and v at ``x`` of points (``key, x, ...``) on a uniform grid, by an equi-join on (key, cell).

    Outside the grid the end force holds and the energy goes on linearly.
    """
    by = _by()
    grid = tables.withColumns({"x1": F.lead("x").over(by), "f1": F.lead("f").over(by), "v1": F.lead("v").over(by), "cell": (F.row_number().over(by) - 1).cast("long")}).filter("x1 IS NOT NULL")
    grid = grid.withColumn("last", F.max("cell").over(W.partitionBy("key")))
    last = grid.groupBy("key").agg(F.max("cell").alias("last"))
    placed = points.join(last, "key").withColumn("cell", F.greatest(F.lit(0), F.least(F.col("last"), F.floor((F.col("x") - lo) / step))).cast("long")).drop("last")
    joined = placed.join(grid.withColumnRenamed("x", "x0").drop("last", "i"), ["key", "cell"])
    t = (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0"))
    mix = lambda a, b: F.col(a) + t * (F.col(b) - F.col(a))
    force = F.when(t < 0, F.col("f")).when(t > 1, F.col("f1")).otherwise(mix("f", "f1"))
    energy = F.when(t < 0, F.col("v") - F.col("f") * (F.col("x") - F.col("x0"))).when(t > 1, F.col("v1") - F.col("f1") * (F.col("x") - F.col("x1"))).otherwise(mix("v", "v1"))
    return joined.select(*points.columns, force.alias("force"), energy.alias("energy"))


def _cells(tables: DataFrame) -> DataFrame:
    """``key, cell``: intervals between neighbouring knots with their ends, the first reaching down without end."""
    by = _by()
    grid = tables.withColumns({"x1": F.lead("x").over(by), "f1": F.lead("f").over(by), "v1": F.lead("v").over(by), "nth": F.row_number().over(by)}).filter("x1 IS NOT NULL")
    return grid.select("key", F.struct("x", "x1", "f", "f1", "v", "v1").alias("cell"), F.when(F.col("nth") == 1, F.lit(float("-inf"))).otherwise(F.col("x")).alias("at"))


def lookup_uneven(points: DataFrame, tables: DataFrame, salts: int = 8) -> DataFrame:
    """As ``lookup``, on knots at any distances: each point meets the last knot at or before it.

    The range of a key is dealt into as many even stretches as it has knots, and
    these to a few salts. Points and knots of a stretch, and the last knot before it, are
    sorted together, and each point takes what was carried to it, so no key of any size is one
    task. Needs two knots a key; points of other keys and without x are left out.
    """
    ends = tables.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("knots")).filter("knots > 1 AND hi > lo")
    stretch = lambda x: F.greatest(F.lit(0), F.least(F.col("knots") - 1, F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("knots")))).cast("long")
    # a cell belongs to every stretch that it overlaps, where it comes before all that begins later
    last = F.when(F.col("cell.x1") == F.col("hi"), F.col("knots") - 1).otherwise(stretch(F.col("cell.x1")))
    cells = _cells(tables).join(ends, "key").withColumn("stretch", F.explode(F.sequence(F.when(F.col("at") > F.col("lo"), stretch(F.col("at"))).otherwise(F.lit(0)).cast("long"), last)))
    cells = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int").alias("salt")
    placed = points.filter("NOT isnan(x) AND x IS NOT NULL").select("key", F.struct(*points.columns).alias("point"), F.col("x").alias("at"), salt).join(ends, "key")
    rows = placed.select("key", stretch(F.col("at")).alias("stretch"), "salt", "at", "point", F.lit(None).cast(cells.schema["cell"].dataType).alias("cell"))
    rows = rows.unionByName(cells.select("key", "stretch", "salt", "at", "cell"), allowMissingColumns=True)
    before = W.partitionBy("key", "stretch", "salt").orderBy("at", F.col("point").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    met = rows.withColumn("cell", F.last("cell", ignorenulls=True).over(before)).filter("point IS NOT NULL")
    x, c = F.col("point.x"), {n: F.col(f"cell.{n}") for n in ("x", "x1", "f", "f1", "v", "v1")}
    t = (x - c["x"]) / (c["x1"] - c["x"])
    force = F.when(t < 0, c["f"]).when(t > 1, c["f1"]).otherwise(c["f"] + t * (c["f1"] - c["f"]))
    energy = F.when(t < 0, c["v"] - c["f"] * (x - c["x"])).when(t > 1, c["v1"] - c["f1"] * (x - c["x1"])).otherwise(c["v"] + t * (c["v1"] - c["v"]))
    return met.select("point.*", force.alias("force"), energy.alias("energy"))


def compared_on_overlap(one: DataFrame, two: DataFrame, n: int = 2000) -> DataFrame:
    """``key, df, dv, shift``: tables (``key, x, f, v``) of any grids on n even points of their common range.

    df and dv are the largest differences of force and energy, shift is how far
    the equilibria on those points are apart. Tables without a common range are an error;
    keys that only one side has are left out.
    """
    span = lambda t, s: t.groupBy("key").agg(F.min("x").alias(f"lo{s}"), F.max("x").alias(f"hi{s}"))
    both = span(one, 1).join(span(two, 2), "key").select("key", F.greatest("lo1", "lo2").alias("lo"), F.least("hi1", "hi2").alias("hi"))
    lo = F.when(F.col("hi") <= F.col("lo"), F.raise_error(F.concat(F.lit("tables have no range in common: "), "key"))).otherwise(F.col("lo"))
    grid = both.select("key", lo.alias("lo"), "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("key", "i", F.when(F.col("i") == n - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (n - 1)).alias("x"))
    at = lambda t: lookup_uneven(grid, t).select("key", "i", "x", F.col("force").alias("f"), F.col("energy").alias("v"))
    first, second = at(one), at(two)
    met = first.join(second.select("key", "i", F.col("f").alias("g"), F.col("v").alias("u")), ["key", "i"])
    apart = met.groupBy("key").agg(F.max(F.abs(F.col("g") - F.col("f"))).alias("df"), F.max(F.abs(F.col("u") - F.col("v"))).alias("dv"))
    rest = [equilibrium(t.select("key", "x", "f")).withColumnRenamed("x0", name) for t, name in ((first, "e1"), (second, "e2"))]
    return apart.join(rest[0], "key").join(rest[1], "key").select("key", "df", "dv", F.abs(F.col("e2") - F.col("e1")).alias("shift"))


def harmonic_fit(tables: DataFrame) -> DataFrame:
    """``key, r0, k``: equilibrium and max(-dF/dx / 2, 0) at the nearest inner grid point, else 1."""
    sloped = slopes(tables).withColumns({"p": F.lag("x").over(_by()), "n": F.lead("x").over(_by())}).filter("p IS NOT NULL AND n IS NOT NULL")
    e = equilibrium(tables)
    near = sloped.join(e, "key").groupBy("key").agg(F.min_by("slope", F.struct(F.abs(F.col("x") - F.col("x0")), "x")).alias("s"))
    return e.join(near, "key", "left").select("key", F.col("x0").alias("r0"), F.when(F.col("s").isNull(), 1.0).otherwise(F.greatest(-F.col("s") / 2, F.lit(0.0))).alias("k"))


def compared(one: DataFrame, two: DataFrame) -> DataFrame:
    """``key, df, dv``: the largest differences of force and energy of tables (``key, i, f, v``) on their common grid; none in common is an error."""
    met = one.join(two.select("key", "i", F.col("f").alias("g"), F.col("v").alias("u")), ["key", "i"], "left")
    out = met.groupBy("key").agg(F.count("g").alias("n"), F.max(F.abs(F.col("g") - F.col("f"))).alias("df"), F.max(F.abs(F.col("u") - F.col("v"))).alias("dv"))
    return out.select("key", F.when(F.col("n") == 0, F.raise_error(F.concat(F.lit("tables have no point in common: "), "key"))).otherwise(F.col("df")).alias("df"), "dv")


def with_tail(tables: DataFrame, points: int) -> DataFrame:
    """``key, x, f``: tables with so many points after the last, at the median step and the last force."""
    steps = tables.withColumn("dx", F.lead("x").over(_by()) - F.col("x")).groupBy("key")
    ends = steps.agg(F.percentile("dx", F.lit(0.5)).alias("step"), F.max("x").alias("top"), F.max_by("f", "x").alias("f"))
    tail = ends.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(points)))).select("key", (F.col("top") + F.col("step") * F.col("k")).alias("x"), "f")
    return tables.select("key", "x", "f").union(tail)
