"""Dump-text trajectories: blocks of TIMESTEP, NUMBER OF ATOMS, BOX BOUNDS and ATOMS with one line an atom."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_START = "ITEM: TIMESTEP\n"


def read_dump(spark: SparkSession, path: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """``timestep, n_atoms, lx, ly, lz, id, type, x, y, z`` and the named extra columns as text, one row an atom.

    The record separator makes one row a frame, so a file is split between
    tasks at frames. Columns are found by the ATOMS header, coordinates as x,
    xu or xs (scaled). A block with too few lines is an error.
    """
    blocks = spark.read.option("lineSep", _START).text(path).filter(F.length(F.trim("value")) > 0)
    lines = F.split(F.regexp_replace("value", "\n+$", ""), "\n")
    edge = lambda k: F.split(F.col("lines")[4 + k], " ")
    head = blocks.select(lines.alias("lines")).select(
        F.col("lines")[0].cast("long").alias("timestep"), F.col("lines")[2].cast("long").alias("n_atoms"),
        *[edge(k)[0].cast("double").alias(f"lo{k}") for k in range(3)], *[(edge(k)[1].cast("double") - edge(k)[0].cast("double")).alias(f"l{a}") for k, a in enumerate("xyz")],
        F.split(F.regexp_replace(F.col("lines")[7], "^ITEM: ATOMS ", ""), " +").alias("header"), F.slice("lines", 9, F.size("lines")).alias("rows"),
    )
    whole = F.when(F.size("rows") == F.col("n_atoms"), F.col("rows")).otherwise(F.raise_error(F.concat(F.lit("short block at timestep "), F.col("timestep").cast("string"))))
    atoms = head.withColumn("row", F.explode(whole)).withColumn("v", F.split("row", " +"))
    field = lambda name: F.try_element_at("v", F.nullif(F.array_position("header", name), F.lit(0)).cast("int"))
    place = lambda a, k: F.coalesce(field(a).cast("double"), field(f"{a}u").cast("double"), field(f"{a}s").cast("double") * F.col(f"l{a}") + F.col(f"lo{k}"))
    return atoms.select("timestep", "n_atoms", "lx", "ly", "lz", field("id").cast("long").alias("id"), field("type").alias("type"), *[place(a, k).alias(a) for k, a in enumerate("xyz")], *[field(c).alias(c) for c in extra])


def typed(column):
    """Text as a whole number, else a double, else itself: a struct of which one field is set."""
    whole, real = column.try_cast("bigint"), column.try_cast("double")
    return F.struct(whole.alias("i"), F.when(whole.isNull(), real).alias("d"), F.when(real.isNull(), column).alias("s"))


def write_dump(atoms: DataFrame, path: str, columns: tuple[str, ...] = ()) -> None:
    """One block a frame, in id order within it; a frame's text is made in one row, as the format needs."""
    names = ["id", "type", "xu", "yu", "zu", *columns]
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("atom_id", "type", "x", "y", "z", *columns)])
    per = atoms.groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("atom_id", line.alias("l")))).alias("rows"), *[F.first(f"l{a}").alias(f"l{a}") for a in "xyz"])
    bounds = F.concat_ws("\n", *[F.concat(F.lit("0.0 "), F.col(f"l{a}").cast("string")) for a in "xyz"])
    block = F.concat_ws("\n", F.concat(F.lit(_START), F.col("frame_id").cast("string")), F.lit("ITEM: NUMBER OF ATOMS"), F.size("rows").cast("string"), F.lit("ITEM: BOX BOUNDS pp pp pp"), bounds, F.lit("ITEM: ATOMS " + " ".join(names)), F.array_join(F.transform("rows", lambda r: r["l"]), "\n"))
    per.select(block.alias("value")).write.mode("overwrite").text(path)
