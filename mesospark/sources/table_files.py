"""Potential-table text files: sections of a keyword, a line of parameters and numbered rows of x, energy and force."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def write_tables(tables: DataFrame, path: str) -> None:
    """One section for each ``key`` of ``key, i, x, v, f``, in folders by key; the rows of one table make one text.

    Dihedral tables are in degrees and say so.
    """
    row = F.concat_ws(" ", (F.col("i") + 1).cast("string"), *[F.col(c).cast("string") for c in ("x", "v", "f")]).alias("line")
    per = tables.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", row))).alias("rows"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    numbered = F.transform("rows", lambda r, k: F.concat(k + 1, F.lit(" "), F.regexp_replace(r["line"], r"^\S+ ", "")))
    ends = F.concat_ws(" ", F.lit("R"), F.col("lo").cast("string"), F.col("hi").cast("string"))
    tail = F.when(F.col("key").startswith("dihedral"), "NOF DEGREES").otherwise(ends)
    text = F.concat_ws("\n", F.lit("# table"), F.regexp_replace("key", ":", "_"), F.concat(F.lit("N "), F.size("rows"), F.lit(" "), tail), F.lit(""), F.array_join(numbered, "\n"))
    per.select("key", text.alias("value")).write.partitionBy("key").text(path)


def _checked(condition: Column, message: str, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.raise_error(F.concat(F.lit(message + " in "), F.coalesce(F.col("keyword"), F.lit("?")))))


def load_tables(spark: SparkSession, path: str) -> DataFrame:
    """``keyword, i, x, v, f`` (and ``key`` where folders name it) of every section of every file.

    Files are read whole, one row each. Rows number 1 to N, as the parameters
    say. A dihedral table that does not say DEGREES is in radians and is
    converted: coordinates to degrees, forces to energy a degree. A keyword twice in
    a file, another number of rows, rows of other than four fields, a number that
    is not finite and coordinates that do not rise are errors.
    """
    files = spark.read.text(path, wholetext=True)
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))), lambda x: x != "")
    starts = F.filter(F.transform("lines", lambda x, k: F.when(x.rlike("^[A-Za-z_]"), k)), lambda k: k.isNotNull())
    # a keyword line is followed by a line of parameters, which begins with a letter too
    heads = F.filter(F.col("starts"), lambda k: F.coalesce(F.try_element_at("lines", k + 2).rlike(r"^N\s+\d+"), F.lit(False)))
    found = files.select(*[c for c in files.columns if c != "value"], lines.alias("lines")).withColumn("starts", starts).withColumn("heads", heads)
    keywords = F.transform("heads", lambda k: F.split(F.element_at("lines", k + 1), r"\s+")[0])
    once = F.when(F.size(F.array_distinct(keywords)) == F.size(keywords), F.col("heads")).otherwise(F.raise_error(F.lit("a keyword occurs twice in one file")))
    sections = found.select("*", F.posexplode(once).alias("nth", "at")).withColumn("end", F.coalesce(F.try_element_at("heads", F.col("nth") + 2), F.size("lines")))
    sections = sections.withColumns({"keyword": F.split(F.element_at("lines", F.col("at") + 1), r"\s+")[0], "parameters": F.element_at("lines", F.col("at") + 2), "rows": F.expr("slice(lines, at + 3, greatest(end - at - 2, 0))")})
    sections = sections.withColumn("rows", _checked(F.size("rows") == F.regexp_extract("parameters", r"^N\s+(\d+)", 1).cast("int"), "another number of rows", F.col("rows")))
    key = [F.col("key")] if "key" in files.columns else []
    row = sections.select(*key, "keyword", "parameters", F.posexplode("rows").alias("i", "line"))
    row = row.withColumn("v4", _checked(F.col("line").rlike(rf"^\d+(\s+{_NUMBER}){{3}}$"), "a row that is not four numbers", F.split("line", r"\s+")))
    radians = (F.col("key") if key else F.col("keyword")).startswith("dihedral") & ~F.col("parameters").contains("DEGREES")
    x, v, f = (F.col("v4")[k].cast("double") for k in (1, 2, 3))
    out = row.select(*key, "keyword", "i", F.when(radians, F.degrees(x)).otherwise(x).alias("x"), v.alias("v"), F.when(radians, F.radians(f)).otherwise(f).alias("f"))
    before = F.lag("x").over(W.partitionBy(*[c for c in ("key",) if key], "keyword").orderBy("i"))
    return out.withColumn("x", _checked(F.coalesce(F.col("x") > before, F.lit(True)), "coordinates that do not rise", F.col("x")))
