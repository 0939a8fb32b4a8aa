"""Files of single frames: listing them, frame ids from their names, pairs of configuration and force files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(spark: SparkSession, path: str) -> DataFrame:
    """``name``: names of the files below a folder; of what Spark writes by ``name``, the names of the folders. Nothing is read but the listing."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    folder = F.regexp_extract("path", r"/name=([^/]+)/[^/]*$", 1)
    return found.select(F.when(folder != "", folder).otherwise(F.regexp_extract("path", r"([^/]+)$", 1)).alias("name")).distinct()


def data_frame_id(name: Column) -> Column:
    """The number of ``frame_<n>.data``; null of another name."""
    return F.regexp_extract(name, r"^frame_(\d+)\.data$", 1).try_cast("long")


def force_frame_id(name: Column) -> Column:
    """The one distinct run of digits in a name; none or several are an error."""
    runs = F.array_distinct(F.regexp_extract_all(name, F.lit(r"(\d+)")))
    return F.when(F.size(runs) == 1, F.get(runs, F.lit(0)).cast("long")).otherwise(F.raise_error(F.concat(F.lit("no single number in "), name)))


def paired(data: DataFrame, force: DataFrame) -> DataFrame:
    """``frame_id, data, force``: files (``name``) one to one by frame id.

    Other names than ``frame_<n>.data`` among ``data`` are passed over. A file without its
    partner and two files of one frame are errors.
    """
    one = lambda rows, c: rows.groupBy("frame_id").agg(F.count("*").alias(f"n_{c}"), F.min("name").alias(c))
    left = one(data.select("name", data_frame_id(F.col("name")).alias("frame_id")).filter("frame_id IS NOT NULL"), "data")
    right = one(force.select("name", force_frame_id(F.col("name")).alias("frame_id")), "force")
    met = left.join(right, "frame_id", "full_outer")
    frame = F.col("frame_id").cast("string")
    wrong = (
        F.when(F.col("force").isNull(), F.concat(F.lit("no force file of frame "), frame))
        .when(F.col("data").isNull(), F.concat(F.lit("no data file of frame "), frame))
        .when((F.col("n_data") > 1) | (F.col("n_force") > 1), F.concat(F.lit("several files of frame "), frame))
    )
    return met.select(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("long")).otherwise(F.col("frame_id")).alias("frame_id"), "data", "force")
