"""Statistics over frames that arrive as files."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mesospark.operators.stats import histogram


def streamed_histogram(spark: SparkSession, folder: str, schema: StructType, state: str, lo: float, hi: float, n: int) -> DataFrame:
    """Histogram of ``key, value, w`` rows of all Parquet files under ``folder``; only new files are read on a later call.

    Counts of a micro-batch are written under its number, so a batch that is
    run again after a failure overwrites its own and is never counted twice.
    """
    partial, done = f"{state}/partial", f"{state}/progress"

    def merge(batch: DataFrame, number: int) -> None:
        histogram(batch, lo, hi, n).write.mode("overwrite").parquet(f"{partial}/batch={number}")

    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    query = rows.writeStream.foreachBatch(merge).option("checkpointLocation", done).trigger(availableNow=True).queryName(f"h{uuid.uuid4().hex}").start()
    query.awaitTermination()
    counts = spark.read.schema("key string, bin int, count double, n long").option("recursiveFileLookup", "true").parquet(partial)
    return counts.groupBy("key", "bin").agg(F.sum("count").alias("count"), F.sum("n").alias("n"))


def streamed_frame_histogram(spark: SparkSession, folder: str, schema: StructType, state: str, lo: float, hi: float, n: int) -> DataFrame:
    """As ``streamed_histogram``, of rows ``frame_id, key, value, w``, where a frame that comes again replaces what it was.

    A file holds whole frames. Counts are kept by frame under the number of the
    micro-batch; of a frame that several files of one batch hold, the last written
    file counts (by time, then by name), and of several batches the last batch.
    Frames never seen again cost their bins once.
    """
    partial, done = f"{state}/partial", f"{state}/progress"

    def merge(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("frame_id").agg(F.max("_from").alias("_newest"))
        rows = batch.join(newest, "frame_id").filter(F.col("_from") == F.col("_newest"))
        found = histogram(rows, lo, hi, n, by=("frame_id", "key"))
        # a frame without a counted value still replaces its old counts
        seen = newest.select("frame_id", F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("bin"), F.lit(0.0).alias("count"), F.lit(0).cast("long").alias("n"))
        found.unionByName(seen).write.mode("overwrite").parquet(f"{partial}/batch={number}")

    origin = F.struct("_metadata.file_modification_time", "_metadata.file_path").alias("_from")
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder).select("*", origin)
    query = rows.writeStream.foreachBatch(merge).option("checkpointLocation", done).trigger(availableNow=True).queryName(f"h{uuid.uuid4().hex}").start()
    query.awaitTermination()
    counts = spark.read.schema("frame_id long, key string, bin int, count double, n long, batch long").parquet(partial)
    newest = counts.groupBy("frame_id").agg(F.max("batch").alias("batch"))
    return counts.filter("key IS NOT NULL").join(newest, ["frame_id", "batch"]).groupBy("key", "bin").agg(F.sum("count").alias("count"), F.sum("n").alias("n"))
