"""Cutting lineage in a way that survives the loss of executors."""

import tempfile
from contextlib import suppress

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors, as ``spark.checkpoint.dir`` names it.

    A temporary one is set only where the session names none and all tasks run
    in the driver's machine; a cluster without a shared folder is an error.
    Checkpoints go when ``spark.cleaner.referenceTracking.cleanCheckpoints`` is
    set for the session; files that are written here by path are removed by
    whoever wrote them.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="mesospark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back; iterative jobs call it once a pass."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate files; one that is gone already is no error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    with suppress(PySparkException):
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
