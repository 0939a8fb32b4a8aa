"""The corpus pipeline: five stages over documents, each on all that the one before it kept."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesospark.llm import decontaminate, linededup, mixing, neardup, toxicity
from mesospark.llm.queries import domain, labelled_domains
from mesospark.plans.lineage import ensure_checkpoint_dir, remove_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts, null ids and repeated rows stay. Other columns go."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model, keep=COLUMNS).filter("predicted = 0").select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines leave the texts; null texts and ids stay as they are, repeated rows are treated alike."""
    clean = linededup.remove_boilerplate(docs.select(COLUMNS))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, one row of a repeated id; null ids, and null and wordless texts of distinct ids, stay."""
    return neardup.keep_one(docs).select(COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are at least a twentieth go; null and wordless texts are clean."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return decontaminate.judged(found).filter("NOT contaminated").select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its rate in the mixture; one with rate 0 leaves it, but for texts without words."""
    mixed = mixing.mix(docs, labelled_domains(spark, sf_dir), domain(), keep=COLUMNS)
    return mixed.select(*COLUMNS, "domain", "tokens", "rate", "expected_tokens")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the classifiers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each result is written to the shared folder and read again.

    A stage's files go once the next stage has been written; those of the last
    but one stay, as the result reads them.
    """
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = f"{base}/{i}-{name}"
        out.write.parquet(path)
        if done:
            remove_folder(spark, done)
        docs, done = spark.read.parquet(path), path
