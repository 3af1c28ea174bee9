"""The driver's tables seen as prompts, responses, logs and vectors.

``documents`` are responses to the prompt named by ``source``, ``labels`` hold their targets,
``benchmark`` holds the prompts, ``embeddings`` are token vectors grouped by ``label`` and
``events`` are batches of logged values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.session import spread

TITLE = r"^\S+(?:\s+\S+){0,2}"
QUESTION = r"^[^.!?\n]+[.!?]*"
STEP_EVENTS = 32
EPOCH_STEPS = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("src"), F.col("item_id").cast("string")).alias("prompt_id"),
        F.regexp_extract(text, TITLE, 0).alias("prompt_title"),
        F.regexp_extract(text, QUESTION, 0).alias("prompt_question"),
        text.alias("prompt_text"),
    )


def dealt(documents: DataFrame, sf_dir: str, key: str) -> DataFrame:
    """Documents of fewer bytes than a megabyte per task are read by too few tasks: deal them out."""
    spark = documents.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    tasks = 2 * spark.sparkContext.defaultParallelism
    return spread(documents, tasks, key) if size < tasks << 20 else documents


def as_responses(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("string").alias("student_id"),
        F.col("source").alias("prompt_id"),
        "text",
    )


def all_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, without targets."""
    return as_responses(table(spark, sf_dir, "documents"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, spread over the cores for work on whole texts."""
    return dealt(all_responses(spark, sf_dir), sf_dir, "student_id")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("student_id"),
        F.col("quality").cast("double").alias("content"),
        F.col("toxic").cast("double").alias("wording"),
    )


def train_responses(spark: SparkSession, sf_dir: str, whole_texts: bool = False) -> DataFrame:
    """Labelled documents, spread over the cores when their whole texts are worked on."""
    documents = table(spark, sf_dir, "documents")
    if whole_texts:
        documents = dealt(documents, sf_dir, "doc_id")
    labels = table(spark, sf_dir, "labels").select(
        "doc_id",
        F.col("quality").cast("double").alias("content"),
        F.col("toxic").cast("double").alias("wording"),
    )
    return documents.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("student_id"),
        F.col("source").alias("prompt_id"),
        "text",
        "content",
        "wording",
    )


def test_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label."""
    documents = table(spark, sf_dir, "documents")
    return as_responses(documents.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("group"),
        F.col("vec_id").alias("pos"),
        F.when(F.col("vec_id") % 5 != 0, 1).otherwise(0).alias("mask"),
        "embedding",
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in batches of 32, logged as batch mean and size."""
    step = (F.floor(F.col("event_id") / STEP_EVENTS) + 1).cast("long")
    return (
        table(spark, sf_dir, "events")
        .groupBy(step.alias("step"))
        .agg(F.avg("value").alias("val"), F.count("*").alias("n"))
        .select(
            F.lit("events").alias("run_id"),
            (F.floor((F.col("step") - 1) / EPOCH_STEPS) + 1).cast("int").alias("epoch"),
            "step",
            F.lit("value").alias("metric"),
            "val",
            "n",
        )
    )
