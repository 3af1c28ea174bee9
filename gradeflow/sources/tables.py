"""Readers with fixed schemas for prompts, responses and predictions.

CSV cells may hold line breaks and doubled quotes, which makes a CSV file unsplittable; keep
large tables as Parquet (``fmt="parquet"``), which is read with the same functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeflow.schemas import NA_TOKENS, PREDICTIONS, PROMPTS, RESPONSES_TEST, RESPONSES_TRAIN

SPLITS = ("train", "test")


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Read ``path`` with a fixed schema.

    In CSV, numeric cells that hold one of the missing-value tokens become NULL and any other
    text there is an error; text cells keep such tokens as text.
    """
    if fmt == "parquet":
        found = spark.read.parquet(path)
        return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    if fmt != "csv":
        raise ValueError("fmt must be 'csv' or 'parquet'")
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = _by_header(spark, path)
    missing = [name for name in as_text.names if name not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {missing}")

    def cell(field: T.StructField):
        value = F.col(f"`{field.name}`")
        if not isinstance(field.dataType, T.StringType):
            value = F.when(~F.trim(value).isin(NA_TOKENS), value).cast(field.dataType)
        return value.alias(field.name)

    return raw.select(*[cell(f) for f in schema])


def _by_header(spark: SparkSession, path: str) -> DataFrame:
    """The CSV files of ``path`` with their columns taken by name, file by file.

    Files are grouped by their first line; each group, one as a rule, is read with its own header,
    which Spark checks.  A record with too many or too few cells is an error.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    heads = (
        spark.read.text(path, wholetext=False)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
        .withColumn("line", F.monotonically_increasing_id())
        .filter(F.col("at") == 0)
        .groupBy("file")
        .agg(F.min_by("value", "line").alias("head"))
    )
    groups = heads.groupBy("head").agg(F.collect_list("file").alias("files")).orderBy("head").collect()
    parts = [
        spark.read.csv(
            sorted(group.files), header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=False
        )
        for group in groups
    ]
    if not parts:
        raise FileNotFoundError(f"no rows below {path}: {files.count()} files")
    if any(set(part.columns) != set(parts[0].columns) for part in parts):
        raise ValueError(f"the files of {path} do not have the same columns")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _split_path(directory: str, table: str, split: str, fmt: str) -> str:
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    return f"{directory.rstrip('/')}/{table}_{split}.{fmt}"


def read_prompts(spark: SparkSession, directory: str, split: str, fmt: str = "csv") -> DataFrame:
    """``prompts_<split>``: one row per prompt."""
    return read_table(spark, _split_path(directory, "prompts", split, fmt), PROMPTS, fmt)


def read_responses(spark: SparkSession, directory: str, split: str, fmt: str = "csv") -> DataFrame:
    """``summaries_<split>``: one row per response; targets in the training split only."""
    schema = RESPONSES_TRAIN if split == "train" else RESPONSES_TEST
    return read_table(spark, _split_path(directory, "summaries", split, fmt), schema, fmt)


def read_predictions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Out-of-fold predictions as written by ``write_predictions``."""
    return read_table(spark, path, PREDICTIONS, fmt)
