"""Catalogue of model files by fold, target and epoch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: file names are <run>-<model>-<fold>[-epoch<n>].bin
NAME = r"^([^-]+)-(.+?)-([^-]+?)(?:-epoch(\d+))?\.bin$"


def model_catalog(spark: SparkSession, directory: str) -> DataFrame:
    """``path, file, run_id, model, fold, target, epoch`` of every ``*.bin`` file.

    Only the listing is read, never the contents.  Everything is taken from the file's own
    name, so a directory called like a fold does not match.
    """
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(directory)
    file = F.element_at(F.split("path", "/"), -1)

    def part(i: int):
        found = F.regexp_extract("file", NAME, i)
        return F.when(found != "", found)

    kind = (
        F.when(F.col("file").contains("content"), "content")
        .when(F.col("file").contains("wording"), "wording")
    )
    return listing.select("path").withColumn("file", file).select(
        "path",
        "file",
        part(1).alias("run_id"),
        part(2).alias("model"),
        part(3).alias("fold"),
        kind.alias("target"),
        part(4).cast("int").alias("epoch"),
    )


def resolve_model(catalog: DataFrame, folds: DataFrame | Sequence[str]) -> DataFrame:
    """One file per fold, the first by path; a fold without a file is an error."""
    if not isinstance(folds, DataFrame):
        folds = catalog.sparkSession.createDataFrame([(f,) for f in folds], "fold string")
    first = catalog.groupBy("fold").agg(F.min_by(F.struct("path", "file"), "path").alias("chosen"))
    found = folds.select("fold").distinct().join(first, "fold", "left")
    absent = [r.fold for r in found.filter(F.col("chosen").isNull()).select("fold").limit(5).collect()]
    if absent:
        raise FileNotFoundError(f"no model file for folds such as {absent}")
    return found.select("fold", "chosen.path", "chosen.file")


def single_target_models(catalog: DataFrame) -> DataFrame:
    """The catalogue, provided every file name says ``content`` or ``wording``."""
    if not catalog.filter(F.col("target").isNull()).limit(1).isEmpty():
        raise ValueError("every model file name must contain 'content' or 'wording'")
    return catalog


def read_model_files(files: DataFrame, directory: str, fold: str | None = None) -> DataFrame:
    """The model table held by the listed files, as :func:`sinks.write_model_files` writes them.

    Contents are read by Spark, so the store may be one that only Spark reaches.  With ``fold`` only
    files whose name holds it are listed at all.
    """
    glob = "*.bin" if fold is None else f"*-{fold}*.bin"
    contents = files.sparkSession.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
    held = "array<struct<target:string,n:long,intercept:double,weights:array<double>>>"
    return (
        contents.select("path", "content")
        .join(files.select("path", "fold"), "path")
        .select("fold", F.inline(F.from_json(F.col("content").cast("string"), held)))
    )
