"""Writers for predictions, metric logs and model coefficients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.schemas import COEFFICIENTS, METRIC_LOG

STRATEGIES = ("all", "last")
# Bytes of coefficients that may be written as single files.
MODEL_FILE_BYTES = 128 << 20


def write_predictions(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> None:
    """Write a submission or out-of-fold table as a folder of part files."""
    if fmt not in ("parquet", "csv"):
        raise ValueError("fmt must be 'parquet' or 'csv'")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.parquet(path)
    else:
        writer.csv(
            path,
            header=True,
            quote='"',
            escape='"',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )


def append_metrics(df: DataFrame, path: str) -> None:
    """Append metric rows ``run_id, epoch, step, metric, value`` to the log table."""
    rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in METRIC_LOG])
    rows.write.mode("append").partitionBy("run_id").parquet(path)


def read_metrics(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    log = spark.read.schema(METRIC_LOG).parquet(path).select(*METRIC_LOG.names)
    return log if run_id is None else log.filter(F.col("run_id") == run_id)


def metric_rows(df: DataFrame, run_id: str, epoch: int, step: int) -> DataFrame:
    """One-row metrics as log rows, one per metric."""
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns]
    return df.select(
        F.lit(run_id).alias("run_id"),
        F.lit(epoch).alias("epoch"),
        F.lit(step).cast("long").alias("step"),
        F.inline(F.array(*pairs)),
    )


def coefficients_long(models: DataFrame) -> DataFrame:
    """Model rows as ``fold, target, feature, weight``; feature -1 is the intercept."""
    weights = models.select("fold", "target", F.posexplode("weights").alias("feature", "weight"))
    intercepts = models.select(
        "fold", "target", F.lit(-1).alias("feature"), F.col("intercept").alias("weight")
    )
    return intercepts.unionByName(weights)


def coefficients_wide(coefficients: DataFrame) -> DataFrame:
    """The inverse of :func:`coefficients_long`."""
    # one item per feature of one model
    item = F.when(F.col("feature") >= 0, F.struct("feature", "weight"))
    return (
        coefficients.groupBy("fold", "target")
        .agg(
            F.max(F.when(F.col("feature") < 0, F.col("weight"))).alias("intercept"),
            F.array_sort(F.collect_list(item)).alias("items"),
        )
        .select("fold", "target", "intercept", F.col("items.weight").alias("weights"))
    )


def save_models(
    models: DataFrame, path: str, run_id: str, name: str, epoch: int = 1, strategy: str = "last"
) -> None:
    """Write a model table as coefficients, partitioned by fold.

    ``all`` keeps every epoch.  ``last`` keeps one: it replaces what the run wrote before for
    the same folds.  ``/`` in the model name becomes ``_``.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    model = name.replace("/", "_")
    rows = coefficients_long(models).select(
        F.lit(run_id).alias("run_id"),
        F.lit(model).alias("model"),
        F.lit(epoch).alias("epoch"),
        "target",
        F.col("feature").cast("int").alias("feature"),
        "weight",
        "fold",
    )
    folder = f"{path.rstrip('/')}/{run_id}-{model}"
    if strategy == "all":
        folder = f"{folder}-epoch{epoch}"
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("fold")
        .parquet(folder)
    )


def load_models(spark: SparkSession, folder: str) -> DataFrame:
    """Read a model table back; a missing or mistyped column is an error."""
    # fold ids may look like numbers, so the partition column needs the fixed schema
    found = {f.name: f.dataType for f in spark.read.parquet(folder).schema}
    wrong = [
        f.name
        for f in COEFFICIENTS
        if f.name != "fold" and found.get(f.name) != f.dataType or f.name not in found
    ]
    if wrong:
        raise ValueError(f"{folder} is not a coefficient table: check {wrong}")
    return coefficients_wide(spark.read.schema(COEFFICIENTS).parquet(folder))


def load_runs(spark: SparkSession, directory: str) -> DataFrame:
    """The models of all runs that ``save_models`` wrote below ``directory``, with their ``run``.

    Only the names of the run folders are listed, one per saved model.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    listing = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    folders = sorted(s.getPath().toString() for s in listing if s.isDirectory())
    if not folders:
        raise FileNotFoundError(f"no saved models below {directory}")
    runs = [load_models(spark, f).withColumn("run", F.lit(f.rstrip("/").rsplit("/", 1)[-1])) for f in folders]
    whole = runs[0]
    for run in runs[1:]:
        whole = whole.unionByName(run)
    return whole


def write_model_files(
    models: DataFrame, directory: str, run_id: str, model: str, epoch: int | None = None, by_target: bool = False
) -> None:
    """One ``.bin`` file per fold, or per fold and target, named as :func:`catalog.model_catalog` reads it.

    A file holds its models as JSON.  Files are as many as folds and are written one by one through
    the store's own file system; coefficients beyond ``MODEL_FILE_BYTES`` in all belong into a table
    (:func:`save_models`) and are an error.
    """
    size = models.agg(F.sum(F.size("weights") * 24 + 100).alias("bytes")).first()["bytes"] or 0
    if size > MODEL_FILE_BYTES:
        raise ValueError(f"models of {size} bytes exceed {MODEL_FILE_BYTES}: save them as a table")
    spark = models.sparkSession
    one = F.struct("target", "n", "intercept", "weights")
    kinds = ["fold", "target"] if by_target else ["fold"]
    # a file's models
    files = models.groupBy(*kinds).agg(F.to_json(F.sort_array(F.collect_list(one))).alias("content")).collect()
    names = spark._jvm.org.apache.hadoop.fs.Path
    for row in files:
        name = f"{model}_{row.target}" if by_target else model
        ending = "" if epoch is None else f"-epoch{epoch}"
        path = names(f"{directory.rstrip('/')}/{run_id}-{name.replace('/', '_')}-{row.fold}{ending}.bin")
        stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            stream.write(bytearray(row.content.encode()))
        finally:
            stream.close()
