"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "gradeflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and no web page.

    Keyword names use ``__`` for dots, e.g. ``spark__driver__memory="8g"``.
    Shuffle partitions stay at the cluster's setting: adaptive execution
    coalesces small ones, so a large value is safe.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Where that is unset, the folder lies in the warehouse, which
    is shared too; a warehouse on the driver's own disk is an error on a cluster.  The path is
    deleted when the driver's JVM ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{warehouse.rstrip('/')}/gradeflow-scratch"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def checkpointed(spark: SparkSession, df, purpose: str):
    """Cut the lineage of ``df`` by writing it to the shared folder as Parquet."""
    path = scratch_dir(spark, purpose)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def spread(df, tasks: int, *keys: str):
    """Rows dealt out by ``keys`` to ``tasks`` tasks, for files that too few tasks can read.

    A single row group, or a CSV file with line breaks in cells, is read by one task, which would
    also run all the text work of its stage.  The caller knows the files; a large table needs no
    such step.
    """
    return df.repartition(tasks, *keys)
