"""A live weighted-mean meter per event-time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_meter(
    events: DataFrame,
    window: str = "1 day",
    delay: str = "1 hour",
    by: Sequence[str] = ("metric",),
    time: str = "ts",
) -> DataFrame:
    """Weighted mean of ``val`` by ``n`` per window and key.

    Rows later than ``delay`` behind the newest event may be dropped, which bounds the state to
    the windows still open.  A time column without a zone is read in the session's zone.
    """
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    return (
        stamped.withWatermark(time, delay)
        .groupBy(F.window(time, window), *by)
        .agg(F.sum(F.col("val") * F.col("n")).alias("total"), F.sum("n").alias("n"))
        .select(
            F.col("window.start").alias("window_start"),
            *by,
            (F.col("total") / F.col("n")).alias("avg"),
            "n",
        )
    )


def write_meter(
    meter: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write the windows that changed in each batch to ``path/batch_id=<n>``.

    ``trigger`` is that of Spark, e.g. ``{"processingTime": "1 minute"}``; without it the stream
    ends once it has read what is there.

    A batch that is run again after a failure overwrites its own folder, so every change is
    kept exactly once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        meter.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def read_meter(
    spark: SparkSession, path: str, by: Sequence[str] = ("metric",)
) -> DataFrame:
    """The newest value of each window."""
    versions = spark.read.parquet(path)
    return (
        versions.groupBy("window_start", *by)
        .agg(F.max_by(F.struct("avg", "n"), "batch_id").alias("newest"))
        .select("window_start", *by, "newest.avg", "newest.n")
    )
