"""Weighted running means of logged values.

A log has the columns ``run_id, epoch, step, metric, val, n``: a batch mean and its size.
``step`` counts from 1 over all epochs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_STEPS = 8192


def weighted_mean(logs: DataFrame, by: list[str]) -> DataFrame:
    """``sum(val * n) / sum(n)`` per group."""
    return logs.groupBy(*by).agg(
        (F.sum(F.col("val") * F.col("n")) / F.sum("n")).alias("avg"), F.sum("n").alias("n")
    )


def running_meter(logs: DataFrame, log_interval: int | None = None) -> DataFrame:
    """Running weighted mean, reset at each epoch and after every ``log_interval`` steps.

    Without an interval the mean runs over the whole epoch.  Such an epoch is summed in blocks
    of steps first, so no task has to hold or sort a whole epoch.
    """
    group = ["run_id", "metric", "epoch"]
    span = log_interval if log_interval is not None else BLOCK_STEPS
    if span < 1:
        raise ValueError("log_interval must be at least 1")
    blocked = logs.withColumn("block", F.floor((F.col("step") - 1) / F.lit(span)))
    up_to_here = (
        Window.partitionBy(*group, "block")
        .orderBy("step")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    total = F.sum(F.col("val") * F.col("n")).over(up_to_here)
    count = F.sum("n").over(up_to_here)
    if log_interval is not None:
        return blocked.withColumn("running", total / count).drop("block")
    earlier = (
        Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        blocked.groupBy(*group, "block")
        .agg(F.sum(F.col("val") * F.col("n")).alias("block_sum"), F.sum("n").alias("block_n"))
        .select(
            *group,
            "block",
            F.coalesce(F.sum("block_sum").over(earlier), F.lit(0.0)).alias("start_sum"),
            F.coalesce(F.sum("block_n").over(earlier), F.lit(0)).alias("start_n"),
        )
    )
    parts = blocked.withColumn("part_sum", total).withColumn("part_n", count)
    # missing run, metric or epoch ids are groups like any other
    same = [parts[c].eqNullSafe(starts[c]) for c in [*group, "block"]]
    return (
        parts.join(starts, same)
        .withColumn(
            "running",
            (F.col("start_sum") + F.col("part_sum")) / (F.col("start_n") + F.col("part_n")),
        )
        .select(*[parts[c] for c in logs.columns], "running")
    )


def interval_log(logs: DataFrame, log_interval: int) -> DataFrame:
    """Only the values at the end of each full interval; a trailing part is never logged."""
    return running_meter(logs, log_interval).filter(F.col("step") % F.lit(log_interval) == 0)
