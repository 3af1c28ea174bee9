"""Mini-batches and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.operators.ordering import with_position

PAD_ID = 0


def assign_batches(
    df: DataFrame,
    size: int,
    key: str = "student_id",
    seed: int | None = None,
    epoch: int = 0,
    out: str = "batch_id",
) -> DataFrame:
    """Number the rows' batches of ``size`` rows; only the last batch may be short.

    With a seed the order changes with every epoch.  Without one it is the same in each
    epoch; a distributed table has no input order to keep, so that too is a hash order.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    order = "fixed" if seed is None else f"{seed}:{epoch}"
    return with_position(df, key, order).withColumn(
        out, F.floor(F.col("position") / F.lit(size)).cast("long")
    )


def _padded(ids: Column, length: Column, fill: int) -> Column:
    missing = F.greatest(length - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(fill), missing))


def pad_to(df: DataFrame, length: Column) -> DataFrame:
    """Pad ``input_ids`` with the pad id and ``attention_mask`` with zeros."""
    return df.withColumns(
        {
            "input_ids": _padded(F.col("input_ids"), length, PAD_ID),
            "attention_mask": _padded(F.col("attention_mask"), length, 0),
        }
    )


def pad_static(df: DataFrame, max_length: int) -> DataFrame:
    """Pad every row to ``max_length``."""
    return pad_to(df, F.lit(max_length))


def pad_dynamic(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Pad every row to the longest row of its batch (added as ``padded_length``)."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    return pad_to(df.withColumn("padded_length", longest), F.col("padded_length"))
