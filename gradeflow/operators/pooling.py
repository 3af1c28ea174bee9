"""Pooling of long vector tables.

Input: one row per position with a group key, ``pos``, ``mask`` (0 or 1) and ``embedding``.
Cells are summed per task before the shuffle, so a group holding a third of all rows sends
one partial value per dimension and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions import vectors

# Floors and fill of the pooling formulas.
MEAN_FLOOR = 1e-9
MAX_FILL = -1e-9
GEM_FLOOR = 1e-6

POOLERS = ("mean", "max", "gemtext", "context")


def _cell_aggregate(name: str, p: float, fill: float) -> Column:
    value, mask = F.col("value").cast("double"), F.col("mask").cast("double")
    if name == "mean":
        return F.sum(value * mask) / F.greatest(F.sum(mask), F.lit(MEAN_FLOOR))
    if name == "max":
        return F.max(F.when(mask == 0, F.lit(fill)).otherwise(value))
    clamped = F.greatest(value, F.lit(GEM_FLOOR)) * mask
    return F.pow(
        F.sum(F.pow(clamped, F.lit(float(p)))) / F.greatest(F.sum(mask), F.lit(GEM_FLOOR)),
        F.lit(1.0 / p),
    )


def pool(
    df: DataFrame,
    name: str = "mean",
    group: str = "group",
    p: float = 3.0,
    fill: float = MAX_FILL,
    out: str = "pooled",
) -> DataFrame:
    """One vector per group: ``mean``, ``max``, ``gemtext`` or ``context`` (first position).

    ``max`` gives masked cells the value ``fill``, so it is not ignored where all unmasked
    values are smaller.  ``gemtext`` is the generalised mean of order ``p``.
    """
    if name not in POOLERS:
        raise ValueError(f"unknown pooler {name!r}; choose one of {POOLERS}")
    if name == "context":
        first = F.min_by("embedding", "pos").cast("array<double>")
        return df.groupBy(group).agg(first.alias(out))
    cells = df.select(group, "mask", F.posexplode("embedding").alias("dim", "value"))
    pooled = cells.groupBy(group, "dim").agg(_cell_aggregate(name, p, fill).alias("value"))
    # one item per dimension
    items = F.array_sort(F.collect_list(F.struct("dim", "value")))
    return pooled.groupBy(group).agg(items.alias("items")).select(group, F.col("items.value").alias(out))


def attend(
    df: DataFrame,
    score_weights: Sequence[float],
    matrix: Sequence[Sequence[float]] | None = None,
    group: str = "group",
    masked: bool = False,
    out: str = "embedding",
) -> DataFrame:
    """Scale each position's vector by its softmax weight within the group.

    The score is ``V . tanh(W h)`` with ``V = score_weights`` and ``W = matrix`` (identity when
    left out).  Padding takes part unless ``masked``.  Adds ``attention``.

    Scores are summed per group and integer score level first; levels combine without
    overflow, a hot group is spread over its levels, and no window holds a whole group.
    """
    hidden = F.col("embedding")
    if matrix is not None:
        hidden = vectors.matrix_times(matrix, hidden)
    score = vectors.dot(
        F.transform(hidden, lambda x: F.tanh(x.cast("double"))), vectors.literal(score_weights)
    )
    scored = df.withColumn("score", score).withColumn("level", F.floor("score"))
    if masked:
        counted = scored.filter(F.col("mask") != 0)
    else:
        counted = scored
    levels = counted.groupBy(group, "level").agg(
        F.sum(F.exp(F.col("score") - F.col("level"))).alias("part")
    )
    peaks = levels.groupBy(group).agg(
        F.max("level").alias("peak"), F.collect_list(F.struct("level", "part")).alias("parts")
    )
    totals = peaks.select(
        group,
        "peak",
        F.aggregate(
            "parts",
            F.lit(0.0),
            lambda acc, x: acc + x["part"] * F.exp((x["level"] - F.col("peak")).cast("double")),
        ).alias("total"),
    )
    weight = F.exp(F.col("score") - F.col("peak")) / F.col("total")
    if masked:
        weight = F.when(F.col("mask") == 0, F.lit(0.0)).otherwise(weight)
    # groups that are masked throughout have no total and weights of 0; a missing group is one group
    totals = totals.withColumnRenamed(group, "of_group")
    return (
        scored.join(totals, scored[group].eqNullSafe(totals["of_group"]), "left")
        .withColumn("attention", weight)
        .withColumn(
            out, F.transform("embedding", lambda x: x.cast("double") * F.col("attention"))
        )
        .drop("score", "level", "peak", "total", "of_group")
    )
