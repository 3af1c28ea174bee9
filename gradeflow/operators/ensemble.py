"""Averaging the predictions of several models.

Long predictions have one row per ``(student_id, model_id)`` with ``content`` and ``wording``,
or, for single-target models, ``target`` and ``prediction``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.schemas import TARGET_COLUMNS


def ensemble_mean(preds: DataFrame, key: str = "student_id") -> DataFrame:
    """Mean over models of both targets."""
    return preds.groupBy(key).agg(*[F.avg(t).alias(t) for t in TARGET_COLUMNS])


def ensemble_by_target(
    preds: DataFrame, key: str = "student_id", allow_missing: bool = False
) -> DataFrame:
    """Content models average to ``content``, wording models to ``wording``.

    A target without any model is an error unless ``allow_missing``, which leaves it NULL.
    """
    if not allow_missing:
        for target in TARGET_COLUMNS:
            if preds.filter(F.col("target") == target).limit(1).isEmpty():
                raise ValueError(f"no model predicts {target}")
    return preds.groupBy(key).pivot("target", TARGET_COLUMNS).agg(F.avg("prediction"))


def unpack_predictions(df: DataFrame, column: str, prefix: str = "predicted_") -> DataFrame:
    """Split a prediction vector into one named column per target."""
    return df.withColumns(
        {
            prefix + target: F.get(F.col(column), F.lit(i)).cast("double")
            for i, target in enumerate(TARGET_COLUMNS)
        }
    )
