"""RMSE-type scores as aggregate Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeflow.schemas import target_columns

NAN_POLICIES = ("skip", "propagate")


def squared_error(y: Column | str, p: Column | str, nan_policy: str = "skip") -> Column:
    """Squared error of one row.

    ``skip``: NULL or NaN on either side leaves the row out of that target's mean.
    ``propagate``: either makes the mean NaN.
    """
    if nan_policy not in NAN_POLICIES:
        raise ValueError(f"nan_policy must be one of {NAN_POLICIES}")
    y = F.col(y) if isinstance(y, str) else y
    p = F.col(p) if isinstance(p, str) else p
    error = (y - p).cast("double")
    square = error * error
    if nan_policy == "skip":
        return F.nanvl(square, F.lit(None).cast("double"))
    return F.coalesce(square, F.lit(float("nan")))


def rmse(y: Column | str, p: Column | str, nan_policy: str = "skip") -> Column:
    return F.sqrt(F.avg(squared_error(y, p, nan_policy)))


def mcrmse(nan_policy: str = "skip") -> dict[str, Column]:
    """Mean of the two targets' RMSE, with both components, in one pass."""
    content = rmse("content", "predicted_content", nan_policy)
    wording = rmse("wording", "predicted_wording", nan_policy)
    return {
        "MCRMSE": (content + wording) / 2,
        "ContentRMSE": content,
        "WordingRMSE": wording,
    }


def eval_metrics(target: str, nan_policy: str = "propagate") -> dict[str, Column]:
    """Metrics for a target choice: RMSE for one target, MCRMSE for both."""
    columns = target_columns(target)
    if len(columns) == 2:
        return mcrmse(nan_policy)
    return {"RMSE": rmse(columns[0], f"predicted_{columns[0]}", nan_policy)}
