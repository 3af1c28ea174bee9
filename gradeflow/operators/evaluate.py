"""Scores per fold, macro over folds and pooled."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.functions import metrics
from gradeflow.schemas import TARGET_COLUMNS, target_columns

SCORES = ["MCRMSE", "ContentRMSE", "WordingRMSE"]


def _statistics(df: DataFrame, key: str, nan_policy: str) -> DataFrame:
    """Row count, squared-error sums and their counts per fold: all that scores need."""
    errors = {
        t: metrics.squared_error(t, f"predicted_{t}", nan_policy) for t in TARGET_COLUMNS
    }
    sums = [F.sum(e).alias(f"{t}_sum") for t, e in errors.items()]
    counts = [F.count(e).alias(f"{t}_n") for t, e in errors.items()]
    return df.groupBy(F.col(key).alias("fold")).agg(F.count("*").alias("n_rows"), *sums, *counts)


def _with_scores(stats: DataFrame) -> DataFrame:
    for target in TARGET_COLUMNS:
        stats = stats.withColumn(
            f"{target.capitalize()}RMSE",
            F.sqrt(F.try_divide(F.col(f"{target}_sum"), F.col(f"{target}_n"))),
        )
    parts = [F.col(f"{t.capitalize()}RMSE") for t in TARGET_COLUMNS]
    return stats.withColumn("MCRMSE", reduce(add, parts) / len(parts))


def fold_scores(df: DataFrame, key: str = "prompt_id", nan_policy: str = "skip") -> DataFrame:
    """MCRMSE and its two parts for each fold."""
    return _with_scores(_statistics(df, key, nan_policy)).select("fold", "n_rows", *SCORES)


def cv_score(df: DataFrame, key: str = "prompt_id", nan_policy: str = "skip") -> DataFrame:
    """Unweighted mean of the fold scores; rows without a fold id have no fold."""
    per_fold = fold_scores(df, key, nan_policy).filter(F.col("fold").isNotNull())
    return per_fold.agg(F.count("*").alias("n_folds"), *[F.avg(s).alias(s) for s in SCORES])


def oof_score(df: DataFrame, nan_policy: str = "skip") -> DataFrame:
    """Scores pooled over all rows."""
    columns = metrics.mcrmse(nan_policy)
    return df.agg(F.count("*").alias("n_rows"), *[c.alias(n) for n, c in columns.items()])


def score_report(df: DataFrame, key: str = "prompt_id", nan_policy: str = "skip") -> DataFrame:
    """Fold, macro and pooled scores in one table (``level`` is fold, cv or oof).

    The data are reduced once to one row of statistics per fold; the roll-up that derives
    the other two levels sees only those rows.
    """
    return report_from_statistics(_statistics(df, key, nan_policy))


def report_from_statistics(statistics: DataFrame) -> DataFrame:
    """The report of rows ``fold, n_rows`` and, per target, ``<target>_sum`` of squared errors and
    their number ``<target>_n``, as ``fit.line_statistics`` derives them from sums."""
    per_fold = _with_scores(statistics).withColumn("member", F.col("fold"))
    in_fold = F.col("member").isNotNull()
    sums = [
        F.sum(f"{t}_{part}").alias(f"{t}_{part}") for t in TARGET_COLUMNS for part in ("sum", "n")
    ]
    macro = [F.avg(F.when(in_fold, F.col(s))).alias(f"macro_{s}") for s in SCORES]
    rolled = _with_scores(
        per_fold.rollup("fold").agg(
            F.grouping("fold").alias("is_total"), F.sum("n_rows").alias("n_rows"), *sums, *macro
        )
    )

    def row(level: str, prefix: str = ""):
        return F.struct(
            F.lit(level).alias("level"),
            *[F.col(prefix + s).alias(s) for s in SCORES],
        )

    levels = F.when(
        F.col("is_total") == 1, F.array(row("cv", "macro_"), row("oof"))
    ).otherwise(F.array(row("fold")))
    return rolled.select("fold", "n_rows", F.explode(levels).alias("score")).select(
        "score.level", "fold", "n_rows", *[f"score.{s}" for s in SCORES]
    )


def evaluate(
    df: DataFrame, target: str = "both", nan_policy: str = "propagate", prefix: str = "eval_"
) -> DataFrame:
    """One row of metrics for a validation frame with predicted columns."""
    target_columns(target)
    columns = metrics.eval_metrics(target, nan_policy)
    return df.agg(*[c.alias(prefix + n) for n, c in columns.items()])
