"""Leave-one-prompt-out folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL = "all"


def folds(df: DataFrame, key: str = "prompt_id") -> DataFrame:
    """The distinct fold ids."""
    return df.select(F.col(key).alias("fold")).distinct()


def fold_split(
    df: DataFrame, fold: str, key: str = "prompt_id", check: bool = True
) -> tuple[DataFrame, DataFrame | None]:
    """Training and validation rows of one fold; ``"all"`` trains on every row.

    Rows without a fold id are trained on and never validated.
    """
    if fold == ALL:
        return df, None
    held_out = F.col(key).eqNullSafe(F.lit(fold))
    valid = df.filter(F.col(key) == F.lit(fold))
    if check and valid.limit(1).isEmpty():
        raise ValueError(f"{fold!r} is not a fold of this table")
    return df.filter(~held_out), valid


def fold_frames(df: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Rows per fold and role, for all folds in one pass.

    A row validates its own fold and trains every other one, so the training size is the
    total minus the fold; the rows-times-folds table is never built.
    """
    sizes = df.groupBy(F.col(key).alias("fold")).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).scalar()
    return (
        sizes.filter(F.col("fold").isNotNull())
        .withColumn("total", total)
        .select(
            "fold",
            F.explode(
                F.array(
                    F.struct(F.lit("train").alias("role"), (F.col("total") - F.col("n")).alias("n_rows")),
                    F.struct(F.lit("valid").alias("role"), F.col("n").alias("n_rows")),
                )
            ).alias("part"),
        )
        .select("fold", "part.role", "part.n_rows")
    )


def union_folds(frames: list[DataFrame]) -> DataFrame:
    """One table from per-fold prediction tables, matched by column name."""
    if not frames:
        raise ValueError("no frames to union")
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result
