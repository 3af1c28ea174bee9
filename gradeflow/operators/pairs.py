"""Seeded pairing of rows for ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.operators.ordering import with_successor


def present(column: str) -> Column:
    value = F.col(column).cast("double")
    return value.isNotNull() & ~F.isnan(value)


def pair_rows(
    df: DataFrame,
    key: str = "student_id",
    targets: Sequence[str] = ("content", "wording"),
    seed: int | str = 666,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Pair each row with another so that every row is once first and once second.

    Labels are the sign of the target difference: 1, 0 or -1 per target.  Rows whose target
    is missing take no part.  ``carry`` names further *scalar* columns to bring along; attach
    texts or token arrays afterwards with :func:`attach_sides`.
    """
    usable = df
    for target in targets:
        usable = usable.filter(present(target))
    columns = [key, *targets, *carry]
    paired = with_successor(usable.select(*columns), key, seed, columns)
    return paired.select(
        *[F.col(c).alias(f"first_{c}") for c in columns],
        *[F.col(f"second.{c}").alias(f"second_{c}") for c in columns],
        *[
            F.signum(F.col(t).cast("double") - F.col(f"second.{t}").cast("double"))
            .cast("int")
            .alias(f"label_{t}")
            for t in targets
        ],
    )


def attach_sides(
    pairs: DataFrame, df: DataFrame, columns: Sequence[str], key: str = "student_id"
) -> DataFrame:
    """Add ``columns`` of ``df`` to both sides of the pairs by key."""
    result = pairs
    for side in ("first", "second"):
        names = [F.col(key).alias(f"{side}_{key}")]
        names += [F.col(c).alias(f"{side}_{c}") for c in columns]
        result = result.join(df.select(*names), f"{side}_{key}")
    return result
