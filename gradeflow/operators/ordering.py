"""A reproducible row order without a global sort.

Rows are ordered by ``md5("seed:key")``.  The first four hex digits cut that order into at
most 65,536 consecutive buckets of nearly equal size whatever the data look like, so windows
run per bucket and only a table of at most 65,536 bucket rows is ever looked at as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.session import checkpointed

BUCKET_DIGITS = 4  # 16**4 = 65,536 buckets: the size bound of every broadcast below
HASH, BUCKET = "order_hash", "order_bucket"
# A row's number holds its partition above so many bits and its place in it below.
PLACE, PLACE_BITS = "order_place", 33


def order_hash(df: DataFrame, key: str, seed: int | str):
    """The hash of the seed and the key; rows without a key are told apart by all their columns."""
    own = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))
    rest = F.concat(F.lit(f"{seed}::"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("string"))
    return F.md5(F.coalesce(own, rest))


def with_order(df: DataFrame, key: str, seed: int | str) -> DataFrame:
    """Add the order hash and its bucket."""
    return df.withColumn(HASH, order_hash(df, key, seed)).withColumn(
        BUCKET, F.substring(HASH, 1, BUCKET_DIGITS)
    )


def with_position(df: DataFrame, key: str, seed: int | str, out: str = "position") -> DataFrame:
    """Add the 0-based global position of each row in hash order."""
    ordered = with_order(df, key, seed)
    within = Window.partitionBy(BUCKET).orderBy(HASH, key)
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy(BUCKET)
        .agg(F.count("*").alias("bucket_rows"))
        # at most 65,536 rows from here on
        .select(BUCKET, F.coalesce(F.sum("bucket_rows").over(before), F.lit(0)).alias("bucket_start"))
    )
    return (
        ordered.withColumn("bucket_row", F.row_number().over(within))
        .join(F.broadcast(offsets), BUCKET)
        .withColumn(out, F.col("bucket_start") + F.col("bucket_row") - 1)
        .drop(HASH, BUCKET, "bucket_row", "bucket_start")
    )


def with_successor(
    df: DataFrame, key: str, seed: int | str, columns: list[str], out: str = "second"
) -> DataFrame:
    """Add a struct of the next row's ``columns``; the last row is followed by the first.

    The order is one cycle over all rows, hence a permutation.
    """
    ordered = with_order(df, key, seed)
    within = Window.partitionBy(BUCKET).orderBy(HASH, key)
    side = F.struct(*[F.col(c) for c in columns])
    heads = ordered.groupBy(BUCKET).agg(
        F.min_by(side, F.struct(F.col(HASH), F.col(key))).alias("head")
    )
    # at most 65,536 rows from here on
    across = Window.orderBy(BUCKET)
    everywhere = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = heads.select(
        BUCKET,
        F.coalesce(F.lead("head").over(across), F.first("head").over(everywhere)).alias("next_head"),
    )
    return (
        ordered.withColumn("in_bucket", F.lead(side).over(within))
        .join(F.broadcast(following), BUCKET)
        .withColumn(out, F.coalesce("in_bucket", "next_head"))
        .drop(HASH, BUCKET, "in_bucket", "next_head")
    )


def sample_n(df: DataFrame, key: str, n: int, seed: int | str = 0) -> DataFrame:
    """``n`` rows chosen by hash order: the same rows whatever the partition layout."""
    return df.orderBy(order_hash(df, key, seed), F.col(key)).limit(n)


def with_rank(df: DataFrame, *order: Column, out: str = "rank") -> DataFrame:
    """Add the 1-based rank of each row in ``order``, exactly, with no task that sees all rows.

    Rows are dealt into ranges of the order, sorted there and written to the shared folder with the number
    of their range and their place in it; the rows of all ranges before are added as a prefix sum over
    one row per range.  Rows that are equal in ``order`` take ranks of their own in some order.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = checkpointed(df.sparkSession, ranged.withColumn(PLACE, F.monotonically_increasing_id()), "ranked")
    part, inside = F.shiftright(PLACE, PLACE_BITS), F.col(PLACE).bitwiseAND((1 << PLACE_BITS) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy(part.alias("part"))
        .agg(F.count("*").alias("rows"))
        # a row per range from here on
        .select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    )
    numbered = stored.withColumn("part", part).join(F.broadcast(offsets), "part")
    return numbered.withColumn(out, F.col("start") + inside + 1).select(*df.columns, out)
