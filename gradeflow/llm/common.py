"""Column helpers and joins shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.session import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of at most a few dozen bytes that one broadcast may hold.
BROADCAST_ROWS = 1_000_000


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else unchanged (``lower`` is the quicker form for pure ASCII)."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def positions(count: Column, step: int = 1) -> Column:
    """0, step, 2 * step, ... below ``count``; an empty array for none."""
    none = F.array().cast("array<int>")
    return F.when(count > 0, F.sequence(F.lit(0), count - 1, F.lit(step))).otherwise(none)


def broadcast_if_small(narrow: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``narrow`` with a broadcast hint if it is counted to hold at most ``rows`` rows.

    For tables of fixed-width columns only, where the count bounds the bytes.  Beyond it the join
    carries no hint and shuffles; its rows are the same.
    """
    return F.broadcast(narrow) if narrow.limit(rows + 1).count() <= rows else narrow


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, root the smallest node reachable.

    Alternates large-star and small-star steps, each a join with per-node minima, and writes the
    edges to the shared folder after each round.  The rounds grow with the logarithm of the longest
    path.  Edges may repeat or be loops; a node with loops only is left out.
    """
    spark = edges.sparkSession
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    stars = checkpointed(
        spark,
        edges.filter(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct(),
        "edges",
    )
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .filter("a != b")
            .distinct()
        )
        stars = checkpointed(spark, small, "edges")
        roots = stars.select(F.col("b").alias("a")).distinct()
        chained = stars.join(roots, "a", "left_semi").select("a")
        shared = stars.groupBy("a").count().filter("count > 1").select("a")
        if not chained.unionByName(shared).limit(1).count():
            break
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
