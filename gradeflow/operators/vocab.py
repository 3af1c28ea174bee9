"""Vocabulary, encoding and vocabulary features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeflow.functions import text as text_fn
from gradeflow.operators.ordering import with_rank
from gradeflow.schemas import TAGS
from gradeflow.session import checkpointed

# Reserved ids; the tags follow in their table order, words come after them.
RESERVED = {"pad": 0, "unk": 1, "cls": 2, "sep": 3}
FIRST_TAG_ID = 4
FIRST_WORD_ID = 9
# The most words that may travel as one value; more are an error there.
TABLE_WORDS = 100_000
HOW = ("table", "join")


def tokenise(df: DataFrame, col: str = "input_text", out: str = "tokens") -> DataFrame:
    """Add the lower-case tokens of a text as an array; NULL stays NULL."""
    return df.withColumn(out, text_fn.tokens(F.col(col)))


def token_frequencies(df: DataFrame, col: str = "tokens") -> DataFrame:
    """Occurrences of each token; a hot token is summed before the shuffle."""
    return text_fn.each(df, F.col(col), "token").groupBy("token").agg(F.count("*").alias("n"))


def heavy_hitters(df: DataFrame, counters: int, col: str = "tokens") -> tuple[DataFrame, int]:
    """``(token, low)`` and ``error``: a token occurs at least ``low`` and at most ``low + error`` times.

    Each task keeps at most ``2 * counters`` counts.  When they are full, the count of rank
    ``counters`` is taken off all and what falls to 0 goes; what was taken off is the task's error.
    Summaries of tasks add up, so no token that is not listed occurs more than ``error`` times, and
    ``error`` is at most the number of tokens divided by ``counters``.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        error = 0
        for batch in batches:
            column = batch.column(0).flatten()
            for start in range(0, len(column), counters):
                for cell in pc.value_counts(column.slice(start, counters)).to_pylist():
                    if cell["values"] is not None:
                        counts[cell["values"]] = counts.get(cell["values"], 0) + cell["counts"]
                if len(counts) > counters:
                    cut = sorted(counts.values(), reverse=True)[counters]
                    counts = {token: n - cut for token, n in counts.items() if n > cut}
                    error += cut
        tokens = pa.array([*counts, None], pa.string())
        yield pa.RecordBatch.from_arrays([tokens, pa.array([*counts.values(), error], pa.int64())], ["token", "low"])

    parts = df.select(col).mapInArrow(summarise, "token string, low long")
    merged = checkpointed(df.sparkSession, parts.groupBy("token").agg(F.sum("low").alias("low")), "heavy-hitters")
    error = merged.filter(F.col("token").isNull()).select("low").first()
    return merged.filter(F.col("token").isNotNull()), error["low"] if error else 0


def _possible(df: DataFrame, size: int, counters: int, col: str) -> DataFrame | None:
    """Tokens that may be among the ``size`` most frequent words, or NULL if the summary cannot tell.

    At least ``size`` words occur as often as the word of that rank in the summary, so a token
    whose most is below cannot be among them.
    """
    listed, error = heavy_hitters(df, counters, col)
    words = listed.filter(~F.col("token").isin(list(TAGS.values())))
    last = words.orderBy(F.desc("low")).limit(size).agg(F.count("*").alias("n"), F.min("low").alias("low")).first()
    if last["n"] < size or error >= last["low"]:
        return None
    return words.filter(F.col("low") + error >= last["low"]).select("token")


def _ranked_words(spark: SparkSession, words: DataFrame, size: int) -> DataFrame:
    counts = checkpointed(spark, words, "token-counts")
    power = F.length(F.bin("n"))  # a row per power of two below
    reached, cut = 0, 0
    for row in sorted(counts.groupBy(power.alias("power")).count().collect(), key=lambda r: -r["power"]):
        reached, cut = reached + row["count"], row["power"]
        if reached >= size:
            break
    ranked = with_rank(counts.filter(power >= cut), F.desc("n"), F.col("token"))
    return ranked.filter(F.col("rank") <= size)


def build_vocab(
    df: DataFrame, size: int, col: str = "tokens", how: str = "top", counters: int | None = None
) -> DataFrame:
    """The ``size`` most frequent words as ``(token, id, n)``; ties go to the smaller word.

    With ``how="top"`` the chosen words are ranked in one task, which must hold ``size`` of them.  With
    ``how="ranked"`` words below a power of two that enough words reach are left out and the rest are ranked
    in ranges (:func:`ordering.with_rank`), so no task needs more for a larger ``size``.  With ``counters``
    a first pass summarises the tokens (:func:`heavy_hitters`) and only those that may be chosen are counted;
    where the summary is too coarse to tell, all are.  All ways give the same rows.
    """
    if how not in ("top", "ranked"):
        raise ValueError("how must be 'top' or 'ranked'")
    tokens = text_fn.each(df, F.col(col), "token").filter(~F.col("token").isin(list(TAGS.values())))
    possible = None if counters is None else _possible(df, size, counters, col)
    if possible is not None:
        tokens = tokens.join(possible, "token", "left_semi")
    words = tokens.groupBy("token").agg(F.count("*").alias("n"))
    if how == "ranked":
        top = _ranked_words(df.sparkSession, words, size)
    else:
        top = words.orderBy(F.desc("n"), "token").limit(size)
        # the limit has left one partition of ``size`` rows
        top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "token")))
    return top.select("token", (F.col("rank") + F.lit(FIRST_WORD_ID - 1)).cast("int").alias("id"), "n")


def _with_tags(vocab: DataFrame) -> DataFrame:
    """Vocabulary and tags as ``(token, id)``."""
    tags = [(tag, FIRST_TAG_ID + i) for i, tag in enumerate(TAGS.values())]
    rows = vocab.sparkSession.createDataFrame(tags, "token string, id int")
    return vocab.select("token", F.col("id").cast("int").alias("id")).unionByName(rows)


def _slot(token: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(slots)).cast("int")


def _word_table(words: DataFrame, slots: int) -> Column:
    """All words in one value: an array of small maps, addressed by the hash of the word.

    The words are counted in the plan; too many are an error, not another way of working.
    """
    filled = words.groupBy(_slot(F.col("token"), slots).alias("slot")).agg(
        F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("words")
    )
    none = F.create_map().cast("map<string,int>")
    every = words.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    table = every.join(filled, "slot", "left").select(
        "slot", F.coalesce("words", none).alias("words")
    )
    by_slot = F.array_sort(
        F.collect_list(F.struct("slot", "words")), lambda a, b: a["slot"] - b["slot"]
    )
    n_words = F.sum(F.size("words"))
    too_many = F.raise_error(F.lit(f"more than {TABLE_WORDS} words: use how='join'"))
    return table.agg(
        F.when(n_words <= TABLE_WORDS + len(TAGS), by_slot["words"])
        .otherwise(too_many.cast("array<map<string,int>>"))
        .alias("word_table")
    ).scalar()


def _ids_by_table(df: DataFrame, vocab: DataFrame, kept: Column, slots: int = 8192) -> DataFrame:
    """Look tokens up inside their row: no explode, no shuffle."""
    table = _word_table(_with_tags(vocab), slots)

    def token_id(token: Column) -> Column:
        words = F.get(F.col("word_table"), _slot(token, slots))
        return F.coalesce(F.try_element_at(words, token), F.lit(RESERVED["unk"]))

    return df.withColumn("word_table", table).withColumn("body", F.transform(kept, token_id))


def _ids_by_join(
    df: DataFrame, vocab: DataFrame, key: str, carry: Sequence[str], kept: Column
) -> DataFrame:
    """Look tokens up by a join and gather them again, for vocabularies of any size.

    Rows are told apart by a number of their own, so keys may repeat or be NULL.
    """
    words = _with_tags(vocab).withColumnRenamed("id", "word_id")
    columns = [key, *carry]
    numbered = df.select(
        F.monotonically_increasing_id().alias("row_number"), F.struct(*columns).alias("kept"), kept.alias("body")
    )
    tokens = numbered.select("row_number", "kept", F.posexplode_outer("body").alias("pos", "token"))
    token_id = F.coalesce(F.col("word_id"), F.lit(RESERVED["unk"]))
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", token_id.alias("id")))
    # at most max_length items per row
    gathered = (
        tokens.join(words, "token", "left")
        .groupBy("row_number")
        .agg(F.first("kept").alias("kept"), F.array_sort(F.collect_list(item)).alias("items"))
    )
    return gathered.select(*[F.col("kept")[c].alias(c) for c in columns], F.col("items.id").alias("body"))


def encode(
    df: DataFrame,
    vocab: DataFrame,
    max_length: int,
    how: str = "table",
    key: str = "student_id",
    col: str = "tokens",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Token ids with start and end markers, cut at the tail to ``max_length`` in all.

    Gives ``key``, the ``carry`` columns, ``input_ids`` and ``attention_mask`` (ones).

    With ``how="table"`` the vocabulary, at most ``TABLE_WORDS`` words, travels to the rows as one
    value and every row is encoded where it stands.  With ``how="join"`` tokens are joined with a
    vocabulary of any size.  Both give the same rows.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    if max_length < 2:
        raise ValueError("max_length must leave room for the two markers")
    kept = F.slice(F.col(col), 1, max_length - 2)
    if how == "table":
        looked_up = _ids_by_table(df, vocab, kept)
    else:
        looked_up = _ids_by_join(df, vocab, key, carry, kept)
    body = F.coalesce(F.col("body"), F.array().cast("array<int>"))
    ids = F.concat(F.array(F.lit(RESERVED["cls"])), body, F.array(F.lit(RESERVED["sep"])))
    return looked_up.select(key, *carry, ids.alias("input_ids")).withColumn(
        "attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))
    )


def vocab_features(
    df: DataFrame,
    vocab: DataFrame,
    key: str = "student_id",
    col: str = "tokens",
) -> DataFrame:
    """Bag of vocabulary words in long form: ``(key, id, n)``.

    Each text sends one row per distinct word.  The join carries no hint: Spark knows the size
    of a vocabulary cut by ``build_vocab`` and broadcasts it while that is below its threshold.
    """
    counted = text_fn.each(df, F.col(col), "token", key).groupBy(key, "token").agg(F.count("*").alias("n_here"))
    return (
        counted.join(vocab.select("token", "id"), "token")
        .groupBy(key, "id")
        .agg(F.sum("n_here").alias("n"))
    )


def dense_features(
    bags: DataFrame, size: int, key: str = "student_id", out: str = "features"
) -> DataFrame:
    """Bag-of-words rows as arrays of ``size`` doubles for a small vocabulary."""
    # at most ``size`` entries per row
    entries = F.map_from_entries(F.collect_list(F.struct("id", "n")))
    at = F.sequence(F.lit(FIRST_WORD_ID), F.lit(FIRST_WORD_ID + size - 1))
    return (
        bags.groupBy(key)
        .agg(entries.alias("entries"))
        .select(
            key,
            F.transform(
                at, lambda i: F.coalesce(F.try_element_at(F.col("entries"), i), F.lit(0)).cast("double")
            ).alias(out),
        )
    )
