"""Extractive reference summaries of long texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions import text as text_fn

MIN_LENGTH = 56
MAX_LENGTH = 128


def length_gate(
    df: DataFrame, max_length: int = MAX_LENGTH, key: str = "prompt_id", col: str = "prompt_text"
) -> DataFrame:
    """Token count of each text and whether it is short enough to stay as it is."""
    n = F.size(text_fn.matches(F.col(col), text_fn.PLAIN_TOKEN))
    return df.select(key, n.alias("n_tokens")).withColumn(
        "keep_full", F.col("n_tokens") < F.lit(max_length)
    )


def _by_text(texts: DataFrame, key: str, col: str) -> DataFrame:
    """``(key, texts)``: rows that share a key count as one text."""
    return texts.groupBy(key).agg(F.collect_list(col).alias("texts"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a column used in a lambda may be inlined there."""
    return F.transform(F.array(value), body)[0]


def _runs(array: Column, same) -> Column:
    """Where runs of elements for which ``same(element, one before)`` holds begin, and the end of the last."""

    def found(x: Column) -> Column:
        none = F.array().cast("array<int>")
        first = F.filter(
            F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(none),
            lambda i: (i == 0) | ~same(F.get(x, i), F.get(x, i - 1)),
        )
        return F.concat(first, F.array(F.size(x)))

    return _let(array, found)


def _each_run(bounds: Column, body) -> Column:
    """``body(start, length)`` of each run between two ``bounds``.

    A body picks elements by position: ``slice`` would copy the whole array for each run.
    """

    def of(b: Column) -> Column:
        starts = F.slice(b, F.lit(1), F.size(b) - 1)
        return F.transform(starts, lambda start, i: body(start, F.get(b, i + 1) - start))

    return _let(bounds, of)


def _with_chosen(grouped: DataFrame, min_length: int, max_length: int) -> DataFrame:
    """``grouped`` with ``chosen``: the sentences of the summary in their rank order.

    All happens within the row, in arrays as long as its text: words are counted by sorting them,
    and their frequencies meet their sentence by sorting again.  No task holds more than one row, whatever
    its partition does.
    """

    def placed(text: Column) -> Column:
        return F.flatten(
            F.transform(
                text_fn.sentences(text),
                lambda sentence, pos: F.transform(
                    text_fn.matches(F.lower(sentence), text_fn.PLAIN_TOKEN),
                    lambda token: F.struct(token.alias("token"), pos.alias("pos")),
                ),
            )
        )

    words, cells = F.col("words"), F.col("cells")
    counted = (
        grouped.withColumn("words", F.sort_array(F.flatten(F.transform("texts", placed))))
        .withColumn("bounds", _runs(words, lambda x, before: x["token"] == before["token"]))
        # position of the sentence and frequency of the word in one number, which sorts fast
        .withColumn(
            "cells",
            _let(
                words,
                lambda w: F.sort_array(
                    F.flatten(
                        _each_run(
                            F.col("bounds"),
                            lambda start, n: F.transform(
                                F.sequence(start, start + n - 1),
                                lambda i: F.shiftleft(F.get(w, i)["pos"].cast("long"), 32) + n,
                            ),
                        )
                    )
                ),
            ),
        )
    )

    def scored(c: Column, start: Column, n: Column) -> Column:
        frequencies = F.aggregate(
            F.sequence(start, start + n - 1),
            F.lit(0).cast("long"),
            lambda total, i: total + F.get(c, i).bitwiseAND(F.lit((1 << 32) - 1)),
        )
        return F.struct(
            (-(frequencies / n)).alias("minus_score"),
            F.shiftright(F.get(c, start), 32).cast("int").alias("pos"),
            n.cast("long").alias("n_tokens"),
        )

    def every(c: Column) -> Column:
        return _each_run(F.col("bounds"), lambda start, n: scored(c, start, n))

    def taken(ranked: Column) -> Column:
        """Sentences within the limits, with the tokens up to each.  ``ranked`` is bounded."""
        up_to = F.transform(
            ranked,
            lambda x, i: F.struct(
                x["pos"].alias("pos"),
                x["n_tokens"].alias("n_tokens"),
                (-x["minus_score"]).alias("score"),
                (i + 1).alias("rank"),
                F.aggregate(
                    F.slice(ranked, F.lit(1), i + 1),
                    F.lit(0).cast("long"),
                    lambda total, y: total + y["n_tokens"],
                ).alias("running"),
            ),
        )
        return F.filter(
            up_to, lambda x: (x["running"] <= max_length) | (x["running"] - x["n_tokens"] < min_length)
        )

    sentence_bounds = _runs(cells, lambda x, before: F.shiftright(x, 32) == F.shiftright(before, 32))
    # every sentence has a token: none beyond this rank is within the limits
    most = max(min_length, max_length, 1)
    return (
        counted.withColumn("bounds", sentence_bounds)
        .withColumn("ranked", F.slice(F.sort_array(_let(cells, every)), 1, most))
        .withColumn("chosen", _let(F.col("ranked"), taken))
        .drop("words", "bounds", "cells", "ranked")
    )


def rank_sentences(
    texts: DataFrame,
    min_length: int,
    max_length: int,
    key: str,
    col: str,
) -> DataFrame:
    """Sentences chosen for the summary: ``(key, pos, n_tokens, score, rank)``.

    Sentences are ranked by the mean frequency of their words in their own text, earlier ones
    first on ties, and taken in that order while the running token count stays within
    ``max_length`` or was below ``min_length`` before.
    """
    chosen = _with_chosen(_by_text(texts, key, col), min_length, max_length)
    columns = [F.col("x")[name].alias(name) for name in ("pos", "n_tokens", "score", "rank")]
    return text_fn.each(chosen, F.col("chosen"), "x", key).select(key, *columns)


def reference_summary(
    df: DataFrame,
    min_length: int = MIN_LENGTH,
    max_length: int = MAX_LENGTH,
    key: str = "prompt_id",
    col: str = "prompt_text",
    out: str = "reference_summary",
) -> DataFrame:
    """``(key, out)``: the full text when it has fewer than ``max_length`` tokens, otherwise
    its chosen sentences in their original order, one space apart, cut at ``max_length`` tokens.

    Only long texts are moved, once, by key.  ``key`` should be unique: long texts that share one are
    ranked as one text, those without are left out.
    """
    n_tokens = F.size(text_fn.matches(F.col(col), text_fn.PLAIN_TOKEN))
    long = df.filter(n_tokens >= max_length).select(key, col).filter(F.col(key).isNotNull())
    chosen = _with_chosen(_by_text(long, key, col), min_length, max_length)
    in_order = F.sort_array(
        F.transform("chosen", lambda x: F.struct(x["pos"].alias("pos"), x["n_tokens"].alias("n_tokens")))
    )
    # bounded by the limits: every chosen sentence has a token
    def cut(x: Column) -> Column:
        def kept(choice: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(x, F.lit(1), i), F.lit(0).cast("long"), lambda total, y: total + y["n_tokens"])
            keep = F.least(choice["n_tokens"], F.lit(max_length) - before)
            return F.struct(choice["pos"].alias("pos"), keep.alias("keep"), choice["n_tokens"].alias("n_tokens"))

        return F.filter(F.transform(x, kept), lambda choice: choice["keep"] > 0)

    def shown(choice):
        sentence = F.get(F.col("sentences"), choice["pos"])
        start = F.slice(
            text_fn.matches(sentence, text_fn.TOKEN_WITH_GAP), F.lit(1), choice["keep"].cast("int")
        )
        whole = choice["keep"] == choice["n_tokens"]
        return F.trim(F.when(whole, sentence).otherwise(F.array_join(start, "")))

    marked = chosen.withColumn("picked", _let(in_order, cut))
    # a filter on a computed array would compute it again
    texts = F.when(F.size("picked") > 0, F.col("texts"))
    shortened = (
        text_fn.each(marked, texts, "text", key, "picked")
        .withColumn("sentences", text_fn.sentences(F.col("text")))
        .select(key, F.array_join(F.transform("picked", shown), " ").alias(out))
    )
    short = df.filter(F.coalesce(n_tokens < max_length, F.lit(True))).select(
        key, F.col(col).alias(out)
    )
    return short.unionByName(shortened)
