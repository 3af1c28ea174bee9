"""Corpus-driven spelling correction.

Words seen at least ``k`` times form the dictionary.  Any other word is corrected to the most
frequent dictionary word one edit away (insertion, deletion, substitution or swap of two
neighbours), if there is one.

A word with a letter removed, or with two neighbours swapped, *is* the dictionary word or is not
one: a plain lookup.  For the other two edits the words share a *pattern*: both have the same letters
around one blanked position (substitution), or the dictionary word without one letter is the word
(insertion).  The dictionary is reduced to its best word per pattern before that join, so each word
meets at most one partner per pattern and no group of similar words is ever paired with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions import text as text_fn

SALTS = 8
#: Frequent words whose hashes one broadcast may hold.
FREQUENT_WORDS = 1_000_000


def word_counts(df: DataFrame, col: str = "text") -> DataFrame:
    """Lower-case words of the corpus with their number of occurrences."""
    return (
        text_fn.each(df, text_fn.words(F.col(col)), "word")
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


def spell_dictionary(df: DataFrame, k: int = 5, col: str = "text") -> DataFrame:
    """Words that occur at least ``k`` times."""
    return word_counts(df, col).filter(F.col("n") >= k)


def _at_each_letter(words: DataFrame) -> DataFrame:
    """One row per word and letter with what stands before and after it.

    Positions are exploded before any string is cut, so a long word streams through row by
    row instead of as one array of all its variants.
    """
    i = F.col("i")
    return words.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("word")))).withColumns(
        {
            "before": F.substring(F.col("word"), F.lit(1), i - 1),
            "after": F.substring(F.col("word"), i + 1, F.length("word")),
        }
    )


def _lookups(words: DataFrame, transpositions: bool) -> DataFrame:
    """Strings that are one deletion or one swap away from each word."""
    letter = F.substring(F.col("word"), F.col("i"), F.lit(1))
    follower, rest = F.substring("after", 1, 1), F.substring(F.col("after"), F.lit(2), F.length("word"))
    variants = [F.concat("before", "after")]
    if transpositions:
        swapped = F.concat(F.col("before"), follower, letter, rest)
        variants.append(F.when((follower != "") & (follower != letter), swapped))
    return (
        _at_each_letter(words)
        .select("word", F.explode(F.array(*variants)).alias("variant"))
        .filter(F.col("variant").isNotNull())
    )


def _patterns(words: DataFrame, known: bool, *columns: str) -> DataFrame:
    """Patterns of substitution and insertion: ``(word, *columns, at, pattern)``.

    ``at`` is the blanked position, or 0 for the word without a letter (dictionary side) and for the
    whole word (the other side).
    """
    at = F.explode(F.array("i", F.lit(0))) if known else F.col("i")
    blanked = _at_each_letter(words).select(
        "word", *columns, at.alias("at"), F.concat("before", "after").alias("pattern")
    )
    if known:
        return blanked
    whole = words.select("word", *columns, F.lit(0).alias("at"), F.col("word").alias("pattern"))
    return blanked.unionByName(whole)


def spell_candidates(counts: DataFrame, k: int = 5, transpositions: bool = True) -> DataFrame:
    """Best correction of each word below the dictionary threshold: ``(word, fix, fix_n)``.

    ``counts`` has the columns ``word`` and ``n`` and should be a stored table, since both
    sides of the joins are made from it.  Work and shuffle grow with the letters of the
    *distinct* words only.
    """
    is_known = F.col("n") >= k
    length = F.length("word")
    # One edit changes the length by one at most: longer words than the longest of the other
    # side and one more letter have no partner, and are never cut into their variants.
    bounds = counts.agg(
        F.max(F.when(is_known, length)).alias("known"), F.max(F.when(~is_known, length)).alias("unknown")
    )
    longest_known = bounds.select("known").scalar()
    longest_unknown = bounds.select("unknown").scalar()
    known = counts.filter(is_known & (length <= longest_unknown + 1))
    unknown = counts.filter(~is_known & (length <= longest_known + 1)).select("word")
    rank = F.struct((-F.col("n")).alias("minus_n"), F.col("fix"))
    looked_up = (
        _lookups(unknown, transpositions)
        .join(known.select(F.col("word").alias("variant"), F.col("word").alias("fix"), "n"), "variant")
        .select("word", rank.alias("best"))
    )
    best_per_pattern = (
        _patterns(known, True, "n")
        .withColumnRenamed("word", "fix")
        .groupBy("at", "pattern")
        .agg(F.min(rank).alias("best"))
    )
    matched = _patterns(unknown, False).join(best_per_pattern, ["at", "pattern"]).select("word", "best")
    return (
        looked_up.unionByName(matched)
        .groupBy("word")
        .agg(F.min("best").alias("best"))
        .select("word", F.col("best.fix").alias("fix"), (-F.col("best.minus_n")).alias("fix_n"))
    )


def _without_frequent(places: DataFrame, fixes: DataFrame, counts: DataFrame) -> DataFrame:
    """``places`` without the most frequent words of ``counts`` that have no fix.

    A bounded number of hashes is broadcast, from the largest counts down: by far most words of a text are
    frequent, whatever its size, and stay where they are.  Words that share the hash of a fixed word are kept.
    """
    digits = F.length(F.bin("n"))
    sizes = counts.groupBy(digits.alias("digits")).agg(F.count("*").alias("words")).collect()
    least, held = None, 0
    for size in sorted(sizes, key=lambda row: -row.digits):
        held += size.words
        if held > FREQUENT_WORDS:
            break
        least = size.digits
    if least is None:
        return places
    frequent = counts.filter(digits >= least).select(F.xxhash64("word").alias("word_id"))
    frequent = frequent.join(fixes.select(F.xxhash64("word").alias("word_id")), "word_id", "left_anti")
    return places.withColumn("word_id", F.xxhash64("word")).join(F.broadcast(frequent), "word_id", "left_anti").drop("word_id")


def correct_spelling(
    df: DataFrame,
    fixes: DataFrame,
    key: str = "student_id",
    col: str = "text",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Replace the words listed in ``fixes``; everything between words stays as it is.

    A capital first letter is kept.  NULL texts and rows without a key pass through.

    Each text sends the places of its words to the join, spread over ``SALTS`` keys; with the
    ``counts`` of the corpus (``word``, ``n``) only those of words that are seldom or have a fix.  The fixes
    found go back to their text, which is stitched from the untouched stretches between them; texts move
    once.
    """
    runs = text_fn.matches(F.col(col), text_fn.RUN)
    salt = F.pmod(F.hash(key), F.lit(SALTS))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = fixes.select("word", "fix", salts.alias("salt"))
    # rows that share a key are told apart by their text
    text_id = F.xxhash64(col).alias("text_id")
    first = F.substring("run", 1, 1)
    places = (
        text_fn.each_at(df.select(key, text_id, runs.alias("runs")), F.col("runs"), "pos", "run", key, "text_id")
        .filter(F.col("run").rlike(r"^\p{L}"))
        .select(key, "text_id", "pos", F.lower("run").alias("word"), (first != F.lower(first)).alias("capital"))
    )
    if counts is not None:
        places = _without_frequent(places, fixes, counts)
    found = places.withColumn("salt", salt).join(salted, ["word", "salt"])
    letter = F.substring("fix", 1, 1)
    # the capital of one letter is one letter, where there is one
    raised = F.when(letter == "ß", "ẞ").otherwise(F.upper(letter))
    capital = F.col("capital") & (F.length(raised) == 1)
    fix = F.when(
        capital, F.concat(raised, F.substring(F.col("fix"), F.lit(2), F.length("fix")))
    ).otherwise(F.col("fix"))
    # bounded by the words of one text
    edits = found.groupBy(key, "text_id").agg(
        F.array_sort(F.collect_set(F.struct("pos", fix.alias("fix")))).alias("edits")
    )

    def stretch(edit: Column, i: Column) -> Column:
        """Untouched runs since the edit before, then the fix."""
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("edits"), i - 1)["pos"] + 1)
        kept = F.slice(F.col("runs"), start + 1, edit["pos"] - start)
        return F.concat(F.array_join(kept, ""), edit["fix"])

    last = F.element_at("edits", -1)["pos"]
    tail = F.slice(F.col("runs"), last + 2, F.size("runs"))
    stitched = F.concat(
        F.array_join(F.transform("edits", stretch), ""), F.array_join(tail, "")
    )
    return (
        df.withColumn("text_id", text_id)
        .join(edits, [key, "text_id"], "left")
        .withColumn("runs", F.when(F.col("edits").isNotNull(), runs))
        .withColumn(col, F.when(F.col("edits").isNull(), F.col(col)).otherwise(stitched))
        .drop("edits", "runs", "text_id")
    )
