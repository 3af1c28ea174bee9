"""Quality rules: lines that many documents of a host share, and repetition inside a document.

A line is normalised (A-Z lower-cased, digit runs to 0, other ASCII signs and white space to one
blank) and hashed to 96 bits together with its host.  Per hash the distinct documents are counted, over
the whole table: rows of one id are one document, a row without an id is one of its own, and copies
under several ids are several.  Lines found in more than ``max_documents`` documents of their host are
removed, and a document that loses more than ``max_lost`` percent of its words is depleted and rejected.

A row sends each of its lines once; rows of one id meet by (host and line hash, id), which no hot
line or host holds together, and are then counted per line, pre-aggregated per task.  Lines above the limit meet the lines of the documents in
an unhinted join: broadcast by Spark when small, else shuffled with skewed lines split.

Nulls and empties: a null text has no words and fails the base rules; null hosts form a host of
their own; lines without a word (or without any letter, digit or non-ASCII sign) are never counted.
Repeated rows are judged row by row.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import WORD, let, lower_ascii, positions, words_of

NOT_SYMBOL = r"[^#*$%&|<>]+"
BLANK = r"[\x20\x09-\x0D]+"
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_line(line: Column) -> Column:
    plain = F.regexp_replace(lower_ascii(line), r"[0-9]+", "0")
    return F.trim(F.regexp_replace(plain, OTHER, " "))


def _text_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))


def _keyed_lines(host: Column, lines: Column) -> Column:
    """(h, g, words) per line that has a normal form."""
    normal = F.transform(lines, lambda x: F.struct(normal_line(x).alias("line"), x.alias("raw")))
    named = F.filter(normal, lambda x: x["line"] != "")
    return F.transform(
        named,
        lambda x: F.struct(
            F.xxhash64(host, x["line"]).alias("h"),
            F.hash(x["line"], host).alias("g"),
            F.size(F.regexp_extract_all(x["raw"], F.lit(WORD), F.lit(0))).alias("words"),
        ),
    )


def frequent_lines(
    documents: DataFrame, max_documents: int = 30, host: str = "source", text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(h, g, documents): hashes of lines found in more than ``max_documents`` documents of their host."""
    keys = F.array_distinct(
        F.transform(_keyed_lines(F.col(host), _text_lines(F.col(text))), lambda x: F.struct(x["h"], x["g"]))
    )
    unnamed = F.when(F.col(doc_id).isNull(), F.monotonically_increasing_id())
    per_row = documents.select(F.col(doc_id).alias("d"), unnamed.alias("u"), F.explode_outer(keys).alias("k"))
    return (
        per_row.filter("k is not null")
        .select("k.h", "k.g", "d", "u")
        .distinct()
        .groupBy("h", "g")
        .agg(F.count("*").alias("documents"))
        .filter(F.col("documents") > max_documents)
    )


def repeated_words(words: Column, n: int = 3) -> Column:
    """Words inside ``n``-word windows found twice or more among ``words``.

    Most texts stop at the count of distinct windows; for the others the windows are sorted by hash,
    the starts of repeated ones are sorted by place, and each adds the words up to the next start.
    """
    windows = F.transform(positions(F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i + 1, n)))

    def starts_of(sorted_windows: Column) -> Column:
        last = F.size(sorted_windows) - 1
        return F.filter(
            F.transform(
                sorted_windows,
                lambda w, i: F.when(
                    ((i > 0) & (sorted_windows[F.greatest(i - 1, F.lit(0))]["h"] == w["h"]))
                    | ((i < last) & (sorted_windows[F.least(i + 1, last)]["h"] == w["h"])),
                    w["at"],
                ),
            ),
            lambda at: at.isNotNull(),
        )

    def spread_of(starts: Column) -> Column:
        steps = F.transform(
            starts,
            lambda at, i: F.when(
                i < F.size(starts) - 1, F.least(starts[F.least(i + 1, F.size(starts) - 1)] - at, F.lit(n))
            ).otherwise(n),
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        starts = let(by_hash, lambda s: F.sort_array(starts_of(s)))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(starts, spread_of)).otherwise(0)

    return let(windows, covered)


def quality(
    documents: DataFrame,
    max_documents: int = 30,
    max_lost: int = 70,
    min_words: int = 50,
    max_repeated: int = 50,
    doc_id: str = "doc_id",
    host: str = "source",
    text: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_frequent_lines, n_lost_words, kept."""
    raw = F.coalesce(F.col(text), F.lit(""))
    lines = _text_lines(F.col(text))
    measured = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("id"),
        words_of(F.col(text)).alias("words"),
        lines.alias("lines"),
        F.col(host).alias("host"),
        F.char_length(F.regexp_replace(raw, BLANK, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(raw, NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
    ).select(
        "row",
        "id",
        "word_chars",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        _keyed_lines(F.col("host"), F.col("lines")).alias("keyed"),
    )
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    # A head's own key keeps heads apart in the shuffle; without g it meets no line.
    head = F.struct(
        F.xxhash64("row").alias("h"), F.lit(None).cast("int").alias("g"), F.lit(None).cast("int").alias("words"),
        F.struct("id", *measures).alias("m"),
    )
    bare = F.transform(
        "keyed", lambda x: F.struct(x["h"], x["g"], x["words"], F.lit(None).cast(_measure_type(measured, measures)).alias("m"))
    )
    found = (
        measured.select("row", F.explode_outer(F.concat(F.array(head), bare)).alias("x"))
        .select("row", "x.*")
        .join(frequent_lines(documents, max_documents, host, text, doc_id), ["h", "g"], "left")
        .filter("m is not null or documents is not null")
        .groupBy("row")
        .agg(
            F.first("m", ignorenulls=True).alias("m"),
            F.count("documents").alias("n_frequent_lines"),
            F.coalesce(F.sum(F.when(F.col("documents").isNotNull(), F.col("words"))), F.lit(0)).alias("n_lost_words"),
        )
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    depleted = 100 * F.col("n_lost_words") > max_lost * F.col("n_words")
    return (
        found.select("m.*", "n_frequent_lines", "n_lost_words")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
        .withColumnRenamed("id", doc_id)
    )


def _measure_type(measured: DataFrame, measures: list[str]):
    return measured.select(F.struct("id", *measures).alias("m")).schema["m"].dataType


def remove_frequent_lines(
    documents: DataFrame, max_documents: int = 30, host: str = "source", text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``documents`` with their frequent lines cut out of the text; all other lines stay in place.

    Null texts stay null; rows without a frequent line are unchanged.  The lines to cut are gathered
    per distinct (host, text) that has any.
    """
    key = F.struct("h", "g")
    keys = F.transform(_keyed_lines(F.col(host), _text_lines(F.col(text))), lambda x: F.struct(x["h"], x["g"]))
    digest = F.md5(F.concat_ws("\n", F.xxhash64(host).cast("string"), F.col(text)))
    bad = (
        documents.select(digest.alias("digest"), F.explode_outer(F.array_distinct(keys)).alias("k"))
        .select("digest", "k.h", "k.g")
        .join(frequent_lines(documents, max_documents, host, text, doc_id), ["h", "g"], "left_semi")
        .groupBy("digest")
        .agg(F.collect_set(key).alias("bad"))
    )
    rows = documents.select(F.struct("*").alias("doc"), digest.alias("digest")).join(bad, "digest", "left")
    lines = F.split(F.col("doc")[text], "\n", -1)

    def is_bad(line: Column) -> Column:
        normal = normal_line(line)
        named = F.struct(F.xxhash64(F.col("doc")[host], normal).alias("h"), F.hash(normal, F.col("doc")[host]).alias("g"))
        return F.array_contains(F.col("bad"), named)

    cut = F.when(F.col("bad").isNull(), F.col("doc")[text]).otherwise(F.array_join(F.filter(lines, lambda x: ~is_bad(x)), "\n"))
    return rows.select(*[cut.alias(c) if c == text else F.col("doc")[c].alias(c) for c in documents.columns])
