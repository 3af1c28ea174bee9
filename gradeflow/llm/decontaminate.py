"""Benchmark decontamination: word windows of test items looked up in training texts.

Texts are lower-cased (A-Z) and cut into words.  Every window of ``n`` consecutive words of an item
counts; an item of fewer words, but not none, is one window of its own length.  A document word is
hit if it lies inside an occurrence of a window.

One pass over the documents.  Testing every position would hash ``n`` words per word, so a document
is probed at every ``L // 2``-th position only, with the shorter gram that every window of length
``L`` must then contain (a window covers ``L // 2`` consecutive starts of such grams, so exactly one
probe falls into it).  Probes meet the hashes of all such grams of the benchmark in a broadcast hash
join, sized by a count, else in a shuffled join.  The few probes that hit carry the words around
them; the windows there are compared in full with the item windows.  Nothing depends on hashes
alone.

Nulls and empties: a null or wordless text has no words and no hits; a null or wordless item has no
window; a null ``item_id`` is named by the empty string.  Repeated rows are judged row by row, each
with the same result.  Extra columns are ignored.  An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import broadcast_if_small, lower_ascii, positions
from gradeflow.session import checkpointed

TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of a text that was not lower-cased, with all that stands before it.
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _stride(length: int) -> int:
    return max(1, length // 2)


def _gram(words: Column, start: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), F.slice(words, start + 1, F.lit(length - _stride(length) + 1)))


def item_windows(benchmark: DataFrame, n: int, item: str, text: str) -> DataFrame:
    """(length, window, items): the distinct windows and the sorted ids of the items that hold them."""
    words = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), tokens(F.col(text)).alias("words"))
    starts = positions(F.when(F.size("words") > 0, F.greatest(F.size("words") - n + 1, F.lit(1))).otherwise(0))
    return (
        words.select("item", F.explode_outer(F.transform(starts, lambda i: F.slice("words", i + 1, n))).alias("w"))
        .filter("w is not null")
        .select("item", F.size("w").alias("length"), F.array_join("w", " ").alias("window"))
        .groupBy("length", "window")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def _item_grams(windows: DataFrame, length: int) -> DataFrame:
    words = windows.filter(F.col("length") == length).select(F.split("window", " ").alias("words"))
    starts = positions(F.lit(_stride(length)))
    return words.select(
        F.lit(length).alias("length"),
        F.explode_outer(F.transform(starts, lambda i: _gram(F.col("words"), i, length))).alias("gram"),
    )


def _probes(words: Column, length: int) -> Column:
    """Grams at every stride-th position, each with the words of all windows around it."""
    stride = _stride(length)

    def probe(p: Column) -> Column:
        first = F.greatest(p - (stride - 1), F.lit(0))
        return F.struct(
            F.lit(length).alias("length"),
            first.alias("start"),
            _gram(words, p, length).alias("gram"),
            F.slice(words, first + 1, p + length - first).alias("near"),
        )

    return F.transform(positions(F.size(words) - (length - stride), stride), probe)


def window_hits(
    documents: DataFrame, benchmark: DataFrame, key: list[str], n: int, text: str, item: str, item_text: str
) -> DataFrame:
    """One row per document: ``key``, n_words, spans (hit windows as [start, end) words), items."""
    windows = item_windows(benchmark, n, item, item_text)
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # at most n
    head = F.struct(
        F.lit(0).alias("length"),
        F.size("words").alias("start"),
        F.xxhash64("row").alias("gram"),  # keeps the heads apart in a shuffle; no window has length 0
        F.lit(None).cast("array<string>").alias("near"),
    )
    probes = F.concat(F.array(head), *[_probes(F.col("words"), length) for length in lengths])
    found = (
        documents.select(
            F.monotonically_increasing_id().alias("row"), F.struct(*key).alias("key"), tokens(F.col(text)).alias("words")
        )
        .select("row", "key", F.explode_outer(probes).alias("p"))
        .select("row", "key", "p.*")
    )
    if lengths:
        grams = _item_grams(windows, lengths[0])
        for length in lengths[1:]:
            grams = grams.unionByName(_item_grams(windows, length))
        known = broadcast_if_small(grams.distinct()).withColumn("known", F.lit(True))
        found = found.join(known, ["length", "gram"], "left").filter("length = 0 or known")
    candidates = F.transform(
        positions(F.size("near") - F.col("length") + 1),
        lambda i: F.struct(
            (F.col("start") + i).alias("at"),
            F.array_join(F.slice("near", i + 1, F.col("length")), " ").alias("window"),
        ),
    )
    tried = found.select(
        "row", "key", "length", "start", F.explode_outer(F.when(F.col("length") > 0, candidates)).alias("c")
    ).select("row", "key", "length", "start", "c.at", F.coalesce("c.window", F.col("row").cast("string")).alias("window"))
    span = F.struct(F.col("at"), (F.col("at") + F.col("length")).alias("end"))
    return (
        tried.join(windows, ["length", "window"], "left")
        .groupBy("row", "key")
        .agg(
            F.max(F.when(F.col("length") == 0, F.col("start"))).cast("long").alias("n_words"),
            F.sort_array(F.collect_set(F.when(F.col("items").isNotNull(), span))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        .select("key.*", "n_words", "spans", "items")
    )


def _covered(spans: Column) -> Column:
    """Words inside the union of sorted [at, end) spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        spans,
        start,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["end"] - F.greatest(s["at"], acc["end"]), F.lit(0))).alias("n"),
            F.greatest(s["end"], acc["end"]).alias("end"),
        ),
        lambda acc: acc["n"].cast("long"),
    )


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items, spans, contaminated."""
    hits = window_hits(documents, benchmark, [doc_id], n, text, item, item_text)
    covered = _covered(F.col("spans"))
    return hits.select(
        doc_id,
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        "spans",
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    remove: str = "document",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``documents`` without contaminated rows (``remove="document"``) or without their hit words
    (``remove="span"``: each hit word goes with what separates it from the word before).

    Hits depend on the text alone, so they are gathered per distinct contaminated text and joined
    back by its digest; clean rows keep all columns unchanged.
    """
    if remove not in ("document", "span"):
        raise ValueError("remove is 'document' or 'span'")
    digest = F.md5(F.col(text))
    keyed = documents.select(digest.alias("digest"), F.col(text).alias("text"))
    hit = (
        window_hits(keyed, benchmark, ["digest"], n, "text", item, item_text)
        .filter(F.size("spans") > 0)
        .groupBy("digest")
        .agg(F.first("spans").alias("spans"))
    )
    rows = documents.select(F.struct("*").alias("doc"), digest.alias("digest"))
    if remove == "document":
        # Digests of one width: counted, and broadcast while they are few, so that no text moves.
        found = checkpointed(documents.sparkSession, hit.select("digest"), "contaminated")
        return rows.join(broadcast_if_small(found), "digest", "left_anti").select("doc.*")
    pieces = F.regexp_extract_all(F.col("doc")[text], F.lit(PIECE), F.lit(0))
    rest = F.substring(F.col("doc")[text], F.char_length(F.array_join("pieces", "")) + 1, F.char_length(F.col("doc")[text]))
    hit_words = F.array_distinct(
        F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["end"] - 1)))
    )
    kept = F.array_except(positions(F.size("pieces")), F.col("hit_words"))
    cut = F.concat(F.array_join(F.transform(kept, lambda i: F.col("pieces")[i]), ""), F.col("rest"))
    names = [F.col("doc")[c].alias(c) if c != text else F.coalesce("cut", F.col("doc")[text]).alias(c) for c in documents.columns]
    return (
        rows.join(hit, "digest", "left")
        .select("doc", F.when(F.col("spans").isNotNull(), pieces).alias("pieces"), hit_words.alias("hit_words"))
        .withColumn("rest", rest)
        .select("doc", cut.alias("cut"))
        .select(*names)
    )
