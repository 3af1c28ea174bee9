"""Spelling variants by dense prefix-suffix tiling.

Two words are near if they differ by one inserted, deleted or replaced code point.  With M the length
of the longer, that holds exactly if common prefix and common suffix together reach M - 1, so one of
the two reaches M // 2.  Words are grouped by M and their first, or last, M // 2 code points; a word is
the longer of M = its length and the shorter of M = its length + 1.  Groups are cut into blocks of
``BLOCK`` words by hash, and each pair of blocks becomes one tile: two code-point matrices, padded to M,
compared column by column for all pairs of rows.  A pair that shares both halves counts in its prefix
group only, so every pair is found once.

Words are counted with partial sums before the shuffle: a word in every text is one row per task.  A
group of any size is spread over its tiles; a tile holds two blocks.  Small groups of one length share
a tile.

Nulls and empties: a null text has no words, an empty table none.  Copies and repeated rows count each
time.  Words are compared by code points, whatever their letters.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import lower_ascii
from gradeflow.session import checkpointed

#: Words of one group that share a block.
BLOCK = 1024
#: Words of small groups that share a tile, and the rows of a tile compared at a time.
SHARED, STRIP = 192, 256
PAIRS = "word string, n long, near string, near_n long"
GROUP = ["length", "side", "part"]


def runs_of(documents: DataFrame, min_length: int = 7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, run): every maximal run of letters of at least ``min_length`` code points, A-Z lower-cased.

    Letters are a-z and U+00C0 to U+00FF.
    """
    letters = f"[a-zÀ-ÿ]{{{min_length},}}"
    runs = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(letters), F.lit(0))
    return documents.select(F.col(doc_id).alias("doc_id"), F.explode_outer(runs).alias("run")).filter("run is not null")


def count_words(words: DataFrame, word: Column, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n): distinct words of enough code points and occurrences."""
    return (
        words.select(word.alias("word"))
        .filter(F.char_length("word") >= min_length)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_count)
    )


def grouped(counted: DataFrame) -> DataFrame:
    """(length, side, part, word, n): a word's groups as the longer and as the shorter of a pair."""
    size = F.char_length("word")
    groups = []
    for longer in (size, size + 1):
        half = F.floor(longer / 2).cast("int")
        for side, part in (("p", F.substring("word", F.lit(1), half)), ("s", F.substring("word", size - half + 1, half))):
            groups.append(F.struct(longer.alias("length"), F.lit(side).alias("side"), part.alias("part")))
    return counted.select(F.explode(F.array(*groups)).alias("g"), "word", "n").select("g.*", "word", "n")


def tiles(groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(length, side, i, j, blocks, words): the words of blocks ``i`` and ``j`` of each group.

    A group of a single block is the tile (0, 0).  Only groups of more words than a block are looked
    up for their number of blocks; groups without a word of full length, or of one word, are left out.
    """
    counts = groups.groupBy(*GROUP).agg(
        F.count("*").alias("words"), F.max(F.char_length("word") == F.col("length")).alias("any_long")
    )
    large = counts.filter((F.col("words") > block) & F.col("any_long")).select(
        *GROUP, F.ceil(F.col("words") / block).cast("int").alias("blocks")
    )
    dealt = groups.join(large, GROUP, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    return (
        dealt.select(*GROUP, own.alias("block"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "word", "n")
        .groupBy(*GROUP, "blocks", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .agg(F.collect_list(F.struct("word", "n", "block")).alias("words"))
        .filter((F.size("words") > 1) & F.exists("words", lambda w: F.char_length(w["word"]) == F.col("length")))
        .select("length", "side", "i", "j", "blocks", "words")
    )


def code_points(words: list[str], length: int) -> np.ndarray:
    """A row per column of the padded code-point matrix, in the smallest type that holds it."""
    matrix = np.array(words, f"U{length}").view(np.uint32).reshape(len(words), length)
    small = np.uint8 if matrix.max(initial=0) < 256 else np.uint32
    return np.ascontiguousarray(matrix.T.astype(small))


def common_prefix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each word of ``left`` with each of ``right``, given by columns."""
    alive = left[0][:, None] == right[0][None, :]
    total = alive.astype(np.uint8 if len(left) < 128 else np.uint32)
    for a, b in zip(left[1:], right[1:], strict=True):
        alive &= a[:, None] == b[None, :]
        total += alive
    return total


def tile_hits(words: list[str], length: int, side: str, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near words of a tile, each once; with ``block``, only pairs of its two blocks.

    One word of a pair has ``length`` code points, the other as many or one less.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    longs, shorts = np.flatnonzero(size == length), np.flatnonzero(size < length)
    forward, backward = code_points(words, length), code_points([word[::-1] for word in words], length)
    if block is None:
        sweeps = [(longs[s : s + STRIP], np.concatenate([longs[s:], shorts])) for s in range(0, len(longs), STRIP)]
    else:
        first = block == block.min()
        sweeps = []
        for rows, columns in (
            (longs[first[longs]], np.flatnonzero(~first)),
            (longs[~first[longs]], shorts[first[shorts]]),
        ):
            sweeps += [(rows[s : s + STRIP], columns) for s in range(0, len(rows), STRIP)]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for rows, columns in sweeps:
        prefix = common_prefix(forward[:, rows], forward[:, columns])
        suffix = common_prefix(backward[:, rows], backward[:, columns])
        near = prefix + suffix >= length - 1
        near &= prefix >= length // 2 if side == "p" else (prefix < length // 2) & (suffix >= length // 2)
        a, b = np.nonzero(near)
        if block is None:  # a strip meets itself in its first columns
            once = a < b
            a, b = a[once], b[once]
        left.append(rows[a])
        right.append(columns[b])
    return np.concatenate(left), np.concatenate(right)


def near_pairs(tiled: DataFrame) -> DataFrame:
    """(word, n, near, near_n) for each pair of near words, once."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            cells = lists.flatten()
            words, n = cells.field("word").to_pylist(), cells.field("n").to_numpy()
            block = cells.field("block").to_numpy()
            start = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            size = np.diff(start)
            length, i, j, blocks = (batch.column(c).to_numpy() for c in ("length", "i", "j", "blocks"))
            side = batch.column("side").to_pylist()
            shared: dict[tuple[int, str], list[int]] = {}
            for row in range(batch.num_rows):
                span = range(start[row], start[row + 1])
                key = (int(length[row]), side[row])
                if size[row] > SHARED or blocks[row] > 1:
                    yield from hits(words, n, span, key, block[span.start : span.stop] if i[row] != j[row] else None)
                    continue
                held = shared.setdefault(key, [])
                held.extend(span)
                if len(held) > SHARED:
                    yield from hits(words, n, shared.pop(key), key)
            for key, held in shared.items():
                yield from hits(words, n, held, key)

    def hits(words, n, members, key, block=None):
        a, b = tile_hits([words[m] for m in members], *key, block)
        if len(a):
            members = np.asarray(members)
            a, b = members[a], members[b]
            columns = [[words[x] for x in a], n[a], [words[x] for x in b], n[b]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["word", "n", "near", "near_n"])

    return tiled.mapInArrow(compare, PAIRS)


def forms(counted: DataFrame, pairs: DataFrame, min_ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n) for every counted word.

    The form is the near word of largest n, of equal ones the smallest in code-point order, if its n
    is at least ``min_ratio`` times the word's.
    """
    there = F.struct("word", F.col("near").alias("other"), F.col("near_n").alias("other_n"))
    back = F.struct(F.col("near").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = (
        pairs.select(F.explode(F.array(there, back)).alias("x"))
        .select("x.*")
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    )
    enough = -F.col("best.less") >= min_ratio * F.col("n")
    return counted.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("best.other")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n"),
    )


def with_roots(found: DataFrame) -> DataFrame:
    """``found`` with root: the last word reached by following forms, the word itself without one.

    Forms grow in n, so there are no cycles.  Each round doubles the steps followed; the links are
    written to the shared folder between rounds.
    """
    spark = found.sparkSession
    links = checkpointed(spark, found.filter("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = links.join(onward, "root", "left")
        if not step.filter("next is not null").limit(1).count():
            break
        links = checkpointed(spark, step.select("word", F.coalesce("next", "root").alias("root")), "forms")
    return found.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(counted: DataFrame, min_ratio: int = 10, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``counted`` (word, n), words distinct."""
    spark = counted.sparkSession
    words = checkpointed(spark, counted.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_pairs(tiles(grouped(words), block))
    found = checkpointed(spark, forms(words, pairs, min_ratio), "variants")
    return with_roots(found).select("word", "form", "root", "n", "n_near", "form_n")
