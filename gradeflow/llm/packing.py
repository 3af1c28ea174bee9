"""Packing of tokenised documents into sequences of bounded length.

A document is its token ids and an end id.  Whole stretches of the sequence length are sequences of
their own.  The tails are dealt at random into groups, and each group is packed by first-fit
decreasing: longest first, each into the first sequence with room, found in a tournament tree of
free capacities.  Then the last sequences fill the gaps of the others, cut where needed, and what
remains of a group is cut into powers of two, which need no padding.

Only tails (shorter than a sequence) and checksums meet in a group, so its memory is bounded by
``GROUP`` sequences whatever the lengths of the documents, and groups are alike whatever the ids.

Nulls and empties: a null text is empty and yields the end id alone.  Repeated rows are packed one
by one, null ids like any other; extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


GROUP = 4096
#: Distinct words kept by one task, some 150 bytes each.
CACHED_WORDS = 500_000
#: Below it, composed form and lower case are those of single characters.
BEYOND, STOPS = "\u0300", ".,!?;:"
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ByteSigns(dict):
    """For ``str.translate``: the signs that stand for the bytes of a character in the vocabulary."""

    def __init__(self, byte_level):
        super().__init__()
        self.byte_level = byte_level

    def __missing__(self, code: int) -> str:
        signs = self[code] = self.byte_level.pre_tokenize_str(chr(code))[0][0]
        return signs


class WordEncoder(dict):
    """Ids of white-space-free words, by word.

    For tokenizers that lower-case, drop white space and never join over it, as the word-end BPE
    file here: ids of a text are then those of its words.  Words of letters below U+0300 are cut by
    the tokenizer's own pattern and each part is encoded once; any other word is left to the whole
    tokenizer.
    """

    PLAIN = re.compile("[!-~\u00a1-\u02ff]+")

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        self.signs = ByteSigns(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)["pre_tokenizer"]["pretokenizers"]
        self.cut = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.code = "H" if self.whole.get_vocab_size() <= 2**16 else "I"
        self.part_ids: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.part_ids.get(part)
        if ids is None:
            tokens = self.merge(part if part.isascii() else part.translate(self.signs))
            ids = self.part_ids[part] = self._pack([token.id for token in tokens])
        return ids

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(self.part_ids) >= CACHED_WORDS:
            self.part_ids.clear()
        lower = word.lower()
        body = lower[:-1]
        if lower.isalpha() and (lower.isascii() or max(lower) < BEYOND):
            ids = self._part(lower)  # letters alone are one part
        elif body.isalpha() and lower[-1] in STOPS and (body.isascii() or max(body) < BEYOND):
            ids = self._part(body) + self._part(lower[-1])
        elif self.PLAIN.fullmatch(word) and "<|" not in word:
            ids = b"".join(map(self._part, self.cut(lower)))
        else:
            ids = self._pack(self.whole.encode(word, add_special_tokens=False).ids) if word else b""
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, text: str | None, end: int) -> np.ndarray:
        words = (text or "").replace("\n", " ").split(" ")
        return np.frombuffer(b"".join(map(self.__getitem__, words)) + self._pack([end]), self.code)


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes into ``sizes``, each at most ``capacity`` in sum.

    The leaves of the tournament tree are bins, every inner node holds the larger free capacity of
    its two children, so the first bin with room is found on one path from the root.
    """
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < sizes[item]:
                node += 1
        if node - leaves == len(bins):
            bins.append([])
        bins[node - leaves].append(item)
        free[node] -= sizes[item]
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return bins


def pack_tails(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length): all full, or a power of two long, as far as can be."""
    bins = [[(i, 0, sizes[i]) for i in items] for items in first_fit_decreasing(sizes, capacity)]
    used = [sum(piece[2] for piece in pieces) for pieces in bins]
    order = sorted(range(len(bins)), key=lambda b: -used[b])
    low, high = 0, len(order) - 1
    while low < high:
        taker, giver = order[low], order[high]
        gap = capacity - used[taker]
        if not gap:
            low += 1
        elif not bins[giver]:
            high -= 1
        else:
            item, start, length = bins[giver].pop()
            moved = min(gap, length)
            if moved < length:
                bins[giver].append((item, start, length - moved))
            bins[taker].append((item, start + length - moved, moved))
            used[taker] += moved
            used[giver] -= moved
    out = [bins[b] for b in order if used[b] == capacity]
    for rest in (bins[b] for b in order if 0 < used[b] < capacity):
        left = sum(piece[2] for piece in rest)
        pieces = rest[::-1]
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            sequence = []
            while room:
                item, start, length = pieces.pop()
                taken = min(room, length)
                sequence.append((item, start, taken))
                room -= taken
                if taken < length:
                    pieces.append((item, start + taken, length - taken))
            out.append(sequence)
    return out


def _tokens_udf(path: str, end: int, capacity: int):
    @F.pandas_udf("n long, whole array<long>, tail binary, code string")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder(path)  # once per task
        for texts in batches:
            rows = []
            for text in texts:
                ids = encoder.encode(text, end)
                cut = len(ids) // capacity * capacity
                whole = [checksum(ids[i : i + capacity]) for i in range(0, cut, capacity)]
                rows.append((len(ids), whole, ids[cut:].tobytes(), ids.dtype.char))
            yield pd.DataFrame(rows, columns=["n", "whole", "tail", "code"])

    return tokens


def _pack_group(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["part"].iloc[0]) << 32
        group = group.sort_values("row").reset_index(drop=True)
        rows = []
        for doc, n, whole in zip(group["id"], group["n"], group["whole"], strict=True):
            for k, crc in enumerate(whole):
                rows.append((doc, k * capacity, capacity, crc, n, number, 0))
                number += 1
        tails = [np.frombuffer(t, c) for t, c in zip(group["tail"], group["code"], strict=True)]
        filled = [i for i, tail in enumerate(tails) if len(tail)]
        for sequence in pack_tails([len(tails[i]) for i in filled], capacity):
            offset = 0
            for item, start, length in sequence:
                i = filled[item]
                first = int(group["n"][i]) - len(tails[i]) + start
                crc = checksum(tails[i][start : start + length])
                rows.append((group["id"][i], first, length, crc, group["n"][i], number, offset))
                offset += length
            number += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pd.DataFrame(rows, columns=names)

    return pack


def pack(
    documents: DataFrame, path: str, end: int = 1, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` names the tokenizer file on every worker.
    """
    spark = documents.sparkSession
    groups = max(1, -(-documents.count() // GROUP))
    kind = documents.schema[doc_id].dataType.simpleString()
    # Null ids travel as strings, which pandas does not turn into floats.
    named = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text")
    )
    encoded = named.select(
        "row", "id", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("part"), _tokens_udf(path, end, capacity)("text").alias("t")
    )
    pieces = encoded.select("row", "id", "part", "t.*").groupBy("part").applyInPandas(_pack_group(capacity), PIECES.format(id="string"))
    return pieces.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumnRenamed("doc_id", doc_id)
