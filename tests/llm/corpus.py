"""Small messy tables and brute-force helpers for the corpus operators."""

from __future__ import annotations

import random
import re

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row long, id string, key string, digest string, node long, root long, words string, h long, part long, found string"
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    names = ["w" + format(i * 7919 % 100003, "x") for i in range(vocabulary)]
    return " ".join(rng.choice(names) for _ in range(words))


def messy_texts() -> list[tuple[int | None, str | None, str | None, str | None]]:
    """(doc_id, text, lang, source): nulls, empties, ties, repeated rows, copies, one long text."""
    rng = random.Random(5)
    base = prose(rng, 120)
    changed = base.split()
    changed[60] = "other"
    long = prose(rng, 60_000, 5000)
    shared = "One line that many documents of a host share with each other 42"
    texts = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, " ".join(changed), "en", "b"),
        (4, None, None, None),
        (5, "", "en", "a"),
        (6, " \n\t ", None, "b"),
        (7, "Ünïcode wörds\x85 ÉÀ İ ΑΣ 中文", "de", None),
        (None, "a text without an id but with an address me.x@mail.example.org", "en", "a"),
        (None, None, "en", "a"),
        (8, long, "en", "a"),
        (9, base.upper(), "en", "c"),
        (10, "der der der der der der der der der der der der\nder der\nder der", "de", "b"),
        (11, "two words", "en", "a"),
        (12, "!!! ### $$$", "fr", "a"),
    ]
    texts += [(100 + i, f"{shared.replace('42', str(i))}\n{prose(rng, 80)}", "en", "host") for i in range(12)]
    return texts


def messy(spark, rows=None):
    """``documents`` with further columns whose names clash with those the operators use inside."""
    rows = messy_texts() if rows is None else rows
    full = [
        (d, t, lang, s, None if t is None else len(t), i % 3, "x", None, "d", i, 7, "w", i, 2, "f")
        for i, (d, t, lang, s) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA)


def as_set(rows):
    return sorted(map(repr, rows))
