"""Text expressions: tagged composition, tokens, words and sentences, and rows of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.schemas import PART_COLUMNS, TAGS

WORD = r"\p{L}+"
TOKEN = "|".join(TAGS.values()) + r"|[\p{L}\p{N}]+"
PLAIN_TOKEN = r"[\p{L}\p{N}]+"
# a plain token together with whatever separates it from the one before
TOKEN_WITH_GAP = r"[^\p{L}\p{N}]*[\p{L}\p{N}]+"
# alternating runs of letters and of anything else; joined again they give the text
RUN = r"\p{L}+|[^\p{L}]+"
SENTENCE = r"[^.!?\n]+[.!?]*"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def each(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """One row per element of a computed array, next to the columns ``keep``.

    A plain ``explode`` makes the optimiser filter on the array's size first, which computes an
    expensive array several times; the outer form with a filter behind it does not.
    """
    rows = df.select(*keep, F.explode_outer(array).alias(name))
    return rows.filter(F.col(name).isNotNull())


def each_at(df: DataFrame, array: Column, pos: str, name: str, *keep: str) -> DataFrame:
    """Like :func:`each`, with the 0-based position of the element."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, name))
    return rows.filter(F.col(name).isNotNull())


def compose(parts: Sequence[str], null_parts: str = "skip") -> Column:
    """``"<tag> value"`` per requested part, in the caller's order, one space apart.

    ``null_parts="skip"`` leaves NULL parts out, ``"null"`` makes the whole text NULL.
    Parts that are not asked for are not read.
    """
    unknown = [part for part in parts if part not in TAGS]
    if unknown:
        raise ValueError(f"unknown text parts {unknown}; choose from {sorted(TAGS)}")
    if null_parts not in ("skip", "null"):
        raise ValueError("null_parts must be 'skip' or 'null'")
    pieces = [F.concat(F.lit(TAGS[part] + " "), F.col(PART_COLUMNS[part])) for part in parts]
    joined = F.concat_ws(" ", *pieces)
    if null_parts == "null":
        for part in set(parts):
            joined = F.when(F.col(PART_COLUMNS[part]).isNotNull(), joined)
    return joined


def tokens(text: Column) -> Column:
    """Lower-case tokens; the five tags stay whole."""
    return matches(F.lower(text), TOKEN)


def words(text: Column) -> Column:
    """Lower-case runs of letters."""
    return matches(F.lower(text), WORD)


def sentences(text: Column) -> Column:
    return matches(text, SENTENCE)
