"""Loading a split: read, join, and optionally summarise prompts and correct spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeflow.operators.assemble import assemble
from gradeflow.operators.spelling import (
    correct_spelling,
    spell_candidates,
    word_counts,
)
from gradeflow.operators.summarise import MAX_LENGTH, MIN_LENGTH, reference_summary
from gradeflow.session import checkpointed
from gradeflow.sources.tables import read_prompts, read_responses


def with_reference_summaries(
    prompts: DataFrame, min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH
) -> DataFrame:
    """Prompts with a generated ``reference_summary`` column."""
    return prompts.join(reference_summary(prompts, min_length, max_length), "prompt_id", "left")


def corrected(df: DataFrame, k: int = 5, transpositions: bool = True) -> DataFrame:
    """Responses with their spelling corrected from their own vocabulary.

    The word counts feed both the dictionary and the unknown words, so they are written once; so are the
    fixes, which also tell which frequent words need not move.
    """
    counts = checkpointed(df.sparkSession, word_counts(df), "word-counts")
    fixes = checkpointed(df.sparkSession, spell_candidates(counts, k, transpositions), "fixes")
    return correct_spelling(df, fixes, counts=counts)


def load_data(
    spark: SparkSession,
    directory: str,
    train: bool = True,
    autocorrect_spelling: bool = False,
    summarise: bool = False,
    min_length: int = MIN_LENGTH,
    max_length: int = MAX_LENGTH,
    spelling_threshold: int = 5,
    fmt: str = "csv",
) -> DataFrame:
    """The assembled table of a split from ``prompts_*`` and ``summaries_*`` files."""
    split = "train" if train else "test"
    prompts = read_prompts(spark, directory, split, fmt)
    if summarise:
        prompts = with_reference_summaries(prompts, min_length, max_length)
    responses = read_responses(spark, directory, split, fmt)
    data = assemble(responses, prompts, split)
    return corrected(data, spelling_threshold) if autocorrect_spelling else data
