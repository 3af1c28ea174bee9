"""Joining responses to the prompts they answer, and composing model inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.functions import text as text_fn
from gradeflow.schemas import ASSEMBLED_COLUMNS, TARGET_COLUMNS, target_columns


def duplicate_prompts(prompts: DataFrame) -> DataFrame:
    """Prompt ids that occur more than once."""
    return prompts.groupBy("prompt_id").agg(F.count("*").alias("n")).filter("n > 1")


def assemble(
    responses: DataFrame,
    prompts: DataFrame,
    split: str = "train",
    validate: str | None = None,
    null_safe_keys: bool = False,
) -> DataFrame:
    """Inner join of responses and prompts in the fixed column order.

    Responses without a prompt drop out; the targets are kept for ``split="train"`` only.
    The join carries no hint: Spark broadcasts the prompts while they are below its size
    threshold and otherwise shuffles both sides, splitting a hot prompt at run time.
    """
    if split not in ("train", "test"):
        raise ValueError("split must be 'train' or 'test'")
    if validate not in (None, "many_to_one"):
        raise ValueError("validate must be None or 'many_to_one'")
    if validate and not duplicate_prompts(prompts).limit(1).isEmpty():
        raise ValueError("prompt_id is not unique in the prompt table")
    if "reference_summary" not in prompts.columns:
        prompts = prompts.withColumn("reference_summary", F.lit(""))
    columns = ASSEMBLED_COLUMNS + (TARGET_COLUMNS if split == "train" else [])
    if null_safe_keys:
        right = prompts.withColumnRenamed("prompt_id", "prompt_key")
        joined = responses.join(right, F.col("prompt_id").eqNullSafe(F.col("prompt_key")))
    else:
        joined = responses.join(prompts, "prompt_id")
    return joined.select(*columns)


def compose_prompt(
    df: DataFrame, parts: Sequence[str], out: str = "input_text", null_parts: str = "skip"
) -> DataFrame:
    """Add one tagged text per row made of the requested parts."""
    return df.withColumn(out, text_fn.compose(parts, null_parts))


def select_targets(df: DataFrame, target: str = "both", out: str = "labels") -> DataFrame:
    """Add the chosen targets as an array of doubles."""
    columns = target_columns(target)
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in columns]))
