"""Scoring a stream of responses against static prompts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradeflow.operators.assemble import assemble
from gradeflow.operators.score import linear_score
from gradeflow.schemas import TARGET_COLUMNS

Coefficients = dict[str, tuple[Sequence[float], float]]


def model_coefficients(model: DataFrame, targets: Sequence[str] = TARGET_COLUMNS) -> Coefficients:
    """Weights and intercept per target of one model: as many numbers as it has features.

    Several models of a target are an error; choose a fold first.
    """
    rows = (
        model.filter(F.col("target").isin(list(targets)))
        .groupBy("target")
        .agg(F.count("*").alias("n"), F.first(F.struct("weights", "intercept")).alias("model"))
        .collect()  # a row per target
    )
    if several := sorted(r.target for r in rows if r.n > 1):
        raise ValueError(f"several models of {several}: choose one fold")
    return {r.target: (list(r.model.weights), r.model.intercept) for r in rows}


def stream_score(
    responses: DataFrame,
    prompts: DataFrame,
    coefficients: Coefficients,
    featurise: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Join, featurise and score each response as it arrives; needs no state.

    ``featurise`` adds the array column ``features``.
    """
    assembled = featurise(assemble(responses, prompts, "test"))
    scored = linear_score(assembled, coefficients, prefix="")
    return scored.select("student_id", "prompt_id", *coefficients)


def write_scores(
    scores: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append scored rows to a Parquet folder, each exactly once.

    ``trigger`` is that of Spark, e.g. ``{"processingTime": "1 minute"}``; without it the stream
    ends once it has read what is there.
    """
    return (
        scores.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
