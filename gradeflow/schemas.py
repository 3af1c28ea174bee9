"""Fixed table layouts and the fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: parts of a composed text, their tags and their columns ----
TAGS = {
    "title": "<title>",
    "text": "<text>",
    "question": "<question>",
    "summary": "<summary>",
    "reference_summary": "<reference>",
}
PART_COLUMNS = {
    "title": "prompt_title",
    "text": "prompt_text",
    "question": "prompt_question",
    "summary": "text",
    "reference_summary": "reference_summary",
}
# --- Fixed values: targets --------------------------------------------------
TARGETS = {
    "content": ["content"],
    "wording": ["wording"],
    "both": ["content", "wording"],
}
# --- Fixed values: cell texts that mean "missing" in a numeric column -------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# --- Fixed values: column order of the assembled table ----------------------
ASSEMBLED_COLUMNS = [
    "student_id", "prompt_id", "prompt_title", "prompt_question", "prompt_text", "text",
    "reference_summary",
]
TARGET_COLUMNS = ["content", "wording"]
PREDICTED_COLUMNS = ["predicted_content", "predicted_wording"]


def _strings(names: list[str]) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


def _doubles(names: list[str]) -> list[T.StructField]:
    return [T.StructField(name, T.DoubleType()) for name in names]


PROMPTS = T.StructType(_strings(["prompt_id", "prompt_title", "prompt_question", "prompt_text"]))
RESPONSES_TEST = T.StructType(_strings(["student_id", "prompt_id", "text"]))
RESPONSES_TRAIN = T.StructType(RESPONSES_TEST.fields + _doubles(TARGET_COLUMNS))
PREDICTIONS = T.StructType(
    _strings(ASSEMBLED_COLUMNS) + _doubles(TARGET_COLUMNS + PREDICTED_COLUMNS)
)
SUBMISSION = T.StructType(_strings(["student_id"]) + _doubles(TARGET_COLUMNS))
METRIC_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField("step", T.LongType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
COEFFICIENTS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField("target", T.StringType()),
        T.StructField("feature", T.IntegerType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("fold", T.StringType()),
    ]
)


def target_columns(target: str) -> list[str]:
    """Columns of a target choice: ``content``, ``wording`` or ``both``."""
    if target not in TARGETS:
        raise ValueError(f"unknown target {target!r}; choose one of {sorted(TARGETS)}")
    return TARGETS[target]
