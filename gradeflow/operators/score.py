"""Scoring rows with fitted models."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.functions import vectors
from gradeflow.operators.folds import ALL
from gradeflow.schemas import TARGET_COLUMNS

# Model files that one Python worker keeps loaded.
MODELS_IN_MEMORY = 8
# Bytes of coefficients that may travel as matrices, and the models multiplied at a time.
MATRIX_BYTES, MODEL_BLOCK = 128 << 20, 256


def _as_vector(features: str | Sequence[str]) -> Column:
    if isinstance(features, str):
        return F.col(features)
    return F.array(*[F.col(f).cast("double") for f in features])


def linear_score(
    df: DataFrame,
    coefficients: dict[str, tuple[Sequence[float], float]],
    features: str = "features",
    prefix: str = "predicted_",
) -> DataFrame:
    """Add ``w . x + b`` per target from given weights and intercepts."""
    return df.withColumns(
        {
            prefix + target: vectors.linear(F.col(features), vectors.literal(w), F.lit(float(b)))
            for target, (w, b) in coefficients.items()
        }
    )


def wide_models(models: DataFrame, targets: Sequence[str] = TARGET_COLUMNS) -> DataFrame:
    """One row per fold with a struct of intercept and weights per target.

    Two models of one fold and target are an error.
    """
    head = F.struct("intercept", "weights")
    kind = "struct<intercept:double,weights:array<double>>"

    def only(t: str) -> Column:
        of_target = F.col("target") == t
        several = F.raise_error(F.lit(f"several models of one fold predict {t}")).cast(kind)
        first = F.first(F.when(of_target, head), ignorenulls=True).cast(kind)
        return F.when(F.count(F.when(of_target, 1)) > 1, several).otherwise(first)

    return models.groupBy("fold").agg(*[only(t).alias(f"model_{t}") for t in targets])


def _predictions(features: Column, targets: Sequence[str], prefix: str) -> dict[str, Column]:
    return {
        prefix + t: vectors.linear(
            features, F.col(f"model_{t}")["weights"], F.col(f"model_{t}")["intercept"]
        )
        for t in targets
    }


def oof_predict(
    df: DataFrame,
    models: DataFrame,
    features: str | Sequence[str] = "features",
    targets: Sequence[str] = TARGET_COLUMNS,
    key: str = "prompt_id",
    prefix: str = "predicted_",
) -> DataFrame:
    """Score each row with the model that did not see its prompt.

    An equi-join of rows and models on the fold id.  The model side has one row per fold and
    is broadcast by Spark as long as it is below the broadcast threshold.
    """
    wide = wide_models(models.filter(F.col("fold") != ALL), targets).withColumnRenamed("fold", key)
    scored = df.join(wide, key).withColumns(_predictions(_as_vector(features), targets, prefix))
    return scored.select(*df.columns, *[prefix + t for t in targets])


def averaged_model(models: DataFrame) -> DataFrame:
    """Mean of the models of each target.

    Linear models agree with the mean of their predictions when their coefficients are
    averaged, so an ensemble costs as much as a single model.
    """
    parts = models.select("target", "intercept", F.posexplode_outer("weights").alias("i", "w"))
    per_feature = parts.groupBy("target", "i").agg(
        F.avg("w").alias("w"), F.avg("intercept").alias("intercept")
    )
    # one item per feature
    item = F.when(F.col("i").isNotNull(), F.struct("i", "w"))
    return per_feature.groupBy("target").agg(
        F.first("intercept").alias("intercept"),
        F.array_sort(F.collect_list(item)).alias("items"),
    ).select(F.lit("mean").alias("fold"), "target", "intercept", F.col("items.w").alias("weights"))


def predict_ensemble(
    df: DataFrame,
    models: DataFrame,
    features: str | Sequence[str] = "features",
    targets: Sequence[str] = TARGET_COLUMNS,
    prefix: str = "",
) -> DataFrame:
    """Mean prediction of all models for every row, in one scan and without a shuffle.

    The averaged model is one row, handed to the scan as a scalar subquery.
    """
    wide = wide_models(averaged_model(models), targets)
    names = [f"model_{t}" for t in targets]
    scored = (
        df.withColumn("ensemble", wide.select(F.struct(*names)).scalar())
        .withColumns({name: F.col("ensemble")[name] for name in names})
        .withColumns(_predictions(_as_vector(features), targets, "ensemble_"))
    )
    kept = [c for c in df.columns if c not in {prefix + t for t in targets}]
    return scored.select(*kept, *[F.col(f"ensemble_{t}").alias(prefix + t) for t in targets])


def model_matrices(models: DataFrame, targets: Sequence[str], allow_missing: bool = False) -> dict[str, np.ndarray]:
    """Per target, all its models as the columns of a matrix, intercepts in the first line.

    The table is measured first: more than ``MATRIX_BYTES`` are an error (average the coefficients,
    :func:`predict_ensemble`), and so is a target without a model unless ``allow_missing``.
    """
    wanted = models.filter(F.col("target").isin(list(targets)))
    size = wanted.agg(F.sum(8 * (F.size("weights") + 1)).alias("bytes")).first()["bytes"] or 0
    if size > MATRIX_BYTES:
        raise ValueError(f"models of {size} bytes exceed {MATRIX_BYTES}: average their coefficients instead")
    columns: dict[str, list[list[float]]] = {}
    for row in wanted.select("target", "intercept", "weights").orderBy("target", "fold").collect():
        columns.setdefault(row.target, []).append([row.intercept, *row.weights])
    absent = [t for t in targets if t not in columns]
    if absent and not allow_missing:
        raise ValueError(f"no model predicts {absent}")
    for t, models_of in columns.items():
        if len({len(c) for c in models_of}) > 1:
            raise ValueError(f"models of {t} have unequal numbers of features")
    return {t: np.array(models_of, float).T for t, models_of in columns.items()}


def _running(x: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation over all models of each row, a block of models at a time."""
    mean, squares, seen = np.zeros(len(x)), np.zeros(len(x)), 0
    for start in range(0, matrix.shape[1], MODEL_BLOCK):
        block = matrix[:, start : start + MODEL_BLOCK]
        values = x @ block[1:] + block[0]
        own, gap, more = values.mean(axis=1), values.mean(axis=1) - mean, block.shape[1]
        squares += ((values - own[:, None]) ** 2).sum(axis=1) + gap * gap * seen * more / (seen + more)
        seen += more
        mean += gap * more / seen
    return mean, np.sqrt(squares / seen)


def predict_models(
    df: DataFrame,
    models: DataFrame,
    features: str | Sequence[str] = "features",
    targets: Sequence[str] = TARGET_COLUMNS,
    prefix: str = "",
    allow_missing: bool = False,
    spread: bool = False,
) -> DataFrame:
    """Mean prediction of all models of each target, and with ``spread`` their standard deviation.

    All models of a target are one matrix; a batch of rows is multiplied by it and averaged as it
    goes, so neither the rows nor the plan grow with the number of models.  A row whose features are missing
    or of another length has no prediction.  A target without a model is an error unless
    ``allow_missing``, which leaves it NULL.
    """
    matrices = model_matrices(models, targets, allow_missing)
    names = [n for t in targets for n in ([f"{prefix}{t}", f"{prefix}{t}_spread"] if spread else [f"{prefix}{t}"])]
    layout = ", ".join(f"`{n}` double" for n in names)

    @F.arrow_udf(f"struct<{layout}>")
    def ensemble(x: pa.Array) -> pa.Array:
        lengths = x.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        flat = x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
        fields = []
        for t in targets:
            values = np.full((2, len(lengths)), np.nan)
            fits = np.zeros(len(lengths), bool)
            if t in matrices:
                width = matrices[t].shape[0] - 1
                fits = lengths == width
                rows = flat[starts[fits][:, None] + np.arange(width)[None, :]] if width else np.zeros((fits.sum(), 0))
                values[:, fits] = _running(rows, matrices[t])
            fields += [pa.array(v, mask=~fits) for v in values[: 1 + spread]]
        return pa.StructArray.from_arrays(fields, names)

    kept = [c for c in df.columns if c not in set(names)]
    scored = df.withColumn("ensemble_", ensemble(_as_vector(features).cast("array<double>")))
    return scored.select(*kept, *[F.col("ensemble_")[n].alias(n) for n in names])


def predict_each(
    df: DataFrame,
    models: DataFrame,
    features: str | Sequence[str] = "features",
    targets: Sequence[str] = TARGET_COLUMNS,
    key: str = "student_id",
) -> DataFrame:
    """One row per response and model: ``(key, model_id, <targets>)``.

    The list of models reaches the scan as a scalar subquery and is unrolled inside each row,
    so the responses are read once for all models.
    """
    names = [f"model_{t}" for t in targets]
    # one item per model
    every = wide_models(models, targets).agg(F.collect_list(F.struct("fold", *names)))
    scored = df.select(key, _as_vector(features).alias("x")).withColumn("models", every.scalar())
    return (
        scored.select(key, "x", F.inline("models"))
        .withColumns(_predictions(F.col("x"), targets, ""))
        .select(key, F.col("fold").alias("model_id"), *targets)
    )


def score_batches(
    df: DataFrame,
    make_predict_fn: Callable[[], Callable],
    input_cols: Sequence[str],
    return_type,
    batch_size: int = 32,
    input_shapes: list[list[int]] | None = None,
    out: str = "prediction",
) -> DataFrame:
    """Add the output of a user's model, called on batches of at most ``batch_size`` rows.

    ``make_predict_fn`` runs once per Python worker and loads the model; the function it
    returns maps numpy batches to one output row per input row.  Rows keep their keys.
    """
    from pyspark.ml.functions import predict_batch_udf

    score = predict_batch_udf(
        make_predict_fn,
        return_type=return_type,
        batch_size=batch_size,
        input_tensor_shapes=input_shapes,
    )
    return df.withColumn(out, score(*[F.col(c) for c in input_cols]))


def keeping(load_model: Callable[[str], Callable], most: int) -> Callable[[str], Callable]:
    """``load_model`` that keeps the ``most`` models used last, so a worker's memory is bounded."""
    from functools import lru_cache

    return lru_cache(maxsize=most)(load_model)


def stacked(
    paths: Sequence[str], load_model: Callable[[str], Callable], most: int = MODELS_IN_MEMORY
) -> Callable:
    """A ``make_predict_fn`` that puts the outputs of several model files side by side.

    Models are loaded as they are needed and at most ``most`` stay in a worker; with more files,
    take larger batches, since each batch goes through all of them.
    """

    def make():
        model = keeping(load_model, most)

        def predict(*inputs):
            outputs = [np.asarray(model(path)(*inputs)) for path in paths]
            return np.concatenate([o.reshape(len(o), -1) for o in outputs], axis=1)

        return predict

    return make


def chosen_per_row(load_model: Callable[[str], Callable], most: int = MODELS_IN_MEMORY) -> Callable:
    """A ``make_predict_fn`` whose first input names the model file of each row."""

    def make():
        model = keeping(load_model, most)

        def predict(paths, *inputs):
            result = None
            for path in set(paths):
                rows = np.flatnonzero(paths == path)
                values = np.asarray(model(path)(*[x[rows] for x in inputs]))
                if result is None:
                    result = np.empty((len(paths), values.shape[1]))
                result[rows] = values
            return result

        return predict

    return make
