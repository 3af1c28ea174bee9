"""Cross-validation, training of one fold, and prediction of new data."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeflow.functions import text as text_fn
from gradeflow.functions.metrics import eval_metrics
from gradeflow.operators import fit, pairs, score, vocab
from gradeflow.operators.assemble import compose_prompt
from gradeflow.operators.ensemble import unpack_predictions
from gradeflow.operators.evaluate import evaluate, score_report
from gradeflow.operators.folds import ALL, fold_split, folds
from gradeflow.schemas import TARGET_COLUMNS, target_columns
from gradeflow.session import checkpointed
from gradeflow.sources import sinks
from gradeflow.sources.catalog import model_catalog, read_model_files, resolve_model

DEFAULT_PARTS = ("summary", "question")
LENGTH_FEATURES = ("log_chars", "log_tokens")


def length_features(df: DataFrame, parts: Sequence[str] = DEFAULT_PARTS) -> DataFrame:
    """Add the composed text's log length in characters and in tokens, and both as an array."""
    composed = compose_prompt(df, parts)
    return (
        composed.withColumn("log_chars", F.log1p(F.length("input_text")))
        .withColumn("log_tokens", F.log1p(F.size(text_fn.tokens(F.col("input_text")))))
        .withColumn("features", F.array(*LENGTH_FEATURES))
        .drop("input_text")
    )


def word_features(df: DataFrame, words: DataFrame, size: int, col: str = "text") -> DataFrame:
    """Add the counts of ``size`` vocabulary words as an array column ``features``."""
    tokenised = vocab.tokenise(df.select("student_id", col), col)
    bags = vocab.vocab_features(tokenised, words)
    zeros = F.array_repeat(F.lit(0.0), size)
    return df.join(vocab.dense_features(bags, size), "student_id", "left").withColumn(
        "features", F.coalesce("features", zeros)
    )


def feature_table(
    df: DataFrame, columns: Sequence[str] = ("features",), purpose: str = "features"
) -> DataFrame:
    """Keys, targets and features, written once: fitting and scoring both read this narrow
    table instead of going through the texts again."""
    narrow = ["student_id", "prompt_id", *[t for t in TARGET_COLUMNS if t in df.columns]]
    return checkpointed(df.sparkSession, df.select(*narrow, *columns), purpose)


def out_of_fold(data: DataFrame, features: str = "features", lam: float = 1.0) -> DataFrame:
    """Every row scored for both targets by the ridge model that did not see its prompt."""
    return score.oof_predict(data, fit.fit_logo(data, features, lam=lam), features)


def cross_validate(data: DataFrame, features: str = "features", lam: float = 1.0) -> DataFrame:
    """Fold, macro and pooled scores of the out-of-fold predictions."""
    return score_report(out_of_fold(data, features, lam))


def validate(predictions: DataFrame) -> DataFrame:
    """Score report of a stored out-of-fold table."""
    return score_report(predictions)


def write_evaluated(
    predictions: DataFrame, path: str, target: str = "both", fmt: str = "parquet", prefix: str = "eval_"
) -> DataFrame:
    """Write predictions and give their metrics, as ``evaluate`` does, from the same single pass.

    The metrics are observed while the rows are written; as the writing tasks are the last of their
    job, a task that is run again is counted once.
    """
    columns = eval_metrics(target)
    seen = Observation(f"metrics-{uuid.uuid4().hex}")
    observed = predictions.observe(seen, *[c.alias(prefix + name) for name, c in columns.items()])
    sinks.write_predictions(observed, path, fmt)
    found = seen.get
    layout = ", ".join(f"`{prefix}{name}` double" for name in columns)
    return predictions.sparkSession.createDataFrame([tuple(found.get(prefix + name) for name in columns)], layout)


def out_of_fold_from_files(
    data: DataFrame, directory: str, features: str | Sequence[str] = "features"
) -> DataFrame:
    """Out-of-fold predictions by the model files of a folder, one per fold of ``data``.

    Each row gets a vector of predictions of the model that did not see its prompt, which is
    then unpacked into a column per target.
    """
    chosen = resolve_model(model_catalog(data.sparkSession, directory), folds(data))
    models = read_model_files(chosen, directory)
    scored = score.oof_predict(data, models, features, prefix="from_file_")
    vector = F.array(*[f"from_file_{t}" for t in TARGET_COLUMNS])
    unpacked = unpack_predictions(scored.withColumn("prediction", vector), "prediction")
    return unpacked.select(*data.columns, *[f"predicted_{t}" for t in TARGET_COLUMNS])


def train_fold(
    data: DataFrame,
    fold: str,
    loss: str = "mse",
    target: str = "both",
    features: str = "features",
    lam: float = 1.0,
    seed: int = 666,
    run_id: str | None = None,
    model_name: str = "ridge",
    save_dir: str | None = None,
    log_path: str | None = None,
    threshold: float = 0.5,
    epoch: int = 1,
    save_strategy: str = "last",
) -> tuple[DataFrame, DataFrame | None]:
    """Fit one fold and evaluate it on the prompt left out: ``(models, metrics or None)``.

    ``mse``, ``rmse`` and ``mcrmse`` have the same best linear model and share one fit;
    ``huber`` and ``smoothl1`` are fitted by reweighting with the loss's own ``threshold``,
    ``ranking`` on seeded pairs, ``ranking_squares`` on all pairs of rows of one prompt.  Fold ``"all"`` trains on every row and is not evaluated.
    ``save_strategy`` and ``epoch`` are those of ``save_models``.
    """
    targets = target_columns(target)
    train, valid = fold_split(data, fold)
    if loss in ("mse", "rmse", "mcrmse"):
        models = fit.fit_all(train, features, targets, lam)
    elif loss in ("huber", "smoothl1"):
        one = [fit.fit_robust(train, ALL, t, threshold, features) for t in targets]
        models = one[0] if len(one) == 1 else one[0].unionByName(one[1])
    elif loss == "ranking_squares":
        models = fit.fit_rank_pairs(train, features, targets, lam).filter(F.col("fold") == ALL)
    elif loss == "ranking":
        pairing = pairs.pair_rows(train, targets=targets, seed=seed)
        sides = pairs.attach_sides(pairing, train, [features])
        one = [fit.fit_rank(sides, t, features) for t in targets]
        models = one[0] if len(one) == 1 else one[0].unionByName(one[1])
    else:
        raise ValueError(f"no fit for loss {loss!r}")
    models = models.withColumn("fold", F.lit(fold))

    metrics = None
    if valid is not None:
        predicted = score.predict_ensemble(valid, models, features, targets, prefix="predicted_")
        metrics = evaluate(predicted, target)
    if save_dir is not None:
        sinks.save_models(models, save_dir, run_id or "run", model_name, epoch, save_strategy)
    if log_path is not None and metrics is not None:
        sinks.append_metrics(sinks.metric_rows(metrics, run_id or "run", epoch, epoch), log_path)
    return models, metrics


def predict(
    data: DataFrame,
    models: DataFrame,
    features: str = "features",
    targets: Sequence[str] = TARGET_COLUMNS,
    allow_missing: bool = False,
) -> DataFrame:
    """Submission table: mean prediction of all models for each new response.

    Models may predict both targets or one each.  A target without a model is an error unless
    ``allow_missing``, which leaves it NULL.
    """
    wanted = models.filter(F.col("target").isin(list(targets)))
    have = {r.target for r in wanted.select("target").distinct().collect()}
    if not allow_missing and not set(targets) <= have:
        raise ValueError(f"no model predicts {sorted(set(targets) - have)}")
    scored = score.predict_ensemble(data, models, features, targets)
    return scored.select("student_id", *targets)


def predict_with_files(
    data: DataFrame,
    files: DataFrame,
    load_model: Callable[[str], Callable],
    input_cols: Sequence[str],
    batch_size: int = 32,
    input_shapes: list[list[int]] | None = None,
    allow_missing: bool = False,
) -> DataFrame:
    """Submission table from a catalogue of model files of any kind.

    ``load_model(path)`` returns a function from numpy batches to predictions: two columns for a
    file without a ``target``, one for a file of a single target.  Each target is the mean over the
    files that predict it; a target without any is an error unless ``allow_missing``, which leaves
    it NULL.  The rows are read and batched once for all files.
    """
    target = F.col("target") if "target" in files.columns else F.lit(None).cast("string")
    # one entry per model file
    found = sorted(
        {(r.path, r.target) for r in files.select("path", target.alias("target")).collect()},
        key=lambda file: (file[1] or "", file[0]),
    )
    if not found:
        raise FileNotFoundError("no model files")
    places: dict[str, list[int]] = {t: [] for t in TARGET_COLUMNS}
    width = 0
    for _, kind in found:
        for t in [kind] if kind else TARGET_COLUMNS:
            places[t].append(width)
            width += 1
    missing = [t for t in TARGET_COLUMNS if not places[t]]
    if missing and not allow_missing:
        raise ValueError(f"no model predicts {missing}")
    scored = score.score_batches(
        data,
        score.stacked([path for path, _ in found], load_model),
        input_cols,
        T.ArrayType(T.DoubleType()),
        batch_size,
        input_shapes,
        "stacked",
    )

    def mean(at: list[int]):
        if not at:
            return F.lit(None).cast("double")
        picked = F.transform(F.array(*[F.lit(i) for i in at]), lambda i: F.get(F.col("stacked"), i))
        return F.aggregate(picked, F.lit(0.0), lambda total, v: total + v) / len(at)

    return scored.select("student_id", *[mean(places[t]).alias(t) for t in TARGET_COLUMNS])


def out_of_fold_with_files(
    data: DataFrame,
    catalog: DataFrame,
    load_model: Callable[[str], Callable],
    input_cols: Sequence[str],
    batch_size: int = 32,
    input_shapes: list[list[int]] | None = None,
) -> DataFrame:
    """Out-of-fold predictions from one model file per fold.

    Each row learns its file by a join on the fold id and stays where it is, so a fold holding a
    third of all rows is scored by all tasks.  A worker loads the files its rows ask for.
    """
    chosen = resolve_model(catalog, folds(data)).select(
        F.col("fold").alias("prompt_id"), F.col("path").alias("model_path")
    )
    scored = score.score_batches(
        data.join(chosen, "prompt_id"),
        score.chosen_per_row(load_model),
        ["model_path", *input_cols],
        T.ArrayType(T.DoubleType()),
        batch_size,
        None if input_shapes is None else [None, *input_shapes],
        "prediction",
    )
    unpacked = unpack_predictions(scored, "prediction")
    return unpacked.select(*data.columns, *[f"predicted_{t}" for t in TARGET_COLUMNS])
