"""Fitting leave-one-prompt-out regressors from sums that add up across folds.

The model that scores fold ``f`` is fitted on everything but ``f``.  All its sums are the grand
total minus the sums of ``f``, so one pass over the data fits every fold, however unequal
the folds are: a fold holding a third of the rows is still only one row of partial sums per task.
Models are plans like any other table: the sums per fold are one shuffle, which Spark reuses for
the total and for each fold.

Products are summed of values less their mean over all rows, so a feature whose mean is large
against its spread loses no digits.  That mean is one more aggregate over the features; store a
narrow feature table first where they are costly to make.  Rows with a missing or NaN feature are left
out (:func:`unusable_rows` counts them), and features of unequal length are an error.

A model table has one row per ``(fold, target)``: ``fold, target, n, intercept, weights``.
The fold ``"all"`` is the model of the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeflow.functions import vectors
from gradeflow.operators.folds import ALL
from gradeflow.operators.pairs import present

# A task hands on its partial sums once they hold this many bytes.
PARTIAL_BYTES = 64 << 20

MODEL_SCHEMA = T.StructType(
    [
        T.StructField("fold", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("intercept", T.DoubleType()),
        T.StructField("weights", T.ArrayType(T.DoubleType())),
    ]
)


def complete_rows(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Rows whose targets are all present."""
    for target in targets:
        df = df.filter(present(target))
    return df


def fit_logo_mean(
    df: DataFrame, targets: Sequence[str] = ("content", "wording"), key: str = "prompt_id"
) -> DataFrame:
    """Models without features: the mean target of all other folds."""
    usable = complete_rows(df, targets)
    sums = usable.groupBy(F.col(key).alias("fold")).agg(
        F.count("*").alias("n"), *[F.sum(F.col(t).cast("double")).alias(t) for t in targets]
    )
    total = sums.agg(F.sum("n").alias("n"), *[F.sum(t).alias(t) for t in targets])
    rest = sums.withColumn(
        "total", total.select(F.struct("n", *targets)).scalar()
    ).withColumn("rest_n", F.col("total.n") - F.col("n"))
    models = [
        F.struct(
            F.lit(t).alias("target"),
            F.try_divide(F.col("total")[t] - F.col(t), F.col("rest_n")).alias("intercept"),
        )
        for t in targets
    ]
    return rest.filter(F.col("fold").isNotNull()).select(
        "fold", F.col("rest_n").alias("n"), F.explode(F.array(*models)).alias("model")
    ).select(
        "fold",
        "model.target",
        "n",
        "model.intercept",
        F.array().cast("array<double>").alias("weights"),
    )


def fit_logo_line(
    df: DataFrame,
    feature: str,
    targets: Sequence[str] = ("content", "wording"),
    key: str = "prompt_id",
    centre: float | None = None,
    include_all: bool = False,
) -> DataFrame:
    """Least-squares lines on one feature, one per held-out fold, in built-in aggregates.

    Products are summed about ``centre``, the mean of the feature over all rows if not given.
    """
    usable = complete_rows(df, [*targets, feature])
    if centre is None:
        middle = F.coalesce(usable.agg(F.avg(F.col(feature).cast("double")).alias("mean")).scalar(), F.lit(0.0))
    else:
        middle = F.lit(float(centre))
    x = F.col(feature).cast("double") - middle
    ys = {t: F.col(t).cast("double") for t in targets}
    per_fold = usable.groupBy(F.col(key).alias("fold")).agg(
        F.count("*").alias("n"),
        F.sum(x).alias("sx"),
        F.sum(x * x).alias("sxx"),
        *[F.sum(y).alias(f"sy_{t}") for t, y in ys.items()],
        *[F.sum(x * y).alias(f"sxy_{t}") for t, y in ys.items()],
    )
    names = [c for c in per_fold.columns if c != "fold"]
    total = per_fold.agg(*[F.sum(c).alias(c) for c in names])
    held_out = (
        per_fold.filter(F.col("fold").isNotNull())
        .withColumn("total", total.select(F.struct(*names)).scalar())
        .select("fold", *[(F.col("total")[c] - F.col(c)).alias(c) for c in names])
    )
    if include_all:
        held_out = held_out.unionByName(total.withColumn("fold", F.lit(ALL)))

    def line(t: str):
        # NULL where a lone fold leaves no rows to fit on
        mx, my = F.try_divide("sx", "n"), F.try_divide(f"sy_{t}", "n")
        slope = F.try_divide(
            F.col(f"sxy_{t}") - F.col("sx") * my, F.col("sxx") - F.col("sx") * mx
        )
        # without spread in the feature the line is flat
        slope = F.coalesce(slope, F.lit(0.0))
        return F.struct(
            F.lit(t).alias("target"),
            (my - slope * (mx + middle)).alias("intercept"),
            F.array(slope).alias("weights"),
        )

    return (
        held_out.select("fold", "n", F.explode(F.array(*[line(t) for t in targets])).alias("model"))
        .filter(F.col("model.intercept").isNotNull())
        .select("fold", "model.target", "n", "model.intercept", "model.weights")
    )


def line_statistics(
    df: DataFrame,
    feature: str,
    targets: Sequence[str] = ("content", "wording"),
    key: str = "prompt_id",
    centre: float = 0.0,
) -> DataFrame:
    """Squared errors of every fold under the line fitted on all others, from sums alone.

    The error of a line is a quadratic form of a fold's count, sums and sums of products, so the
    rows are read once and neither models nor predictions are made.  Lines are fitted on rows that have
    all targets and the feature; a target's errors are those of all rows that have it and the feature, and
    ``n_rows`` counts every row.  Give a ``centre`` near the mean
    of a feature whose mean is large against its spread.  One row per fold with complete rows here and elsewhere:
    ``fold, n_rows, <target>_sum, <target>_n``.
    """
    x = F.col(feature).cast("double") - F.lit(float(centre))
    ys = {t: F.col(t).cast("double") for t in targets}
    complete = present(feature)
    for t in targets:
        complete = complete & present(t)

    def total_of(rows: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(rows, value)), F.lit(0.0))

    def own(t: str) -> list[Column]:
        rows, y = present(feature) & present(t), ys[t]
        parts = {"sx": x, "sxx": x * x, "sy": y, "syy": y * y, "sxy": x * y}
        count = F.count(F.when(rows, 1)).alias(f"own_n_{t}")
        return [count, *[total_of(rows, v).alias(f"own_{name}_{t}") for name, v in parts.items()]]

    per_fold = df.groupBy(F.col(key).alias("fold")).agg(
        F.count("*").alias("n_rows"),
        F.count(F.when(complete, 1)).alias("n"),
        total_of(complete, x).alias("sx"),
        total_of(complete, x * x).alias("sxx"),
        *[total_of(complete, y).alias(f"sy_{t}") for t, y in ys.items()],
        *[total_of(complete, x * y).alias(f"sxy_{t}") for t, y in ys.items()],
        *[c for t in targets for c in own(t)],
    )
    names = [c for c in per_fold.columns if c != "fold"]
    total = per_fold.agg(*[F.sum(c).alias(c) for c in names]).select(F.struct(*names)).scalar()
    folds = per_fold.filter(F.col("fold").isNotNull()).withColumn("total", total)

    def rest(name: str) -> Column:
        return F.col("total")[name] - F.col(name)

    def squared_error(t: str) -> Column:
        mx, my = F.try_divide(rest("sx"), rest("n")), F.try_divide(rest(f"sy_{t}"), rest("n"))
        slope = F.try_divide(rest(f"sxy_{t}") - rest("sx") * my, rest("sxx") - rest("sx") * mx)
        slope = F.coalesce(slope, F.lit(0.0))
        start = my - slope * mx
        error = (
            F.col(f"own_syy_{t}") - 2 * start * F.col(f"own_sy_{t}") - 2 * slope * F.col(f"own_sxy_{t}")
            + F.col(f"own_n_{t}") * start * start + 2 * start * slope * F.col(f"own_sx_{t}")
            + slope * slope * F.col(f"own_sxx_{t}")
        )
        return F.greatest(error, F.lit(0.0))

    return folds.filter((F.col("n") > 0) & (rest("n") > 0)).select(
        "fold",
        "n_rows",
        *[squared_error(t).alias(f"{t}_sum") for t in targets],
        *[F.col(f"own_n_{t}").alias(f"{t}_n") for t in targets],
    )


def _upper_products(z: np.ndarray) -> np.ndarray:
    gram = z.T @ z
    return gram[np.triu_indices(gram.shape[0])]


def _summed(partials: Iterator[tuple[str | None, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Add up arrays per fold, holding only so many folds at a time."""
    held: dict[str | None, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        names, values = pa.array(list(held), pa.string()), list(held.values())
        flat = pa.array(np.concatenate(values), pa.float64())
        offsets = np.arange(len(values) + 1, dtype="int32") * len(values[0])
        products = pa.ListArray.from_arrays(pa.array(offsets), flat)
        held.clear()
        return pa.RecordBatch.from_arrays([names, products], names=["fold", "products"])

    for fold, products in partials:
        if fold in held:
            held[fold] += products
        else:
            held[fold] = products.copy()
        if len(held) * products.nbytes > PARTIAL_BYTES:
            yield flush()
    if held:
        yield flush()


def _partial_grams(n_targets: int):
    """Products of ``[1, features, targets]`` per fold of the rows of a task, each row times its
    weight, the last column."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, np.ndarray]]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = batch.columns
            folds = columns[0].dictionary_encode()
            codes = folds.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            names = folds.dictionary.to_pylist()
            features = columns[1].flatten().to_numpy(zero_copy_only=False)
            targets = [c.to_numpy(zero_copy_only=False) for c in columns[2 : 2 + n_targets]]
            z = np.column_stack(
                [np.ones(batch.num_rows), features.reshape(batch.num_rows, -1), *targets]
            )
            z *= np.sqrt(columns[2 + n_targets].to_numpy(zero_copy_only=False))[:, None]
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-2))
            for rows in np.split(order, starts[1:]):
                code = codes[rows[0]]
                yield (None if code < 0 else names[code]), _upper_products(z[rows])

    return lambda batches: _summed(products(batches))


def _merge_partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the partial sums that several tasks found for the same folds."""

    def partials() -> Iterator[tuple[str | None, np.ndarray]]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            yield from zip(
                batch.column(0).to_pylist(), values.reshape(batch.num_rows, -1), strict=True
            )

    return _summed(partials())


def _finite(features: str) -> Column:
    """Whether a row has features and all of them are numbers."""
    bad = F.exists(F.col(features), lambda x: x.isNull() | F.isnan(x.cast("double")))
    return F.coalesce(~bad, F.lit(False))


def unusable_rows(
    df: DataFrame, features: str = "features", targets: Sequence[str] = ("content", "wording")
) -> DataFrame:
    """One row: ``n_rows`` in all, and ``n_left_out`` of fits for a missing or NaN value."""
    usable = _finite(features)
    for target in targets:
        usable = usable & F.coalesce(present(target), F.lit(False))
    return df.agg(F.count("*").alias("n_rows"), F.count(F.when(~usable, 1)).alias("n_left_out"))


def feature_means(df: DataFrame, features: str = "features") -> Column:
    """The mean of each feature over all rows with features, as one value of the plan."""
    cells = df.filter(_finite(features)).select(F.size(features).alias("size"), F.posexplode(features).alias("i", "x"))
    per_feature = cells.groupBy("i").agg(
        F.avg(F.col("x").cast("double")).alias("mean"), F.min("size").alias("low"), F.max("size").alias("high")
    )
    ragged = F.raise_error(F.lit("features have unequal lengths")).cast("array<double>")
    # one item per feature
    means = F.array_sort(F.collect_list(F.struct("i", "mean")))["mean"]
    return per_feature.agg(F.when(F.min("low") == F.max("high"), means).otherwise(F.when(F.count("*") > 0, ragged)).alias("means")).scalar()


def fold_gram(
    df: DataFrame,
    features: str = "features",
    targets: Sequence[str] = ("content", "wording"),
    key: str = "prompt_id",
    means: Column | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """Sums of products per fold: ``(fold, cell, value)``.

    With ``z = [1, features, targets]`` the cells are the upper triangle of the sum of
    ``z z'``, row by row; ``means`` are taken off the features first, and a row counts ``weight``
    times (once if not given).  Tasks send one partial triangle per fold.  Partials are brought
    together by fold in partitions of a set size, so those of a hot fold spread over several
    tasks, and are added up there while they stream through; the last step sums what is left as
    plain cells.
    """
    values = F.col(features).cast("array<double>")
    if means is not None:
        df = df.withColumn("means_", means)
        values = F.zip_with(values, "means_", lambda x, mean: x - mean)
    usable = complete_rows(df, targets).filter(_finite(features)).select(
        F.col(key).cast("string").alias("fold"),
        values.alias("features"),
        *[F.col(t).cast("double").alias(t) for t in targets],
        (F.lit(1.0) if weight is None else weight).alias("weight_"),
    )
    layout = "fold string, products array<double>"
    partial = usable.mapInArrow(_partial_grams(len(targets)), layout)
    merged = partial.hint("rebalance", "fold").mapInArrow(_merge_partials, layout)
    return (
        merged.select("fold", F.posexplode("products").alias("cell", "value"))
        .groupBy("fold", "cell")
        .agg(F.sum("value").alias("value"))
    )


def _solver(targets: Sequence[str], lam: float):
    """Ridge solution of one fold from its triangle; the intercept is not shrunk."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        given = pdf.loc[pdf["cell"] == 0, "means"].iloc[0]  # on the first cell only
        shift = np.asarray(given if given is not None else [], float)
        values = pdf.sort_values("cell")["value"].to_numpy()
        size = int((np.sqrt(8 * len(values) + 1) - 1) / 2)
        gram = np.zeros((size, size))
        gram[np.triu_indices(size)] = values
        gram = gram + np.triu(gram, 1).T
        d = size - len(targets)  # intercept and features
        n = gram[0, 0]
        if n < 0.5:  # a lone fold leaves nothing to be fitted on
            return pd.DataFrame(columns=MODEL_SCHEMA.names)
        mean = gram[0] / n
        # sums about the means
        centred = gram - n * np.outer(mean, mean)
        a = centred[1:d, 1:d] + lam * np.eye(d - 1)
        b = centred[1:d, d:]
        weights = np.linalg.lstsq(a, b, rcond=None)[0]
        intercept = mean[d:] - (mean[1:d] + shift) @ weights
        return pd.DataFrame(
            {
                "fold": pdf["fold"].iloc[0],
                "target": list(targets),
                "n": round(float(n)),
                "intercept": intercept,
                "weights": [weights[:, j].tolist() for j in range(len(targets))],
            }
        )

    return solve


def fit_logo(
    df: DataFrame,
    features: str = "features",
    targets: Sequence[str] = ("content", "wording"),
    lam: float = 1.0,
    key: str = "prompt_id",
    include_all: bool = False,
) -> DataFrame:
    """Ridge regressors on an array of features, one per held-out fold, in one pass.

    ``lam`` is the weight decay: it shrinks the weights, not the intercept.
    """
    means = feature_means(complete_rows(df, targets), features)
    gram = fold_gram(df, features, targets, key, means)
    total = gram.groupBy("cell").agg(F.sum("value").alias("total"))
    rest = (
        gram.filter(F.col("fold").isNotNull())
        .join(total, "cell")
        .select("fold", "cell", (F.col("total") - F.col("value")).alias("value"))
    )
    if include_all:
        rest = rest.unionByName(total.select(F.lit(ALL).alias("fold"), "cell", F.col("total").alias("value")))
    # a group is one triangle of products
    return rest.withColumn("means", F.when(F.col("cell") == 0, means)).groupBy("fold").applyInPandas(_solver(targets, lam), MODEL_SCHEMA)


def fit_all(
    df: DataFrame,
    features: str = "features",
    targets: Sequence[str] = ("content", "wording"),
    lam: float = 1.0,
) -> DataFrame:
    """One ridge regressor per target on every row (fold ``"all"``)."""
    whole = df.withColumn("fold_all", F.lit(ALL))
    means = feature_means(complete_rows(df, targets), features)
    gram = fold_gram(whole, features, targets, "fold_all", means)
    return gram.withColumn("means", F.when(F.col("cell") == 0, means)).groupBy("fold").applyInPandas(_solver(targets, lam), MODEL_SCHEMA)


def fit_line_all(
    df: DataFrame, feature: str, targets: Sequence[str] = ("content", "wording")
) -> DataFrame:
    """One least-squares line per target on every row (fold ``"all"``)."""
    x = F.col(feature).cast("double")
    lines = []
    for t in targets:
        y = F.col(t).cast("double")
        slope = F.coalesce(F.regr_slope(y, x), F.lit(0.0))
        lines.append(
            F.struct(
                F.lit(t).alias("target"),
                F.count("*").alias("n"),
                (F.avg(y) - slope * F.avg(x)).alias("intercept"),
                F.array(slope).alias("weights"),
            )
        )
    fitted = complete_rows(df, [*targets, feature]).agg(F.array(*lines).alias("models"))
    return fitted.select(F.lit(ALL).alias("fold"), F.inline("models"))


def fit_fold(
    df: DataFrame,
    fold: str,
    target: str,
    features: str = "features",
    loss: str = "huber",
    lam: float = 0.0,
    epsilon: float = 1.35,
    max_iter: int = 100,
    key: str = "prompt_id",
) -> DataFrame:
    """Regressor of one fold by iterative optimisation: ``squaredError`` or ``huber``.

    ``epsilon`` is the robust threshold in units of the residual scale, which is fitted too.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    from gradeflow.operators.folds import fold_split

    train, _ = fold_split(complete_rows(df, [target]), fold, key)
    rows = train.select(
        array_to_vector(F.col(features).cast("array<double>")).alias("x"),
        F.col(target).cast("double").alias("y"),
    )
    estimator = LinearRegression(
        featuresCol="x", labelCol="y", loss=loss, regParam=lam, epsilon=epsilon, maxIter=max_iter,
        solver="auto" if loss == "squaredError" else "l-bfgs",
    )
    # the optimiser goes over the rows again and again: keep the narrow table, not the texts
    rows = rows.persist()
    try:
        n = rows.count()
        model = estimator.fit(rows)
    finally:
        rows.unpersist()
    spark = df.sparkSession
    row = (fold, target, n, float(model.intercept), model.coefficients.tolist())
    return spark.createDataFrame([row], MODEL_SCHEMA)


def fit_robust(
    df: DataFrame,
    fold: str,
    target: str,
    threshold: float,
    features: str = "features",
    lam: float = 0.0,
    steps: int = 30,
    key: str = "prompt_id",
) -> DataFrame:
    """Regressor of one fold under Huber's loss with an absolute threshold.

    Smooth L1 with the same threshold is this loss divided by it, so the best model is the same.
    Each step weighs a row by ``min(1, threshold / |error|)`` and solves the weighted least squares
    from sums of products; the first step is plain least squares.  A step is one pass over the
    rows: store a narrow feature table first.  The driver sees the sums only.
    """
    from gradeflow.operators.folds import fold_split

    if threshold <= 0:
        raise ValueError("threshold must be positive")
    train, _ = fold_split(complete_rows(df, [target]), fold, key)
    train = train.filter(_finite(features)).withColumn("fold_all", F.lit(ALL))
    x, y = F.col(features).cast("array<double>"), F.col(target).cast("double")
    means, solve, weight, model = feature_means(train, features), _solver([target], lam), None, None
    shift = train.select(means.alias("means")).first()
    if shift is None:
        raise ValueError("no rows to fit on")
    for _ in range(steps):
        # as many numbers as there are pairs of features
        cells = fold_gram(train, features, [target], "fold_all", means, weight).toPandas()
        cells["means"] = [shift["means"]] * len(cells)
        model = solve(cells).iloc[0]
        error = F.abs(y - vectors.linear(x, vectors.literal(model["weights"]), F.lit(float(model["intercept"]))))
        weight = F.when(error > threshold, F.lit(float(threshold)) / error).otherwise(1.0)
    row = (fold, target, train.count(), float(model["intercept"]), [float(w) for w in model["weights"]])
    return df.sparkSession.createDataFrame([row], MODEL_SCHEMA)


def fit_rank(
    pairs: DataFrame,
    target: str,
    features: str = "features",
    lam: float = 0.01,
    max_iter: int = 100,
) -> DataFrame:
    """Pairwise ranking weights ``w`` with ``sign(w . (x1 - x2)) = label``.

    ``pairs`` carries ``first_features``, ``second_features`` and ``label_<target>``.  Ties say
    nothing about the direction and are left out.  The hinge loss is the margin loss of the rest.
    """
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    gap = F.zip_with(
        f"first_{features}", f"second_{features}", lambda a, b: a.cast("double") - b.cast("double")
    )
    rows = pairs.filter(F.col(f"label_{target}") != 0).select(
        array_to_vector(gap).alias("x"),
        F.when(F.col(f"label_{target}") > 0, 1.0).otherwise(0.0).alias("y"),
    )
    estimator = LinearSVC(
        featuresCol="x", labelCol="y", regParam=lam, maxIter=max_iter, fitIntercept=False
    )
    model = estimator.fit(rows)
    row = (ALL, target, None, 0.0, model.coefficients.tolist())
    return pairs.sparkSession.createDataFrame([row], MODEL_SCHEMA)


def _pair_products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per group, half the sum of ``(z_a - z_b)(z_a - z_b)'`` over all its rows a and b, from the group's sums."""
    for pdf in batches:
        sums = []
        for products in pdf["products"]:
            size = int((np.sqrt(8 * len(products) + 1) - 1) / 2)
            n, first = products[0], products[:size]
            row, column = np.triu_indices(size)
            cells = n * products - first[row] * first[column]
            # the cell of the constant has no difference: it counts the pairs
            cells[0] = n * (n - 1) / 2
            sums.append(cells)
        yield pd.DataFrame({"fold": pdf["fold"], "products": sums})


def pair_gram(
    df: DataFrame,
    features: str = "features",
    targets: Sequence[str] = ("content", "wording"),
    group: str = "prompt_id",
) -> DataFrame:
    """Products of differences of all pairs of rows of a group: ``(fold, cell, value)``, a group as a fold.

    With ``z = [1, features, targets]`` of a group of ``n`` rows, the sum over its pairs of
    ``(z_a - z_b)(z_a - z_b)'`` is ``n`` times the sum of ``z z'`` less the product of the sums of ``z``.
    So no pair is ever made: one pass, whatever the sizes of the groups.  The first cell is the number of
    pairs.  Features and targets are taken about their means over all rows, which no difference sees.
    Rows without a group, a target or a feature pair with none.
    """
    usable = complete_rows(df, targets).filter(F.col(group).isNotNull() & _finite(features))
    middles = usable.agg(F.struct(*[F.avg(F.col(t).cast("double")).alias(t) for t in targets])).scalar()
    shifted = usable.withColumn("middles_", middles).withColumns(
        {t: F.col(t).cast("double") - F.col("middles_")[t] for t in targets}
    )
    gram = fold_gram(shifted, features, targets, group, feature_means(usable, features))
    # a group is one triangle of products
    triangles = gram.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("cell", "value")))["value"].alias("products"))
    pairs = triangles.mapInPandas(_pair_products, "fold string, products array<double>")
    return pairs.select("fold", F.posexplode("products").alias("cell", "value"))


def _rank_solver(targets: Sequence[str], lam: float):
    """Ranking weights of one fold from the products of its pairs."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("cell")["value"].to_numpy()
        size = int((np.sqrt(8 * len(values) + 1) - 1) / 2)
        gram = np.zeros((size, size))
        gram[np.triu_indices(size)] = values
        gram = gram + np.triu(gram, 1).T
        d = size - len(targets)
        if values[0] < 0.5:  # no pair is left
            return pd.DataFrame(columns=MODEL_SCHEMA.names)
        weights = np.linalg.lstsq(gram[1:d, 1:d] + lam * np.eye(d - 1), gram[1:d, d:], rcond=None)[0]
        return pd.DataFrame(
            {
                "fold": pdf["fold"].iloc[0],
                "target": list(targets),
                "n": round(float(values[0])),
                "intercept": 0.0,
                "weights": [weights[:, j].tolist() for j in range(len(targets))],
            }
        )

    return solve


def fit_rank_pairs(
    df: DataFrame,
    features: str = "features",
    targets: Sequence[str] = ("content", "wording"),
    lam: float = 1.0,
    key: str = "prompt_id",
    include_all: bool = True,
) -> DataFrame:
    """Ranking weights from all pairs of rows of one prompt, one model per held-out prompt and ``"all"``.

    Minimises the sum over pairs of ``((y_a - y_b) - w . (x_a - x_b))^2`` plus ``lam |w|^2``: the squared
    form of the ranking loss, which sums per prompt hold completely.  ``n`` is the number of pairs; the
    intercept, which no order depends on, is 0.
    """
    gram = pair_gram(df, features, targets, key)
    total = gram.groupBy("cell").agg(F.sum("value").alias("total"))
    rest = gram.join(total, "cell").select("fold", "cell", (F.col("total") - F.col("value")).alias("value"))
    if include_all:
        rest = rest.unionByName(total.select(F.lit(ALL).alias("fold"), "cell", F.col("total").alias("value")))
    return rest.groupBy("fold").applyInPandas(_rank_solver(targets, lam), MODEL_SCHEMA)
