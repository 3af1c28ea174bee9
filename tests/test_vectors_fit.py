from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeflow.operators import ensemble, evaluate, fit, pairs, pooling, score

VECTORS = "group string, pos int, mask int, embedding array<float>"


@pytest.fixture
def three(spark):
    rows = [("g", 0, 1, [1.0, -2.0]), ("g", 1, 1, [3.0, -4.0]), ("g", 2, 0, [9.0, 9.0])]
    return spark.createDataFrame(rows, VECTORS)


def pooled(df, name, **options):
    return {r.group: r.pooled for r in pooling.pool(df, name, **options).collect()}


def test_pooling_golden_values(three):
    assert pooled(three, "mean")["g"] == [2.0, -3.0]
    assert pooled(three, "max")["g"] == [3.0, -1e-9]
    assert pooled(three, "max", fill=-100.0)["g"] == [3.0, -2.0]
    assert pooled(three, "gemtext")["g"] == pytest.approx([2.410142, 1e-6], abs=1e-6)
    assert pooled(three, "context")["g"] == [1.0, -2.0]
    with pytest.raises(ValueError):
        pooling.pool(three, "median")


def test_all_masked_mean_is_zero(spark):
    df = spark.createDataFrame([("g", 0, 0, [1.0, 2.0])], VECTORS)
    assert pooled(df, "mean")["g"] == [0.0, 0.0]


@pytest.mark.parametrize("masked", [False, True])
def test_attention_equals_numpy(spark, masked):
    rng = np.random.default_rng(1)
    w, v = rng.normal(size=(4, 4)), 30 * rng.normal(size=4)
    rows, h, mask = [], rng.normal(size=(2, 50, 4)), rng.integers(0, 2, size=(2, 50))
    h = h.astype("float32").astype("float64")
    for g in range(2):
        for i in range(50):
            rows.append((f"g{g}", i, int(mask[g, i]), h[g, i].tolist()))
    df = spark.createDataFrame(rows, VECTORS)
    out = {
        (r.group, r.pos): (r.attention, r.embedding)
        for r in pooling.attend(df, v.tolist(), w.tolist(), masked=masked).collect()
    }
    for g in range(2):
        s = np.tanh(h[g] @ w.T) @ v
        s = np.where(mask[g] == 0, -np.inf, s) if masked else s
        a = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        for i in range(50):
            assert out[f"g{g}", i][0] == pytest.approx(a[i], abs=1e-12)
            assert out[f"g{g}", i][1] == pytest.approx((a[i] * h[g, i]).tolist(), abs=1e-12)


# --- fitting ----------------------------------------------------------------


def arrays(df):
    rows = df.collect()
    fold = np.array([r.prompt_id for r in rows])
    x = np.array([r.features for r in rows])
    y = np.array([[r.content, r.wording] for r in rows])
    return fold, x, y


def ridge(x, y, lam):
    mx, my = x.mean(0), y.mean(0)
    a = (x - mx).T @ (x - mx) + lam * np.eye(x.shape[1])
    w = np.linalg.solve(a, (x - mx).T @ (y - my))
    return w, my - mx @ w


def test_ridge_of_every_fold_equals_numpy(skewed):
    fold, x, y = arrays(skewed)
    models = {(r.fold, r.target): r for r in fit.fit_logo(skewed, lam=2.0, include_all=True).collect()}
    assert len(models) == 2 * (len(set(fold)) + 1)
    for f in [*set(fold), "all"]:
        keep = fold != f
        w, b = ridge(x[keep], y[keep], 2.0)
        for j, target in enumerate(["content", "wording"]):
            assert models[f, target].weights == pytest.approx(w[:, j].tolist(), abs=1e-8)
            assert models[f, target].intercept == pytest.approx(b[j], abs=1e-8)
            assert models[f, target].n == keep.sum()
    whole = {r.target: r for r in fit.fit_all(skewed, lam=2.0).collect()}
    assert whole["content"].weights == pytest.approx(models["all", "content"].weights)


def test_partial_sums_leave_a_task_early_without_loss(skewed, monkeypatch):
    monkeypatch.setattr(fit, "PARTIAL_BYTES", 1)
    few = {(r.fold, r.cell): r.value for r in fit.fold_gram(skewed).collect()}
    monkeypatch.undo()
    many = {(r.fold, r.cell): r.value for r in fit.fold_gram(skewed.repartition(6)).collect()}
    assert few.keys() == many.keys()
    for cell, value in few.items():
        assert many[cell] == pytest.approx(value, rel=1e-9, abs=1e-9)


def test_lines_equal_least_squares(skewed):
    one = skewed.withColumn("x", F.col("features")[0])
    fold, x, y = arrays(skewed)
    for centre in (0.0, 5.0):
        models = fit.fit_logo_line(one, "x", centre=centre, include_all=True).collect()
        for m in models:
            keep = fold != m.fold
            column = 0 if m.target == "content" else 1
            slope, intercept = np.polyfit(x[keep, 0], y[keep, column], 1)
            assert m.weights[0] == pytest.approx(slope, abs=1e-9)
            assert m.intercept == pytest.approx(intercept, abs=1e-9)
    whole = {r.target: r for r in fit.fit_line_all(one, "x").collect()}
    slope, intercept = np.polyfit(x[:, 0], y[:, 1], 1)
    assert whole["wording"].weights[0] == pytest.approx(slope)
    assert whole["wording"].intercept == pytest.approx(intercept)


def test_mean_baseline(spark):
    rows = [("1", "a", 1.0, 1.0), ("2", "a", 3.0, 3.0), ("3", "b", 5.0, 5.0)]
    df = spark.createDataFrame(rows, "student_id string, prompt_id string, content double, wording double")
    scored = score.oof_predict(df, fit.fit_logo_mean(df), [])
    assert {r.student_id: r.predicted_content for r in scored.collect()} == {"1": 5.0, "2": 5.0, "3": 2.0}
    report = {r.level: r for r in evaluate.score_report(scored).filter("fold is null").collect()}
    assert report["oof"].MCRMSE == pytest.approx(3.109126, abs=1e-6)


@pytest.mark.parametrize("make", ["mean", "line", "ridge"])
def test_a_lone_fold_has_no_model(spark, make):
    rows = [(str(i), "a", [float(i)], float(i), 1.0) for i in range(4)]
    df = spark.createDataFrame(
        rows, "student_id string, prompt_id string, features array<double>, content double, wording double"
    ).withColumn("x", F.col("features")[0])
    models = {
        "mean": lambda: fit.fit_logo_mean(df),
        "line": lambda: fit.fit_logo_line(df, "x"),
        "ridge": lambda: fit.fit_logo(df),
    }[make]()
    assert [r for r in models.collect() if r.intercept is not None] == []


def test_missing_targets_are_not_fitted_on(spark, skewed):
    bad = spark.createDataFrame(
        [("n1", "hot", [9.0, 9.0, 9.0], float("nan"), 1.0), ("n2", None, [1.0, 1.0, 1.0], None, 0.0)],
        skewed.schema,
    )
    clean = {(r.fold, r.target): r.intercept for r in fit.fit_logo(skewed).collect()}
    mixed = {(r.fold, r.target): r.intercept for r in fit.fit_logo(skewed.unionByName(bad)).collect()}
    assert mixed == pytest.approx(clean)


def test_each_row_is_scored_once_by_a_model_that_did_not_see_it(skewed):
    models = fit.fit_logo(skewed, lam=0.1)
    scored = score.oof_predict(skewed, models)
    assert scored.count() == skewed.count()
    fold, x, y = arrays(skewed)
    w, b = ridge(x[fold != "hot"], y[fold != "hot"], 0.1)
    row = scored.filter("prompt_id = 'hot'").first()
    assert row.predicted_wording == pytest.approx((np.array(row.features) @ w + b)[1], abs=1e-8)
    assert evaluate.oof_score(scored).first().MCRMSE < 0.15


def test_ensemble_equals_the_mean_of_all_models(skewed):
    models = fit.fit_logo(skewed)
    fast = {r.student_id: (r.content, r.wording) for r in score.predict_ensemble(skewed, models).collect()}
    each = score.predict_each(skewed, models)
    assert each.count() == 900 * 8
    slow = ensemble.ensemble_mean(each)
    for r in slow.collect():
        assert fast[r.student_id] == pytest.approx((r.content, r.wording), abs=1e-9)


def test_ensemble_by_target(spark):
    rows = [("s", "content", 1.0), ("s", "content", 3.0), ("s", "wording", 5.0)]
    df = spark.createDataFrame(rows, "student_id string, target string, prediction double")
    row = ensemble.ensemble_by_target(df).first()
    assert (row.content, row.wording) == (2.0, 5.0)
    only = df.filter("target = 'content'")
    with pytest.raises(ValueError, match="wording"):
        ensemble.ensemble_by_target(only)
    assert ensemble.ensemble_by_target(only, allow_missing=True).first().wording is None


def test_unpack(spark):
    df = spark.createDataFrame([("s", [1.5, 2.5])], "student_id string, p array<double>")
    row = ensemble.unpack_predictions(df, "p").first()
    assert (row.predicted_content, row.predicted_wording) == (1.5, 2.5)


@pytest.mark.parametrize("loss", ["huber", "squaredError"])
def test_iterative_fit_of_one_fold(skewed, loss):
    row = fit.fit_fold(skewed, "hot", "content", loss=loss).first()
    assert row.n == 540
    assert row.weights == pytest.approx([0.5, -1.0, 0.25], abs=0.05)


def test_rank_fit_orders_like_the_target(skewed):
    paired = pairs.attach_sides(pairs.pair_rows(skewed), skewed, ["features"])
    w = np.array(fit.fit_rank(paired, "content", max_iter=30).first().weights)
    truth = np.array([0.5, -1.0, 0.25])
    assert w @ truth / np.linalg.norm(w) / np.linalg.norm(truth) > 0.95


def test_batches_reach_the_model_whole_and_keep_their_keys(spark):
    rows = [(f"s{i}", [float(i), 1.0]) for i in range(70)]
    df = spark.createDataFrame(rows, "student_id string, embedding array<float>").repartition(2)

    def model():
        def predict(x):
            assert x.ndim == 2 and len(x) <= 16
            return np.stack([x.sum(axis=1), x.max(axis=1)], axis=1)

        return predict

    out = score.score_batches(df, model, ["embedding"], T.ArrayType(T.DoubleType()), 16, [[2]])
    found = {r.student_id: r.prediction for r in out.collect()}
    assert len(found) == 70
    assert all(found[f"s{i}"] == [i + 1.0, max(float(i), 1.0)] for i in range(70))
    # a last batch of one row is a row like any other
    assert score.score_batches(
        df.limit(1), model, ["embedding"], T.ArrayType(T.DoubleType()), 16, [[2]]
    ).first().prediction


def test_ridge_with_a_large_mean_and_rows_without_numbers(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300)
    rows = [(f"s{i}", f"p{i % 4}", [1e8 + float(v)], 2.0 * float(v), -float(v)) for i, v in enumerate(x)]
    rows += [("bad", "p0", [float("nan")], 1.0, 1.0), ("none", "p1", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "student_id string, prompt_id string, features array<double>, content double, wording double")
    for models in (fit.fit_logo(df, lam=0.0), fit.fit_all(df, lam=0.0)):
        for row in models.collect():
            assert abs(row.weights[0] - (2.0 if row.target == "content" else -1.0)) < 1e-6
    counted = fit.unusable_rows(df).first()
    assert (counted.n_rows, counted.n_left_out) == (302, 2)
    for row in fit.fit_logo_line(df.filter("student_id like 's%'").withColumn("x", F.col("features")[0]), "x").collect():
        assert abs(row.weights[0] - (2.0 if row.target == "content" else -1.0)) < 1e-6
    ragged = df.unionByName(df.limit(1).withColumn("features", F.array(F.lit(1.0), F.lit(2.0))))
    with pytest.raises(Exception, match="unequal lengths"):
        fit.fit_logo(ragged).collect()


def test_robust_fit_is_the_least_loss(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 2))
    y = 1.0 + x @ [0.5, -2.0] + rng.normal(scale=0.1, size=200) + 5.0 * (rng.random(200) < 0.1)
    rows = [(f"p{i % 3}", [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "prompt_id string, features array<double>, content double")
    model = fit.fit_robust(df, "all", "content", 0.3, steps=40).first()
    error = y - model.intercept - x @ np.array(model.weights)
    slope = np.clip(error, -0.3, 0.3)
    assert abs(slope.sum()) < 1e-3 and np.abs(slope @ x).max() < 1e-3
    assert model.n == 200
    with pytest.raises(ValueError):
        fit.fit_robust(df, "all", "content", 0.0)


def test_report_from_sums_scores_rows_with_one_target(spark):
    from gradeflow.operators import evaluate, fit, score

    nan = float("nan")
    rows = [(f, float(i), 0.5 * i + (i * i) % 7, 2.0 - 0.1 * i + i % 3) for i, f in enumerate("aaaabbbbccccc")]
    rows += [("a", 3.5, None, 4.0), ("b", 2.5, 9.0, nan), ("c", None, 1.0, 1.0), ("c", nan, 1.0, 1.0), ("d", 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "prompt_id string, x double, content double, wording double")
    scored = score.oof_predict(df, fit.fit_logo_line(df, "x"), ["x"])
    by_rows = {(r.level, r.fold): r for r in evaluate.score_report(scored).collect()}
    by_sums = {(r.level, r.fold): r for r in evaluate.report_from_statistics(fit.line_statistics(df, "x", centre=5.0)).collect()}
    assert by_rows.keys() == by_sums.keys() and by_sums["fold", "a"].n_rows == 5 and by_sums["fold", "c"].n_rows == 7
    for level, r in by_rows.items():
        assert by_sums[level].n_rows == r.n_rows
        assert all(abs(by_sums[level][s] - r[s]) < 1e-9 for s in evaluate.SCORES)


def test_wide_ridge_carries_its_means_once(spark):
    """250 features: 32,000 cells a fold, of which one holds the means."""
    rng, d = np.random.default_rng(4), 250
    x = rng.normal(size=(600, d)) + 50
    y = x[:, :5].sum(axis=1)
    rows = [(f"s{i}", "pq"[i % 2], x[i].tolist(), float(y[i]), float(-y[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "student_id string, prompt_id string, features array<double>, content double, wording double")
    for r in fit.fit_logo(df, lam=2.0).filter("target = 'content'").collect():
        rest = np.array([i for i in range(600) if "pq"[i % 2] != r.fold])
        centred = x[rest] - x[rest].mean(axis=0)
        w = np.linalg.solve(centred.T @ centred + 2.0 * np.eye(d), centred.T @ (y[rest] - y[rest].mean()))
        assert r.weights == pytest.approx(w.tolist(), abs=1e-7)
        assert r.intercept == pytest.approx(y[rest].mean() - x[rest].mean(axis=0) @ w, abs=1e-5)
