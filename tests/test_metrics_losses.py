from __future__ import annotations

import math

import pytest

from gradeflow.functions.losses import get_loss
from gradeflow.operators import evaluate, meters
from gradeflow.schemas import target_columns

NAN = float("nan")
SCORED = "prompt_id string, content double, wording double, predicted_content double, predicted_wording double"


def scored(spark, rows):
    return spark.createDataFrame(rows, SCORED)


def loss_values(spark, name, rows, threshold=0.5):
    df = spark.createDataFrame(rows, "c double, w double, pc double, pw double")
    columns = get_loss(name, threshold).columns(["pc", "pw"], ["c", "w"])
    return df.agg(*[v.alias(k) for k, v in columns.items()]).first().asDict()


def single(spark, name, error, threshold):
    df = spark.createDataFrame([(0.0, float(error))], "t double, p double")
    columns = get_loss(name, threshold).columns(["p"], ["t"])
    return df.agg(*columns.values()).first()[0]


def test_mcrmse_of_perfect_and_unit_errors(spark):
    perfect = scored(spark, [("a", 1.0, 2.0, 1.0, 2.0)] * 3)
    assert evaluate.oof_score(perfect).first().MCRMSE == 0.0
    unit = scored(spark, [("a", 0.0, 0.0, 1.0, 1.0)] * 3)
    row = evaluate.oof_score(unit).first()
    assert (row.MCRMSE, row.ContentRMSE, row.WordingRMSE) == (1.0, 1.0, 1.0)


def test_score_report_levels(spark):
    # leave-one-prompt-out means: a (1, 3) is predicted 5, b (5) is predicted 2
    rows = [("a", 1.0, 1.0, 5.0, 5.0), ("a", 3.0, 3.0, 5.0, 5.0), ("b", 5.0, 5.0, 2.0, 2.0)]
    report = {(r.level, r.fold): r for r in evaluate.score_report(scored(spark, rows)).collect()}
    assert report["fold", "a"].MCRMSE == pytest.approx(3.162278, abs=1e-6)
    assert report["fold", "b"].MCRMSE == pytest.approx(3.0)
    assert report["cv", None].MCRMSE == pytest.approx(3.081139, abs=1e-6)
    assert report["oof", None].MCRMSE == pytest.approx(3.109126, abs=1e-6)
    assert report["oof", None].n_rows == 3


def test_one_fold_makes_macro_and_pooled_equal(spark):
    rows = [("a", float(i), 1.0, 0.5, 0.0) for i in range(5)]
    report = {r.level: r for r in evaluate.score_report(scored(spark, rows)).collect()}
    assert report["cv"].MCRMSE == pytest.approx(report["oof"].MCRMSE)
    assert report["cv"].MCRMSE == pytest.approx((report["cv"].ContentRMSE + report["cv"].WordingRMSE) / 2)


def test_rows_without_fold_count_only_in_the_pool(spark):
    rows = [("a", 0.0, 0.0, 1.0, 1.0), (None, 0.0, 0.0, 3.0, 3.0)]
    report = {(r.level, r.fold): r for r in evaluate.score_report(scored(spark, rows)).collect()}
    assert report["cv", None].MCRMSE == pytest.approx(1.0)
    assert report["oof", None].MCRMSE == pytest.approx(math.sqrt(5.0))
    assert evaluate.cv_score(scored(spark, rows)).first().n_folds == 1


@pytest.mark.parametrize("missing", [NAN, None])
def test_missing_values_skip_or_propagate(spark, missing):
    rows = [("a", missing, 0.0, 1.0, 2.0), ("a", 0.0, 0.0, 3.0, 2.0)]
    skipped = evaluate.oof_score(scored(spark, rows), "skip").first()
    assert (skipped.ContentRMSE, skipped.WordingRMSE) == (3.0, 2.0)
    kept = evaluate.oof_score(scored(spark, rows), "propagate").first()
    assert math.isnan(kept.ContentRMSE) and math.isnan(kept.MCRMSE) and kept.WordingRMSE == 2.0
    folds = evaluate.fold_scores(scored(spark, rows), nan_policy="skip").first()
    assert (folds.ContentRMSE, folds.WordingRMSE) == (3.0, 2.0)


def test_evaluate_prefixes_by_target(spark):
    rows = scored(spark, [("a", 0.0, 0.0, 1.0, 2.0)])
    assert evaluate.evaluate(rows, "wording").first().asDict() == {"eval_RMSE": 2.0}
    assert set(evaluate.evaluate(rows, "both").columns) == {
        "eval_MCRMSE", "eval_ContentRMSE", "eval_WordingRMSE",
    }
    with pytest.raises(ValueError):
        evaluate.evaluate(rows, "style")
    with pytest.raises(ValueError):
        target_columns("style")


def test_rmse_losses(spark):
    equal = loss_values(spark, "mcrmse", [(1.0, 2.0, 1.0, 2.0)])
    assert equal == pytest.approx({"MCRMSE": 1e-3, "C": 1e-3, "W": 1e-3})
    assert single(spark, "rmse", 0, 0.5) == pytest.approx(0.001)
    assert single(spark, "rmse", 1, 0.5) == pytest.approx(1.0000005, abs=1e-8)
    assert loss_values(spark, "mse", [(0.0, 0.0, 1.0, 3.0)])["MSE"] == 5.0


def test_thresholds_are_always_honoured(spark):
    assert single(spark, "huber", 0.5, 1.0) == 0.125
    assert single(spark, "huber", 2.0, 1.0) == 1.5
    assert single(spark, "smoothl1", 0.25, 0.5) == 0.0625
    assert single(spark, "smoothl1", 2.0, 0.5) == 1.75


@pytest.mark.parametrize(
    ("a", "b", "label", "expected"),
    [(0.1, 0.1, 0, 0.0), (0.1, 0.1, 1, 0.5), (1.0, 0.0, -1, 1.5), (1.0, 0.0, 1, 0.0), (1.0, 0.0, 0, 1.0)],
)
def test_tied_margin(spark, a, b, label, expected):
    df = spark.createDataFrame([(a, b, label)], "a double, b double, t int")
    column = get_loss("ranking", 0.5).pair_columns(["a"], ["b"], ["t"])["Ranking"]
    assert df.agg(column).first()[0] == pytest.approx(expected)


def test_loss_names():
    assert get_loss("mcrmse").metrics == ("MCRMSE", "C", "W")
    with pytest.raises(ValueError):
        get_loss("hinge")
    with pytest.raises(ValueError):
        get_loss("mcrmse").columns(["p"], ["t"])
    with pytest.raises(ValueError):
        get_loss("ranking").columns(["p"], ["t"])


LOG = "run_id string, epoch int, step bigint, metric string, val double, n bigint"


def log(spark, n_steps, epoch_steps=1000):
    rows = [
        ("r", (s - 1) // epoch_steps + 1, s, "MSE", float(s), 1) for s in range(1, n_steps + 1)
    ]
    return spark.createDataFrame(rows, LOG)


def test_weighted_mean(spark):
    rows = [("r", 1, 1, "MSE", 1.0, 2), ("r", 1, 2, "MSE", 4.0, 1)]
    assert meters.weighted_mean(spark.createDataFrame(rows, LOG), ["epoch"]).first().avg == 2.0


def test_running_meter_resets_after_each_interval(spark):
    running = meters.running_meter(log(spark, 5), 2).orderBy("step").collect()
    assert [r.running for r in running] == [1.0, 1.5, 3.0, 3.5, 5.0]
    logged = meters.interval_log(log(spark, 5), 2).orderBy("step").collect()
    assert [(r.step, r.running) for r in logged] == [(2, 1.5), (4, 3.5)]


def test_running_meter_over_an_epoch_is_summed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(meters, "BLOCK_STEPS", 3)
    rows = meters.running_meter(log(spark, 20, epoch_steps=11)).orderBy("step").collect()
    expected, total, count = [], 0.0, 0
    for step in range(1, 21):
        if step == 12:
            total, count = 0.0, 0
        total, count = total + step, count + 1
        expected.append(total / count)
    assert [r.running for r in rows] == pytest.approx(expected)


def test_interval_does_not_cross_epochs(spark):
    rows = meters.running_meter(log(spark, 6, epoch_steps=3), 2).orderBy("step").collect()
    # steps 3 and 4 share an interval but not an epoch
    assert [r.running for r in rows] == [1.0, 1.5, 3.0, 4.0, 5.0, 5.5]
