"""Model files by name, and metrics observed while writing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import evaluate, fit, score
from gradeflow.plans import workflows
from gradeflow.sources import catalog, sinks


def test_model_files_round_trip(spark, skewed, tmp_path):
    models = fit.fit_logo(skewed)
    sinks.write_model_files(models, f"{tmp_path}/both", "run1", "ridge/three", epoch=2)
    found = catalog.model_catalog(spark, f"{tmp_path}/both")
    assert {r.fold for r in found.collect()} == {r.prompt_id for r in skewed.select("prompt_id").distinct().collect()}
    assert {(r.run_id, r.model, r.epoch, r.target) for r in found.collect()} == {("run1", "ridge_three", 2, None)}
    key = ["fold", "target", "n", "intercept", "weights"]
    stored = catalog.read_model_files(found, f"{tmp_path}/both").select(key).collect()
    assert sorted(map(tuple, stored)) == sorted(map(tuple, models.select(key).collect()))
    one = catalog.read_model_files(found, f"{tmp_path}/both", fold="hot")
    assert {r.fold for r in one.collect()} == {"hot"}
    oof = workflows.out_of_fold_from_files(skewed, f"{tmp_path}/both").orderBy("student_id").collect()
    same = score.oof_predict(skewed, models).orderBy("student_id").collect()
    assert [(r.student_id, r.predicted_content, r.predicted_wording) for r in oof] == [
        (r.student_id, r.predicted_content, r.predicted_wording) for r in same
    ]


def test_model_files_of_one_target(spark, skewed, tmp_path):
    sinks.write_model_files(fit.fit_logo(skewed), str(tmp_path), "run1", "ridge", by_target=True)
    found = catalog.single_target_models(catalog.model_catalog(spark, str(tmp_path)))
    assert {r.target for r in found.collect()} == {"content", "wording"}
    models = catalog.read_model_files(found, str(tmp_path))
    assert models.count() == found.count() == fit.fit_logo(skewed).count()
    with pytest.raises(FileNotFoundError):
        catalog.resolve_model(found, ["hot", "unheard-of"])


def test_models_too_large_for_files(skewed, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "MODEL_FILE_BYTES", 10)
    with pytest.raises(ValueError, match="exceed"):
        sinks.write_model_files(fit.fit_logo(skewed), str(tmp_path), "run1", "ridge")


@pytest.mark.parametrize(("target", "fmt"), [("both", "parquet"), ("wording", "csv")])
def test_metrics_are_observed_in_the_writing_pass(spark, skewed, tmp_path, target, fmt):
    predicted = workflows.out_of_fold(skewed).drop("features").cache()
    expected = evaluate.evaluate(predicted, target).first().asDict()
    found = workflows.write_evaluated(predicted, f"{tmp_path}/oof", target, fmt)
    assert found.columns == list(expected)
    assert found.first().asDict() == {k: pytest.approx(v, abs=1e-12) for k, v in expected.items()}
    stored = spark.read.format(fmt).option("header", True).load(f"{tmp_path}/oof")
    assert stored.count() == predicted.count() and stored.columns == predicted.columns


def test_missing_predictions_show_in_observed_metrics(spark, skewed, tmp_path):
    predicted = workflows.out_of_fold(skewed).drop("features")
    spoilt = predicted.withColumn("predicted_content", F.when(F.col("student_id") != "s3", F.col("predicted_content")))
    row = workflows.write_evaluated(spoilt, f"{tmp_path}/oof").first()
    assert row.eval_MCRMSE != row.eval_MCRMSE and row.eval_WordingRMSE == row.eval_WordingRMSE
