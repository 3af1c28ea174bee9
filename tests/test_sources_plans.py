from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeflow.operators import evaluate, fit, folds, meters
from gradeflow.operators.assemble import assemble
from gradeflow.plans import load, workflows
from gradeflow.schemas import NA_TOKENS
from gradeflow.session import scratch_dir, spread
from gradeflow.sources import catalog, sinks, tables
from gradeflow.streaming import meter, scoring
from registry import bindings, spark_queries

AWKWARD = '''prompt_id,text,content
"a","line1
line ""q"" x",1.5
,"NA",2
"b","",
"c",null,3
"7e5",x,N/A
'''


def test_awkward_csv(spark, tmp_path):
    path = tmp_path / "awkward.csv"
    path.write_text(AWKWARD)
    schema = T.StructType(
        [
            T.StructField("content", T.DoubleType()),
            T.StructField("prompt_id", T.StringType()),
            T.StructField("text", T.StringType()),
        ]
    )
    rows = {tuple(r) for r in tables.read_table(spark, str(path), schema).collect()}
    assert rows == {
        (1.5, "a", 'line1\nline "q" x'),
        (2.0, None, "NA"),
        (None, "b", None),
        (3.0, "c", "null"),
        (None, "7e5", "x"),
    }


def test_garbage_in_a_number_is_an_error(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("student_id,prompt_id,text,content,wording\n1,a,x,high,1\n")
    from gradeflow.schemas import RESPONSES_TRAIN

    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.read_table(spark, str(path), RESPONSES_TRAIN).collect()
    with pytest.raises(ValueError, match="no column"):
        tables.read_table(spark, str(path), T.StructType([T.StructField("essay", T.StringType())]))
    assert "" in NA_TOKENS


@pytest.fixture
def folder(tmp_path):
    """A small competition-style folder with four prompts."""
    rng = np.random.default_rng(0)
    prompts = ["prompt_id,prompt_title,prompt_question,prompt_text"]
    train = ["student_id,prompt_id,text,content,wording"]
    test = ["student_id,prompt_id,text"]
    for p in range(4):
        body = " ".join(f"Sentence {i} about the {'sea' if i % 2 else 'land'}." for i in range(40))
        prompts.append(f'p{p},Title {p},"What, ""exactly"", is {p}?","{body}"')
        for i in range(15):
            n = int(rng.integers(3, 30))
            text = "the sea and the land " * n
            train.append(f'{p}-{i},p{p},"{text}teh end",{n / 10},{-n / 20}')
            test.append(f'{p}-{i}-t,p{p},"{text}"')
    for name, lines in {
        "prompts_train": prompts, "prompts_test": prompts, "summaries_train": train, "summaries_test": test,
    }.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return str(tmp_path)


def test_load_data(spark, folder):
    train = load.load_data(spark, folder, train=True)
    assert train.count() == 60 and train.columns[-2:] == ["content", "wording"]
    assert train.first().prompt_question.startswith('What, "exactly", is')
    test = load.load_data(spark, folder, train=False)
    assert test.count() == 60 and "content" not in test.columns
    assert test.filter("reference_summary <> ''").count() == 0
    full = load.load_data(spark, folder, autocorrect_spelling=True, summarise=True)
    assert full.columns == train.columns and full.count() == 60
    assert full.filter(F.length("reference_summary") == 0).count() == 0
    assert full.filter(F.length("reference_summary") >= F.length("prompt_text")).count() == 0
    with pytest.raises(ValueError):
        tables.read_prompts(spark, folder, "dev")


def test_parquet_twin(spark, folder, tmp_path):
    twin = str(tmp_path / "twin")
    for name, read in (("prompts", tables.read_prompts), ("summaries", tables.read_responses)):
        read(spark, folder, "train").write.parquet(f"{twin}/{name}_train.parquet")
    csv = load.load_data(spark, folder)
    parquet = load.load_data(spark, twin, fmt="parquet")
    assert csv.exceptAll(parquet).isEmpty() and parquet.count() == csv.count()


def test_from_files_to_submission(spark, folder, tmp_path):
    data = workflows.feature_table(workflows.length_features(load.load_data(spark, folder)))
    oof = workflows.out_of_fold(data, lam=0.01)
    assert oof.count() == 60
    report = {r.level: r for r in workflows.validate(oof).filter("level <> 'fold'").collect()}
    assert report["oof"].MCRMSE < 0.3
    assert workflows.cross_validate(data, lam=0.01).count() == 6

    models = fit.fit_logo(data, lam=0.01)
    sinks.save_models(models, str(tmp_path / "models"), "run", "ridge/base")
    stored = sinks.load_models(spark, str(tmp_path / "models/run-ridge_base"))
    assert stored.count() == 8
    new = workflows.length_features(load.load_data(spark, folder, train=False))
    submission = workflows.predict(new, stored)
    path = str(tmp_path / "submission")
    sinks.write_predictions(submission, path, "csv")
    back = spark.read.csv(path, header=True, inferSchema=True)
    assert back.columns == ["student_id", "content", "wording"] and back.count() == 60


@pytest.mark.parametrize("loss", ["mse", "rmse", "mcrmse", "huber", "smoothl1", "ranking"])
def test_train_fold(spark, skewed, loss, tmp_path):
    models, metrics = workflows.train_fold(
        skewed, "hot", loss, lam=0.1, run_id="r", log_path=str(tmp_path / "log"),
        save_dir=str(tmp_path / "models"),
    )
    assert {r.target for r in models.collect()} == {"content", "wording"}
    row = metrics.first().asDict()
    assert set(row) == {"eval_MCRMSE", "eval_ContentRMSE", "eval_WordingRMSE"}
    if loss != "ranking":
        assert row["eval_MCRMSE"] < 0.2
    log = sinks.read_metrics(spark, str(tmp_path / "log"), "r")
    assert log.count() == 3
    assert sinks.load_models(spark, str(tmp_path / "models/r-ridge")).count() == 2


def test_train_on_everything_is_not_evaluated(skewed):
    models, metrics = workflows.train_fold(skewed, "all", target="wording", lam=0.1)
    assert metrics is None and [r.fold for r in models.collect()] == ["all"]
    with pytest.raises(ValueError):
        workflows.train_fold(skewed, "hot", "hinge")


def test_model_files_of_any_kind(spark, skewed, tmp_path):
    def load_line(path):
        """A toy model file: two numbers, slope and offset."""
        from urllib.parse import urlparse

        with open(urlparse(path).path) as file:
            slope, offset = map(float, file.read().split())
        return lambda x: np.stack([slope * x[:, 0] + offset, slope * x[:, 1] - offset], axis=1)

    names = sorted(r.fold for r in folds.folds(skewed).collect())
    for i, fold in enumerate(names):
        (tmp_path / f"r-m-{fold}.bin").write_text(f"{i + 1} {10 * i}")
    found = catalog.model_catalog(spark, str(tmp_path))
    oof = workflows.out_of_fold_with_files(skewed, found, load_line, ["features"], 16, [[3]])
    assert oof.columns == [*skewed.columns, "predicted_content", "predicted_wording"]
    assert oof.count() == 900
    for r in oof.collect():
        i = names.index(r.prompt_id)
        assert r.predicted_content == pytest.approx((i + 1) * r.features[0] + 10 * i)
        assert r.predicted_wording == pytest.approx((i + 1) * r.features[1] - 10 * i)
    mean = workflows.predict_with_files(skewed, found, load_line, ["features"], 16, [[3]])
    x = {r.student_id: r.features for r in skewed.collect()}
    for r in mean.collect():
        assert r.content == pytest.approx(4.5 * x[r.student_id][0] + 35)
    with pytest.raises(FileNotFoundError):
        missing = found.filter("fold <> 'hot'")
        workflows.out_of_fold_with_files(skewed, missing, load_line, ["features"], 16, [[3]])


def test_single_target_models(skewed):
    models = fit.fit_logo(skewed)
    both = workflows.predict(skewed, models)
    assert both.columns == ["student_id", "content", "wording"]
    only = models.filter("target = 'content'")
    with pytest.raises(ValueError, match="wording"):
        workflows.predict(skewed, only)
    part = workflows.predict(skewed, only, allow_missing=True).first()
    assert part.wording is None and part.content is not None


def test_predictions_round_trip(spark, responses, prompts, tmp_path):
    scored = assemble(responses, prompts).withColumns(
        {"predicted_content": F.lit(0.25), "predicted_wording": F.lit(None).cast("double")}
    )
    scored = scored.withColumn("text", F.lit(' two\nlines, "quoted" '))
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        sinks.write_predictions(scored, path, fmt)
        back = tables.read_predictions(spark, path, fmt)
        assert back.columns == scored.columns
        # CSV cannot tell an empty text from a missing one
        expected = scored.withColumn("reference_summary", F.lit(None if fmt == "csv" else ""))
        assert sorted(map(str, back.collect())) == sorted(map(str, expected.collect()))
    sinks.write_predictions(scored, str(tmp_path / "parts"), partition_by=["prompt_id"])
    assert spark.read.parquet(str(tmp_path / "parts")).filter("prompt_id = '2'").count() == 1


def test_metrics_append(spark, tmp_path):
    path = str(tmp_path / "log")
    for epoch in (1, 2):
        row = spark.createDataFrame([(0.5, 0.25)], "MSE double, RMSE double")
        sinks.append_metrics(sinks.metric_rows(row, "run", epoch, 10 * epoch), path)
    rows = {(r.epoch, r.step, r.metric): r.value for r in sinks.read_metrics(spark, path).collect()}
    assert rows == {(1, 10, "MSE"): 0.5, (1, 10, "RMSE"): 0.25, (2, 20, "MSE"): 0.5, (2, 20, "RMSE"): 0.25}
    assert sinks.read_metrics(spark, path, "other").isEmpty()


def test_save_strategies(spark, skewed, tmp_path):
    models = fit.fit_logo(skewed)
    base = str(tmp_path)
    for epoch in (1, 2):
        sinks.save_models(models, base, "r", "a/b", epoch, "all")
        sinks.save_models(models, base, "r", "a/b", epoch, "last")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["r-a_b", "r-a_b-epoch1", "r-a_b-epoch2"]
    back = {(r.fold, r.target): r for r in sinks.load_models(spark, f"{base}/r-a_b").collect()}
    assert len(back) == models.count()
    for r in models.collect():
        assert back[r.fold, r.target].weights == pytest.approx(r.weights)
        assert back[r.fold, r.target].intercept == pytest.approx(r.intercept)
    with pytest.raises(ValueError):
        sinks.save_models(models, base, "r", "a", 1, "best")


def test_foreign_tables_are_not_models(spark, responses, tmp_path):
    responses.write.parquet(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="not a coefficient table"):
        sinks.load_models(spark, str(tmp_path / "x"))


def test_catalog(spark, tmp_path):
    inside = tmp_path / "39c16e"
    inside.mkdir()
    for name in (
        "g1-org_deberta-v3-base-39c16e.bin",
        "g1-org_deberta-v3-base-814d6b-epoch2.bin",
        "g0-content_model-814d6b.bin",
        "g1-wording-all.txt",
    ):
        (inside / name).write_bytes(b"x")
    found = catalog.model_catalog(spark, str(inside))
    rows = {r.file: r for r in found.collect()}
    assert len(rows) == 3
    first = rows["g1-org_deberta-v3-base-39c16e.bin"]
    assert (first.run_id, first.model, first.fold, first.epoch) == ("g1", "org_deberta-v3-base", "39c16e", None)
    assert rows["g1-org_deberta-v3-base-814d6b-epoch2.bin"].epoch == 2
    assert rows["g0-content_model-814d6b.bin"].target == "content"
    chosen = {r.fold: r.file for r in catalog.resolve_model(found, ["39c16e", "814d6b"]).collect()}
    # the folder is called like a fold; only file names count, the first by path wins
    assert chosen == {"39c16e": first.file, "814d6b": "g0-content_model-814d6b.bin"}
    with pytest.raises(FileNotFoundError):
        catalog.resolve_model(found, ["39c16e", "ebad26"])
    with pytest.raises(ValueError):
        catalog.single_target_models(found)
    assert catalog.single_target_models(found.filter("target = 'content'")).count() == 1


def test_scratch_folder_is_the_shared_one(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(shared)
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_spread_deals_rows_to_as_many_tasks_as_asked(spark):
    dealt = spread(spark.range(100, numPartitions=1), 6, "id").withColumn("task", F.spark_partition_id())
    assert dealt.count() == 100 and spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_csv_files_of_a_folder_are_read_by_name(spark, tmp_path):
    folder = tmp_path / "summaries_test.csv"
    folder.mkdir()
    (folder / "a.csv").write_text('student_id,prompt_id,text\n1,p1,"hello\nthere"\n')
    (folder / "b.csv").write_text("text,student_id,prompt_id\nworld,2,p2\n")
    rows = {r.student_id: (r.prompt_id, r.text) for r in tables.read_responses(spark, str(tmp_path), "test").collect()}
    assert rows == {"1": ("p1", "hello\nthere"), "2": ("p2", "world")}
    (folder / "c.csv").write_text("text,student_id\nworld,2\n")
    with pytest.raises(ValueError, match="same columns|no column"):
        tables.read_responses(spark, str(tmp_path), "test")


def test_broken_csv_records_are_errors(spark, tmp_path):
    (tmp_path / "summaries_test.csv").write_text("student_id,prompt_id,text\n1,p1\n2,p2,b\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_responses(spark, str(tmp_path), "test").collect()


def test_models_of_several_folds_or_targets(spark):
    rows = [(f, t, 3, 0.5, [float(i)]) for i, (f, t) in enumerate([("a", "content"), ("b", "content"), ("a", "wording")])]
    models = spark.createDataFrame(rows, fit.MODEL_SCHEMA)
    with pytest.raises(ValueError, match="content"):
        scoring.model_coefficients(models)
    one = scoring.model_coefficients(models.filter("fold = 'a'"))
    assert one == {"content": ([0.0], 0.5), "wording": ([2.0], 0.5)}
    third = models.unionByName(spark.createDataFrame([("a", "other", 3, 0.0, [1.0])], fit.MODEL_SCHEMA))
    data = spark.createDataFrame([("s", [1.0])], "student_id string, features array<double>")
    assert workflows.predict(data, third).count() == 1
    twice = models.unionByName(models.limit(1))
    held_out = data.withColumn("prompt_id", F.lit("a"))
    with pytest.raises(Exception, match="several models"):
        spark_queries.score.oof_predict(held_out, twice).collect()


def test_all_saved_runs_predict_together(spark, tmp_path):
    for run, value in (("r1", 1.0), ("r2", 3.0)):
        rows = [("a", t, 3, value, [0.0]) for t in ("content", "wording")]
        sinks.save_models(spark.createDataFrame(rows, fit.MODEL_SCHEMA), str(tmp_path), run, "m")
    models = sinks.load_runs(spark, str(tmp_path))
    assert {r.run for r in models.collect()} == {"r1-m", "r2-m"}
    data = spark.createDataFrame([("s", [1.0])], "student_id string, features array<double>")
    assert workflows.predict(data, models).first()[1:] == (2.0, 2.0)
    with pytest.raises(FileNotFoundError):
        sinks.load_runs(spark, str(tmp_path / "r1-m" / "fold=a"))


def test_files_of_one_target_average_apart(spark):
    files = spark.createDataFrame(
        [("b1", None), ("c1", "content"), ("c2", "content"), ("w1", "wording")], "path string, target string"
    )
    values = {"b1": [[1.0, 2.0]], "c1": [[3.0]], "c2": [[5.0]], "w1": [[8.0]]}

    def load_model(path):
        return lambda x: np.repeat(np.array(values[path]), len(x), axis=0)

    data = spark.createDataFrame([("s1", 0.0), ("s2", 0.0)], "student_id string, x double")
    rows = workflows.predict_with_files(data, files, load_model, ["x"]).collect()
    assert sorted(map(tuple, rows)) == [("s1", 3.0, 5.0), ("s2", 3.0, 5.0)]
    single = files.filter("target = 'content'")
    with pytest.raises(ValueError, match="wording"):
        workflows.predict_with_files(data, single, load_model, ["x"])
    half = workflows.predict_with_files(data, single, load_model, ["x"], allow_missing=True).first()
    assert (half.content, half.wording) == (4.0, None)


def test_workers_keep_few_models():
    loads = []

    def load_model(path):
        loads.append(path)
        return lambda x: np.full((len(x), 1), float(path))

    predict = spark_queries.score.stacked(["1", "2", "3"], load_model, most=3)()
    for _ in range(2):
        assert predict(np.zeros(2)).tolist() == [[1.0, 2.0, 3.0]] * 2
    assert loads == ["1", "2", "3"]
    predict = spark_queries.score.stacked(["1", "2", "3"], load_model, most=1)()
    predict(np.zeros(2))
    assert predict(np.zeros(2)).tolist() == [[1.0, 2.0, 3.0]] * 2


# --- rows that must not vanish ---


def test_null_keys_keep_their_place(spark):
    rows = [(None if i % 2 else f"s{i}", f"t{i}", float(i % 3), float(i % 5)) for i in range(20)]
    df = spark.createDataFrame(rows, "student_id string, text string, content double, wording double")
    batched = spark_queries.batches.assign_batches(df, 3, seed=1).collect()
    assert sorted(r.position for r in batched) == list(range(20))
    paired = spark_queries.pairs.pair_rows(df, carry=["text"]).collect()
    assert sorted(r.first_text for r in paired) == sorted(r.second_text for r in paired) == sorted(r[1] for r in rows)


def test_null_groups_in_meters_and_masked_groups_in_attention(spark):
    logs = spark.createDataFrame(
        [(None, 1, i, "m", float(i), 1) for i in (1, 2)] + [("r", 1, 1, "m", 4.0, 1)],
        "run_id string, epoch int, step long, metric string, val double, n long",
    )
    found = spark_queries.meters.running_meter(logs).collect()
    assert sorted(r.running for r in found) == [1.0, 1.5, 4.0]
    cells = spark.createDataFrame(
        [("a", 0, 0, [1.0]), ("a", 1, 0, [2.0]), ("b", 0, 1, [3.0]), (None, 0, 1, [4.0])],
        "group string, pos int, mask int, embedding array<double>",
    )
    attended = spark_queries.pooling.attend(cells, [1.0], masked=True).collect()
    assert sorted((str(r.group), r.attention) for r in attended) == [("None", 1.0), ("a", 0.0), ("a", 0.0), ("b", 1.0)]


# --- streams ----------------------------------------------------------------


def test_late_rows_are_dropped_and_windows_updated(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "ts timestamp, metric string, val double, n int"

    def batch(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        query = meter.write_meter(
            meter.stream_meter(stream, "1 hour", "30 minutes"), out, str(tmp_path / "checkpoint")
        )
        query.awaitTermination()

    def at(hour, minute=0):
        return dt.datetime(2024, 1, 1, hour, minute)

    batch([(at(1), "MSE", 1.0, 2), (at(1, 30), "MSE", 4.0, 1), (at(2), "MSE", 8.0, 1)])
    batch([(at(1, 45), "MSE", 6.0, 1), (at(9), "MSE", 3.0, 1)])
    batch([(at(2), "MSE", 99.0, 1), (at(9, 10), "MSE", 5.0, 1)])  # the first is far too late
    rows = {r.window_start.hour: (r.avg, r.n) for r in meter.read_meter(spark, out).collect()}
    assert rows == {1: (3.0, 4), 2: (8.0, 1), 9: (4.0, 2)}
    logs = spark.read.parquet(str(source)).filter("val < 99")
    whole = meters.weighted_mean(logs.withColumn("h", F.hour("ts")), ["h"]).collect()
    assert {r.h: (r.avg, r.n) for r in whole} == rows


def test_stream_scores_equal_batch_scores(spark, folder, tmp_path):
    data = workflows.length_features(load.load_data(spark, folder))
    model = fit.fit_all(data, lam=0.01)
    test = tables.read_responses(spark, folder, "test")
    test.repartition(3).write.parquet(str(tmp_path / "stream"))
    stream = spark.readStream.schema(test.schema).option("maxFilesPerTrigger", 1)
    scored = scoring.stream_score(
        stream.parquet(str(tmp_path / "stream")),
        tables.read_prompts(spark, folder, "test"),
        scoring.model_coefficients(model),
        workflows.length_features,
    )
    out = str(tmp_path / "scores")
    scoring.write_scores(scored, out, str(tmp_path / "checkpoint")).awaitTermination()
    live = {r.student_id: r.content for r in spark.read.parquet(out).collect()}
    batch = workflows.predict(
        workflows.length_features(load.load_data(spark, folder, train=False)), model
    )
    assert live == pytest.approx({r.student_id: r.content for r in batch.collect()})


# --- plans ------------------------------------------------------------------

SMALL = f"{TESTDATA}/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_prompts_are_broadcast_and_columns_pruned(spark):
    text = plan(spark_queries.everything(spark, SMALL).select("student_id", "prompt_title"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert re.search(r"ReadSchema: struct<doc_id:bigint,source:string>", text)


def test_large_prompt_tables_are_not_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark_queries.everything(spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_fold_filter_reaches_both_scans(spark):
    _, valid = folds.fold_split(spark_queries.train(spark, SMALL), "src3", check=False)
    assert "EqualTo(source,src3)" in plan(valid)


def test_ordering_windows_are_partitioned(spark):
    for name in ("pair_rows", "assign_batches"):
        text = plan(spark_queries.QUERIES[name](spark, SMALL))
        # the only single partition is the table of at most 65,536 bucket rows
        assert text.count("Exchange SinglePartition") == 1
        assert "hashpartitioning(order_bucket" in text


def test_report_needs_no_job_before_it_runs_and_no_second_pass(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("report", "building a report")
    report = spark_queries.QUERIES["score_report"](spark, SMALL)
    assert len(tracker.getJobIdsForGroup("report")) <= 3  # the schemas of three tables
    spark.sparkContext.setJobGroup("other", "")
    stored = workflows.feature_table(spark_queries.train_features(spark, SMALL), ["log_chars"])
    scored = spark_queries.score.oof_predict(stored, fit.fit_logo_line(stored, "log_chars"), ["log_chars"])
    by_rows = {(r.level, r.fold): r for r in evaluate.score_report(scored).collect()}
    for row in report.collect():
        assert abs(row.MCRMSE - by_rows[row.level, row.fold].MCRMSE) < 1e-6


def test_no_cross_joins_anywhere(spark):
    eager = {"fold_huber", "rank_fit", "stream_meter", "stream_score", "logo_ridge_words"}
    for name, query in spark_queries.QUERIES.items():
        if name in eager:
            continue
        text = plan(query(spark, SMALL))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_bindings_use_every_prompt(spark):
    assert bindings.prompts(spark, SMALL).count() == bindings.table(spark, SMALL, "benchmark").count()
