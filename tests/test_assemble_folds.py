from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import batches, folds, ordering, pairs
from gradeflow.operators.assemble import assemble, compose_prompt, select_targets
from gradeflow.schemas import ASSEMBLED_COLUMNS


def test_column_order(responses, prompts):
    assert assemble(responses, prompts, "train").columns == [*ASSEMBLED_COLUMNS, "content", "wording"]
    assert assemble(responses, prompts, "test").columns == ASSEMBLED_COLUMNS


def test_responses_without_prompt_drop(spark, responses, prompts):
    extra = spark.createDataFrame([("9", "none", "x", 0.0, 0.0)], responses.schema)
    assert assemble(responses.unionByName(extra), prompts).count() == 3


def test_duplicate_prompts_multiply_or_fail(responses, prompts):
    twice = prompts.unionByName(prompts.filter("prompt_id = '1'"))
    assert assemble(responses, twice).count() == 4
    with pytest.raises(ValueError, match="not unique"):
        assemble(responses, twice, validate="many_to_one")
    assert assemble(responses, prompts, validate="many_to_one").count() == 3


def test_null_keys_match_only_on_request(spark, responses, prompts):
    response = spark.createDataFrame([("9", None, "x", 0.0, 0.0)], responses.schema)
    prompt = spark.createDataFrame([(None, "t", "q", "p")], prompts.schema)
    assert assemble(response, prompt).count() == 0
    assert assemble(response, prompt, null_safe_keys=True).count() == 1


def test_compose(responses, prompts):
    data = assemble(responses, prompts)

    def texts(parts, **options):
        rows = compose_prompt(data, parts, **options).orderBy("student_id").collect()
        return [r.input_text for r in rows]

    assert texts(["summary", "question"])[0] == "<summary> a <question> a"
    assert texts(["question", "summary"])[1] == "<question> b <summary> b"
    assert texts(["title", "title"])[0] == "<title> f <title> f"
    assert texts(["text", "reference_summary"])[0] == "<text> d <reference> "
    assert texts([]) == ["", "", ""]
    with pytest.raises(ValueError):
        texts(["essay"])


def test_compose_null_parts(responses, prompts):
    data = assemble(responses, prompts).withColumn("prompt_title", F.lit(None).cast("string"))
    one = data.filter("student_id = '1'")
    skipped = compose_prompt(one, ["title", "summary"]).first().input_text
    assert skipped == "<summary> a"
    assert compose_prompt(one, ["title", "summary"], null_parts="null").first().input_text is None
    # parts that are not asked for do not matter
    assert compose_prompt(one, ["summary"], null_parts="null").first().input_text == "<summary> a"


def test_targets(responses):
    rows = select_targets(responses, "both").orderBy("student_id").collect()
    assert rows[1].labels == [0.5, 0.5]
    assert len(select_targets(responses, "content").first().labels) == 1


def test_fold_split(spark, responses):
    rows = responses.unionByName(spark.createDataFrame([("4", None, "d", 0.0, 0.0)], responses.schema))
    train, valid = folds.fold_split(rows, "2")
    assert {r.student_id for r in train.collect()} == {"1", "3", "4"}
    assert {r.student_id for r in valid.collect()} == {"2"}
    everything, nothing = folds.fold_split(rows, "all")
    assert everything.count() == 4 and nothing is None
    with pytest.raises(ValueError, match="not a fold"):
        folds.fold_split(rows, "7")


def test_fold_frames(skewed):
    sizes = {(r.fold, r.role): r.n_rows for r in folds.fold_frames(skewed).collect()}
    assert sizes["hot", "valid"] == 360 and sizes["hot", "train"] == 540
    assert len(sizes) == 2 * folds.folds(skewed).count()


@pytest.mark.parametrize("n", [1, 2, 3, 57, 400])
def test_pairs_are_a_permutation(spark, n):
    rows = [(f"s{i}", float(i % 5), float(-i)) for i in range(n)]
    df = spark.createDataFrame(rows, "student_id string, content double, wording double")
    paired = pairs.pair_rows(df).collect()
    ids = {r[0] for r in rows}
    assert {r.first_student_id for r in paired} == ids
    assert {r.second_student_id for r in paired} == ids
    assert len(paired) == n
    if n > 1:
        assert all(r.first_student_id != r.second_student_id for r in paired)
    for r in paired:
        gap = r.first_content - r.second_content
        assert r.label_content == (gap > 0) - (gap < 0)


def test_pairs_leave_out_missing_targets_and_depend_on_the_seed(spark):
    rows = [(f"s{i}", float("nan") if i == 3 else None if i == 4 else 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "student_id string, content double")
    first = {r[0]: r.second_student_id for r in pairs.pair_rows(df, targets=["content"], seed=1).collect()}
    other = {r[0]: r.second_student_id for r in pairs.pair_rows(df, targets=["content"], seed=2).collect()}
    assert len(first) == 38 and not {"s3", "s4"} & set(first)
    assert first != other


def test_attach_sides(skewed):
    paired = pairs.attach_sides(pairs.pair_rows(skewed), skewed, ["features"])
    assert paired.count() == 900
    row = paired.first()
    look = {r.student_id: r.features for r in skewed.collect()}
    assert row.first_features == look[row.first_student_id]
    assert row.second_features == look[row.second_student_id]


def test_results_do_not_depend_on_the_layout(spark, skewed):
    def results():
        one = sorted(map(tuple, pairs.pair_rows(skewed.drop("features")).collect()))
        two = sorted(map(tuple, batches.assign_batches(skewed.select("student_id"), 7, seed=3).collect()))
        return one, two

    wide = results()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert results() == wide
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_batches_are_full_but_for_the_last(skewed):
    sizes = (
        batches.assign_batches(skewed, 32, seed=1, epoch=2).groupBy("batch_id").count().collect()
    )
    by_id = {r.batch_id: r["count"] for r in sizes}
    assert sorted(by_id) == list(range(29))
    assert all(by_id[i] == 32 for i in range(28)) and by_id[28] == 900 - 28 * 32


def test_epochs_shuffle_differently(skewed):
    def order(**options):
        rows = batches.assign_batches(skewed.select("student_id"), 10, **options).collect()
        return [r.student_id for r in sorted(rows, key=lambda r: r.position)]

    assert order(seed=1, epoch=1) != order(seed=1, epoch=2)
    assert order() == order(epoch=5)


def test_sample(skewed):
    one = {r.student_id for r in ordering.sample_n(skewed, "student_id", 10, 1).collect()}
    again = {
        r.student_id
        for r in ordering.sample_n(skewed.repartition(3), "student_id", 10, 1).collect()
    }
    assert len(one) == 10 and one == again


def test_union_matches_by_name(responses):
    shuffled = responses.select(*reversed(responses.columns))
    assert folds.union_folds([responses, shuffled]).distinct().count() == 3
