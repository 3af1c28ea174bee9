"""Sparse ridge, all-pairs ranking, ensembles as matrices, and ranks without a single task."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeflow.operators import fit, ordering, score, sparse, vocab
from gradeflow.operators.folds import ALL
from gradeflow.plans import workflows
from gradeflow.schemas import TAGS, TARGET_COLUMNS

BAGS = "student_id string, prompt_id string, content double, wording double, ids array<int>, counts array<double>"


def bag_table(n: int = 160, size: int = 30, seed: int = 2):
    """Rows of which a third lie in one fold, some without words, a fold, or a target."""
    rng = np.random.default_rng(seed)
    truth = rng.normal(size=size)
    rows = []
    for i in range(n):
        fold = None if i % 50 == 7 else "hot" if i % 3 == 0 else f"p{i % 7}"
        ids = sorted(rng.choice(size, size=0 if i % 40 == 1 else int(rng.integers(1, 20)), replace=False).tolist())
        counts = rng.integers(1, 5, size=len(ids)).astype(float).tolist()
        y = float(truth[ids] @ np.array(counts)) if ids else 0.0
        content = None if i % 60 == 9 else float("nan") if i % 60 == 19 else y + float(rng.normal())
        rows.append((f"s{i}", fold, content, 3.0 - y, ids, counts))
    return rows, size


def dense_models(rows, size, lam, fold):
    usable = [r for r in rows if r[2] is not None and r[2] == r[2] and (r[1] != fold or fold is None)]
    x = np.zeros((len(usable), size))
    for line, row in zip(x, usable, strict=True):
        line[row[4]] = row[5]
    y = np.array([[r[2], r[3]] for r in usable])
    centre = x.mean(axis=0)
    lam = 0.5 * len(usable) if lam is None else lam
    w = np.linalg.solve((x - centre).T @ (x - centre) + lam * np.eye(size), (x - centre).T @ (y - y.mean(axis=0)))
    return len(usable), y.mean(axis=0) - centre @ w, w


@pytest.mark.parametrize("state", [sparse.STATE_BYTES, 3 * 8 * 30 * 6])
def test_sparse_ridge_equals_dense_solution(spark, monkeypatch, state):
    monkeypatch.setattr(sparse, "STATE_BYTES", state)  # the small one cuts the folds into blocks
    monkeypatch.setattr(sparse, "BLOCK_CELLS", 2000)
    rows, size = bag_table()
    df = spark.createDataFrame(rows, BAGS).repartition(5)
    models = sparse.fit_logo_sparse(df, size, lam=20.0, include_all=True, tolerance=1e-10)
    found = {(r.fold, r.target): r for r in models.collect()}
    folds = {r[1] for r in rows if r[1]}
    assert set(found) == {(f, t) for f in [*folds, ALL] for t in TARGET_COLUMNS}
    for fold in [*folds, ALL]:
        n, intercept, w = dense_models(rows, size, 20.0, None if fold == ALL else fold)
        for j, t in enumerate(TARGET_COLUMNS):
            model = found[fold, t]
            assert model.n == n
            assert model.intercept == pytest.approx(intercept[j], abs=1e-7)
            assert np.abs(np.array(model.weights) - w[:, j]).max() < 1e-7
    scored = {r.student_id: r for r in sparse.oof_predict_sparse(df, models).collect()}
    assert set(scored) == {r[0] for r in rows if r[1]}
    for student, fold, _, _, ids, counts in rows[:40]:
        if fold:
            _, intercept, w = dense_models(rows, size, 20.0, fold)
            assert scored[student].predicted_wording == pytest.approx(intercept[1] + w[ids, 1] @ counts, abs=1e-6)


def test_sparse_ridge_equals_the_dense_fit(spark, skewed):
    features = skewed.select("*", F.array(*[F.lit(i) for i in range(3)]).alias("ids"), F.col("features").alias("counts"))
    dense = {(r.fold, r.target): r for r in fit.fit_logo(skewed, lam=1.0).collect()}
    for r in sparse.fit_logo_sparse(features, 3, lam=1.0).collect():
        other = dense[r.fold, r.target]
        assert r.n == other.n and r.weights == pytest.approx(other.weights, abs=1e-7)
        assert r.intercept == pytest.approx(other.intercept, abs=1e-7)


def test_shrinkage_by_row_and_words_given_twice(spark):
    rows, size = bag_table()
    df = spark.createDataFrame(rows, BAGS)
    twice = df.withColumns({"ids": F.concat("ids", "ids"), "counts": F.transform(F.concat("counts", "counts"), lambda n: n / 2)})
    n, intercept, w = dense_models(rows, size, None, "hot")
    for table in (df, twice):
        models = sparse.fit_logo_sparse(table, size, lam=0.5, per_row=True).filter("fold = 'hot'").collect()
        for model in models:
            j = TARGET_COLUMNS.index(model.target)
            assert model.intercept == pytest.approx(intercept[j], abs=1e-6)
            assert np.abs(np.array(model.weights) - w[:, j]).max() < 1e-6


def test_sparse_ridge_without_rows_or_other_folds(spark):
    none = spark.createDataFrame([], BAGS)
    assert sparse.fit_logo_sparse(none, 10).count() == 0
    lone = spark.createDataFrame([("a", "p", 1.0, 2.0, [1], [1.0]), ("b", "p", 0.0, 2.0, [2], [1.0])], BAGS)
    assert sparse.fit_logo_sparse(lone, 10).count() == 0
    assert {r.fold for r in sparse.fit_logo_sparse(lone, 10, include_all=True).collect()} == {ALL}
    with pytest.raises(ValueError, match="positive"):
        sparse.fit_logo_sparse(lone, 10, lam=0.0)
    with pytest.raises(ValueError, match="exceed"):
        sparse.fit_logo_sparse(lone, sparse.STATE_BYTES)
    with pytest.raises(RuntimeError, match="no convergence"):
        sparse.fit_logo_sparse(spark.createDataFrame(bag_table()[0], BAGS), 30, max_steps=1)


def test_bags_of_rows(spark):
    df = spark.createDataFrame([("a", "p"), ("b", "p")], "student_id string, prompt_id string")
    bags = spark.createDataFrame([("a", 11, 3), ("a", 9, 1)], "student_id string, id int, n long")
    rows = {r.student_id: (r.ids, r.counts) for r in sparse.bag_rows(df, bags).collect()}
    assert rows == {"a": ([0, 2], [1.0, 3.0]), "b": ([], [])}
    logs = {r.student_id: r.counts for r in sparse.bag_rows(df, bags, value=F.log1p("n")).collect()}
    assert logs["a"] == pytest.approx([np.log(2), np.log(4)])


# Ranking from all pairs.


def all_pairs(rows, leave_out=None):
    xs, ys = [], []
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a["prompt_id"] is not None and a["prompt_id"] == b["prompt_id"] != leave_out:
                xs.append(np.subtract(a["features"], b["features"]))
                ys.append([a["content"] - b["content"], a["wording"] - b["wording"]])
    return np.array(xs), np.array(ys)


def test_ranking_from_sums_equals_all_pairs(spark, skewed):
    # targets far from 0 and features far from 0 change no difference
    shifted = skewed.limit(300).withColumns(
        {
            "content": F.col("content") + 1e6,
            "features": F.transform("features", lambda x: x + 1e4),
            "prompt_id": F.when(F.col("student_id") != "s5", F.col("prompt_id")),
        }
    )
    rows = [r.asDict() for r in shifted.collect()]
    models = fit.fit_rank_pairs(spark.createDataFrame(rows, skewed.schema), lam=3.0).collect()
    found = {(r.fold, r.target): r for r in models}
    assert len(found) == 2 * (len({r["prompt_id"] for r in rows} - {None}) + 1)
    for fold in ("hot", "p3", ALL):
        x, y = all_pairs(rows, fold)
        w = np.linalg.solve(x.T @ x + 3.0 * np.eye(3), x.T @ y)
        for j, t in enumerate(TARGET_COLUMNS):
            assert found[fold, t].n == len(x) and found[fold, t].intercept == 0.0
            assert found[fold, t].weights == pytest.approx(w[:, j].tolist(), abs=1e-6)


def test_ranking_leaves_out_incomplete_rows(spark, skewed):
    few = skewed.limit(40)
    spoilt = few.unionByName(few.limit(5).withColumn("content", F.lit(float("nan")))).unionByName(
        few.limit(5).withColumn("features", F.lit(None).cast("array<double>"))
    )
    a, b = (sorted(map(repr, fit.fit_rank_pairs(df).select("fold", "target", "n").collect())) for df in (few, spoilt))
    assert a == b
    assert fit.fit_rank_pairs(few.limit(0)).count() == 0
    single = few.dropDuplicates(["prompt_id"])
    assert fit.fit_rank_pairs(single).count() == 0  # no pair at all


def test_training_a_fold_by_all_pairs(spark, skewed):
    models, metrics = workflows.train_fold(skewed, "hot", loss="ranking_squares")
    expected = {r.target: r.weights for r in fit.fit_rank_pairs(skewed).filter("fold = 'hot'").collect()}
    assert {r.target: r.weights for r in models.collect()} == {t: pytest.approx(w, abs=1e-9) for t, w in expected.items()}
    assert metrics is not None and {r.fold for r in models.collect()} == {"hot"}


# Ensembles.

MODELS = "fold string, target string, n long, intercept double, weights array<double>"


def many_models(n: int, d: int, seed: int = 1):
    rng = np.random.default_rng(seed)
    return [
        (f"m{i}", t, 1, float(rng.normal()), rng.normal(size=d).tolist())
        for i in range(n)
        for t in TARGET_COLUMNS
        if t == "content" or i % 3
    ]


def test_a_thousand_models_are_one_matrix(spark):
    models, d = many_models(1000, 20), 20
    table = spark.createDataFrame(models, MODELS)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, d)) * 100
    df = spark.createDataFrame([(f"s{i}", row.tolist()) for i, row in enumerate(x)], "student_id string, features array<double>")
    scored = score.predict_models(df, table, spread=True)
    assert "Generate" not in scored._jdf.queryExecution().executedPlan().toString()
    assert scored.columns == ["student_id", "features", "content", "content_spread", "wording", "wording_spread"]
    for r in scored.collect():
        for t in TARGET_COLUMNS:
            each = [b + np.dot(w, r.features) for _, target, _, b, w in models if target == t]
            assert r[t] == pytest.approx(np.mean(each), abs=1e-8)
            assert r[f"{t}_spread"] == pytest.approx(np.std(each), rel=1e-9)


def test_matrix_ensembles_equal_the_other_ways(spark, skewed):
    models = fit.fit_logo(skewed)
    a = {r.student_id: r for r in score.predict_models(skewed.drop(*TARGET_COLUMNS), models).collect()}
    b = {r.student_id: r for r in score.predict_ensemble(skewed.drop(*TARGET_COLUMNS), models).collect()}
    each = score.predict_each(skewed, models).groupBy("student_id").agg(F.avg("content").alias("content")).collect()
    for r in each:
        assert a[r.student_id].content == pytest.approx(r.content) == pytest.approx(b[r.student_id].content)


def test_matrix_ensembles_of_odd_rows_and_models(spark):
    rows = [("a", [1.0, 2.0]), ("b", None), ("c", [1.0]), ("d", [float("nan"), 1.0]), ("a", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "student_id string, features array<double>")
    table = spark.createDataFrame([("x", "content", 1, 0.5, [1.0, 1.0]), ("y", "content", 1, 1.5, [0.0, 1.0])], MODELS)
    with pytest.raises(ValueError, match="no model predicts"):
        score.predict_models(df, table)
    found = score.predict_models(df, table, allow_missing=True).collect()
    assert [r.wording for r in found] == [None] * 5
    values = [r.content for r in found]
    assert values[0] == values[4] == 3.5 and values[1] is None and values[2] is None and values[3] != values[3]
    assert score.predict_models(df.limit(0), table, allow_missing=True).count() == 0
    with pytest.raises(ValueError, match="unequal"):
        score.predict_models(df, table.unionByName(spark.createDataFrame([("z", "content", 1, 0.0, [1.0])], MODELS)), allow_missing=True)


def test_matrices_are_measured_first(spark, monkeypatch):
    monkeypatch.setattr(score, "MATRIX_BYTES", 100)
    table = spark.createDataFrame(many_models(10, 20), MODELS)
    with pytest.raises(ValueError, match="exceed"):
        score.predict_models(spark.createDataFrame([("a", [0.0])], "student_id string, features array<double>"), table)


# Ranks and vocabularies.


def test_ranks_are_exact_and_no_task_sees_all_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, 50]), f"t{i:05d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "n long, token string").repartition(7)
    ranked = ordering.with_rank(df, F.desc("n"), F.col("token"))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # of a row per range
    expected = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [(r.n, r.token) for r in sorted(ranked.collect(), key=lambda r: r["rank"])] == expected
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 3001))
    assert ordering.with_rank(df.limit(0), F.desc("n")).count() == 0


def token_rows(n: int = 400):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(n):
        texts.append([words[min(int(rng.paretovariate(0.9)), 2999)] for _ in range(rng.randrange(0, 120))])
    return [*texts, None, [], list(TAGS.values()), [None, "w1"]]


@pytest.mark.parametrize("size", [10, 100_000])
def test_all_ways_to_a_vocabulary_agree(spark, size):
    texts = token_rows()
    df = spark.createDataFrame([(t,) for t in texts], "tokens array<string>").repartition(6)
    counts = Counter(t for text in texts for t in text or [] if t is not None and t not in TAGS.values())
    best = sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:size]
    expected = [(word, vocab.FIRST_WORD_ID + i, n) for i, (word, n) in enumerate(best)]
    for options in ({}, {"how": "ranked"}, {"how": "ranked", "counters": 200}, {"counters": 3}):
        found = sorted(map(tuple, vocab.build_vocab(df, size, **options).collect()), key=lambda r: r[1])
        assert found == expected, options


def test_heavy_hitters_bound_every_count(spark):
    texts = token_rows()
    df = spark.createDataFrame([(t,) for t in texts], "tokens array<string>").repartition(6)
    counts = Counter(t for text in texts for t in text or [] if t is not None)
    listed, error = vocab.heavy_hitters(df, 50)
    low = {r.token: r.low for r in listed.collect()}
    assert 0 < error <= sum(counts.values()) / 50 and len(low) <= 6 * 100
    for token, n in counts.items():
        assert low.get(token, 0) <= n <= low.get(token, 0) + error
    assert vocab._possible(df, 5, 50, "tokens").count() < len(counts)
    assert vocab._possible(df, 2000, 50, "tokens") is None
