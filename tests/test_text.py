from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import batches, spelling, summarise, vocab
from gradeflow.plans import load
from gradeflow.session import checkpointed


def texts(spark, *values):
    return spark.createDataFrame(
        [(f"s{i}", v) for i, v in enumerate(values)], "student_id string, text string"
    )


def tokens(spark, *values):
    return vocab.tokenise(texts(spark, *values), "text")


def test_tags_stay_whole(spark):
    row = tokens(spark, "<summary> It's 2 RÉSUMÉS <reference> a<b>c <other>").first()
    assert row.tokens == [
        "<summary>", "it", "s", "2", "résumés", "<reference>", "a", "b", "c", "other",
    ]


def test_vocabulary_order_and_reserved_ids(spark):
    words = vocab.build_vocab(tokens(spark, "b a c a <title> b", "c d <title>"), 3)
    assert [tuple(r) for r in words.orderBy("id").collect()] == [("a", 9, 2), ("b", 10, 2), ("c", 11, 2)]


@pytest.mark.parametrize("how", ["table", "join"])
def test_encode(spark, how):
    data = tokens(spark, "<summary> b zzz a a", "", "a b a b a b a b", None)
    words = vocab.build_vocab(tokens(spark, "a a b"), 10)
    rows = {r.student_id: r for r in vocab.encode(data, words, 6, how, carry=["text"]).collect()}
    assert rows["s0"].input_ids == [2, 7, 10, 1, 9, 3]
    assert rows["s0"].attention_mask == [1] * 6
    assert rows["s1"].input_ids == [2, 3] and rows["s1"].text == ""
    assert rows["s2"].input_ids == [2, 9, 10, 9, 10, 3]
    assert rows["s3"].input_ids == [2, 3]
    assert len(rows) == 4
    for wrong in ({"max_length": 1}, {"max_length": 6, "how": "guess"}):
        with pytest.raises(ValueError):
            vocab.encode(data, words, **wrong)


def test_encoding_keeps_rows_with_repeated_and_null_keys(spark):
    data = tokens(spark, "a b", "b", "a a", "").withColumn(
        "student_id", F.when(F.col("student_id").isin("s0", "s1"), "same")
    )
    words = vocab.build_vocab(tokens(spark, "a a b"), 10)
    found = [sorted(map(repr, vocab.encode(data, words, 6, how).collect())) for how in vocab.HOW]
    assert found[0] == found[1] and len(found[0]) == 4


def test_too_many_words_for_the_table_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(vocab, "TABLE_WORDS", 1)
    data = tokens(spark, "a b c d e f g h")
    with pytest.raises(Exception, match="how='join'"):
        vocab.encode(data, vocab.build_vocab(data, 8), 6).collect()
    assert vocab.encode(data, vocab.build_vocab(data, 8), 6, "join").count() == 1


def test_spelling_survives_a_very_long_word(spark):
    junk = "x" * 100_000
    data = spark.createDataFrame([("1", f"house {junk} " + "house " * 6), ("2", "hause")], "student_id string, text string")
    counts = spelling.word_counts(data)
    fixes = spelling.spell_candidates(counts, 5)
    assert [(r.word, r.fix) for r in fixes.collect()] == [("hause", "house")]
    fixed = {r.student_id: r.text for r in spelling.correct_spelling(data, fixes).collect()}
    assert fixed["2"] == "house" and junk in fixed["1"]


@pytest.mark.parametrize("limit", [0, 3, 1_000_000])
def test_frequent_words_stay_where_they_are(spark, monkeypatch, limit):
    monkeypatch.setattr(spelling, "FREQUENT_WORDS", limit)
    rows = [("1", "Hause, house " + "house " * 6 + "garden " * 3), ("2", "hause-garden garden"), ("2", "a hause"), ("2", "a hause"), (None, "hause")]
    data = spark.createDataFrame(rows, "student_id string, text string")
    counts = spelling.word_counts(data)
    fixes = spark.createDataFrame([("hause", "house")], "word string, fix string")
    found = spelling.correct_spelling(data, fixes, counts=counts)
    assert sorted((r.student_id or "", r.text) for r in found.collect()) == [
        ("", "hause"), ("1", rows[0][1].replace("Hause", "House")), ("2", "a house"), ("2", "a house"), ("2", "house-garden garden"),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("Join LeftAnti" in plan) == (limit > 0)
    assert plan.count("Generate posexplode") == 1 and "LeftSemi" not in plan  # words leave their texts once


def test_encoding_with_a_small_vocabulary_moves_no_rows(spark):
    data = tokens(spark, "a b", "c")
    words = checkpointed(spark, vocab.build_vocab(data, 3), "vocabulary")
    plan = vocab.encode(data, words, 6)._jdf.queryExecution().executedPlan().toString()
    # the lookup table is a subquery; outside it the plan is a plain projection
    main = [line for line in plan.splitlines() if not line.lstrip().startswith((":", "+- Subquery"))]
    assert not [line for line in main if "Exchange" in line or "Generate" in line]


def test_padding(spark):
    rows = [(f"s{i}", i // 2, list(range(1, i + 2)), [1] * (i + 1)) for i in range(5)]
    df = spark.createDataFrame(
        rows, "student_id string, batch_id int, input_ids array<int>, attention_mask array<int>"
    )
    for row in batches.pad_static(df, 7).collect():
        real = int(row.student_id[1:]) + 1
        assert row.input_ids == list(range(1, real + 1)) + [0] * (7 - real)
        assert sum(row.attention_mask) == real and len(row.attention_mask) == 7
    lengths = {r.student_id: len(r.input_ids) for r in batches.pad_dynamic(df).collect()}
    assert lengths == {"s0": 2, "s1": 2, "s2": 4, "s3": 4, "s4": 5}


def test_vocab_features(spark):
    data = tokens(spark, "a b a", "zzz", "b")
    words = vocab.build_vocab(tokens(spark, "a a b"), 2)
    bags = vocab.vocab_features(data, words)
    assert sorted(map(tuple, bags.collect())) == [("s0", 9, 2), ("s0", 10, 1), ("s2", 10, 1)]
    dense = {r.student_id: r.features for r in vocab.dense_features(bags, 2).collect()}
    assert dense == {"s0": [2.0, 1.0], "s2": [0.0, 1.0]}


# --- spelling ---------------------------------------------------------------


def one_edit(a: str, b: str) -> bool:
    """Brute force: insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return False
    if len(a) == len(b):
        gaps = [i for i in range(len(a)) if a[i] != b[i]]
        if len(gaps) == 1:
            return True
        return len(gaps) == 2 and gaps[1] == gaps[0] + 1 and (
            a[gaps[0]] == b[gaps[1]] and a[gaps[1]] == b[gaps[0]]
        )
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(
        long[:i] + long[i + 1 :] == short for i in range(len(long))
    )


def brute_force(counts: dict[str, int], k: int) -> dict[str, str]:
    known = [w for w, n in counts.items() if n >= k]
    best = {}
    for word, n in counts.items():
        near = [w for w in known if one_edit(word, w)]
        if n < k and near:
            best[word] = min(near, key=lambda w: (-counts[w], w))
    return best


def test_candidates_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    counts = {
        "".join(rng.choice("abé") for _ in range(rng.randint(1, 6))): rng.randint(1, 9)
        for _ in range(400)
    }
    counts["x" * 300] = 1
    counts["x" * 299] = 7
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    found = {r.word: (r.fix, r.fix_n) for r in spelling.spell_candidates(df, 5).collect()}
    expected = brute_force(counts, 5)
    assert len(expected) > 50
    assert found == {w: (f, counts[f]) for w, f in expected.items()}


def test_swaps_can_be_left_out(spark):
    df = spark.createDataFrame([("form", 9), ("from", 1)], "word string, n bigint")
    assert spelling.spell_candidates(df, 5).first().fix == "form"
    assert spelling.spell_candidates(df, 5, transpositions=False).count() == 0


def test_dictionary(spark):
    data = texts(spark, "The cat, the CAT", "the dog")
    assert {r.word: r.n for r in spelling.spell_dictionary(data, 2).collect()} == {"the": 3, "cat": 2}


def test_correction_keeps_everything_between_words(spark):
    fixes = spark.createDataFrame([("teh", "the"), ("éa", "à"), ("cta", "cat")], "word string, fix string")
    data = texts(spark, "Teh  cta\n(teh-cta) 3teh!", "nothing wrong", None, "", "Éa teh", "teh")
    rows = {r.student_id: r.text for r in spelling.correct_spelling(data, fixes).collect()}
    assert rows == {
        "s0": "The  cat\n(the-cat) 3the!",
        "s1": "nothing wrong",
        "s2": None,
        "s3": "",
        "s4": "À the",
        "s5": "the",
    }


def test_corpus_corrects_itself(spark):
    data = texts(spark, *["the answer is here"] * 6, "teh answr is hre")
    rows = {r.student_id: r.text for r in load.corrected(data, 5).collect()}
    assert rows["s6"] == "the answer is here" and rows["s0"] == "the answer is here"


# --- summaries --------------------------------------------------------------


def summary_by_hand(text: str, low: int, high: int) -> str:
    found = re.findall(r"[^\W_]+", text)
    if len(found) < high:
        return text
    frequency = Counter(w.lower() for w in found)
    ranked = []
    for pos, sentence in enumerate(re.findall(r"[^.!?\n]+[.!?]*", text)):
        ws = [w.lower() for w in re.findall(r"[^\W_]+", sentence)]
        if ws:
            ranked.append((-sum(frequency[w] for w in ws) / len(ws), pos, sentence, len(ws)))
    chosen, total = [], 0
    for _, pos, sentence, n in sorted(ranked):
        if total + n <= high or total < low:
            chosen.append((pos, sentence, n))
        else:
            break
        total += n
    shown, left = [], high
    for _, sentence, n in sorted(chosen):
        if left <= 0:
            break
        if n > left:
            sentence = "".join(re.findall(r"(?:[\W_])*[^\W_]+", sentence)[:left])
        shown.append(sentence.strip(" "))
        left -= n
    return " ".join(shown)


def test_summaries(spark):
    import random

    rng = random.Random(5)
    values = []
    for _ in range(60):
        parts = [
            " ".join(rng.choice(["a", "b", "cc", "dd", "eee", "f"]) for _ in range(rng.randint(1, 9)))
            for _ in range(rng.randint(1, 12))
        ]
        values.append("".join(p + rng.choice([". ", "!\n", "?? ", "\n"]) for p in parts))
    values += ["one two three", "... !!", "a b c d e f g h i j k l m n o p q r s t u v w x y z."]
    data = texts(spark, *values)
    found = summarise.reference_summary(data, 6, 20, "student_id", "text", "summary")
    rows = {r.student_id: r.summary for r in found.collect()}
    assert len(rows) == len(values)
    for i, value in enumerate(values):
        assert rows[f"s{i}"] == summary_by_hand(value, 6, 20), value
        if len(re.findall(r"[^\W_]+", value)) >= 20:
            assert len(re.findall(r"[^\W_]+", rows[f"s{i}"])) <= 20


def test_summaries_hold_no_more_than_a_row(spark):
    data = texts(spark, *["a b c. d e a! " * 20 for _ in range(50)])
    plan = summarise.reference_summary(data, 6, 20, "student_id", "text", "summary")._jdf.queryExecution().executedPlan().toString()
    # words are counted within the row: nothing is exploded to words, sorted or hashed by them
    assert "Window" not in plan and "Join" not in plan and "token#" not in plan
    assert plan.count("Exchange") == 1


def test_summaries_of_repeated_and_missing_keys(spark):
    rows = [("a", "x y z. u v w. " * 4), ("a", "x y z. u v w. " * 4), (None, "p q. " * 20), (None, "short")]
    data = spark.createDataFrame(rows, "student_id string, text string")
    found = summarise.reference_summary(data, 6, 20, "student_id", "text", "summary").collect()
    assert sorted((r.student_id or "", len(r.summary.split())) for r in found) == [("", 1), ("a", 9), ("a", 9)]


def test_length_gate(spark):
    data = texts(spark, "a b c", "a b")
    rows = {r.student_id: r for r in summarise.length_gate(data, 3, "student_id", "text").collect()}
    assert not rows["s0"].keep_full and rows["s1"].keep_full


def test_null_prompt_text_stays_null(spark):
    data = texts(spark, None, "short")
    found = summarise.reference_summary(data, 6, 20, "student_id", "text", "summary")
    assert {r.student_id: r.summary for r in found.collect()} == {"s0": None, "s1": "short"}


def test_tokens_are_counted_per_row(spark):
    row = tokens(spark, "a a b").select(F.size("tokens").alias("n")).first()
    assert row.n == 3
