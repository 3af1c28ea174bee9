"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words and word beginnings is trained in numpy from confirmed toxic texts
and unlabelled ones.  With class prior p, positives P and unlabelled U (drawn from all texts), the
risk

    p * E_P[l(f, 1)] + max(0, E_U[l(f, 0)] - p * E_P[l(f, 0)])

estimates the risk on fully labelled data without bias while its second part is not negative.  On a
batch where that part falls below zero, the step goes the other way (the non-negative estimator),
which keeps the model from fitting the unlabelled positives away.  l is the logistic loss.  A
feature's step is scaled by how far its share among confirmed texts stands out, in standard
deviations, so that a few dozen of them are enough to find their words.  ``PARTS`` further models, each
trained without a part of the sample, give that part values; the slope and shift of the logistic curve
that turns values into scores are those of least risk, as above, on all of them.

Features: each distinct word of a text, in lower case, and its beginnings of four to six letters.
A word's weight is the sum over its features; a text's value is the sum over its distinct words
divided by the square root of their number, plus a bias.

The model is fitted on a bounded sample of rows that may be learned from: at most ``POSITIVES``
confirmed ones and ``UNLABELLED`` of any kind, chosen by hash.  The sample is drawn first; then whole
texts, repeated rows once, are reduced in the tasks to counts of buckets, as many as there are buckets
at most.  Scoring reads all words of all rows.

Nulls and empties: a null or wordless text has the score of the bias alone.  A null label is
unlabelled, of several labels of one id the largest counts, and null ids are never confirmed.
Without positives every score is 0.  Repeated rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import fsum

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BUCKETS = 1 << 18
BEGINNINGS = (4, 5, 6)
POSITIVES, UNLABELLED = 3000, 9000
#: Passes over the unlabelled sample, more if they are fewer steps; step size, shrinkage and batches.
EPOCHS, STEPS, RATE, DECAY, BATCH, POSITIVE_BATCH = 12, 300, 1.0, 1e-4, 128, 32
#: Standard deviations from which a feature's steps are whole, and the least scale of a step.
STANDS_OUT, LEAST_STEP = 6.0, 0.01
PARTS = 5
WORDS = re.compile(r"[^\W\d_]+")
CACHED_WORDS = 400_000


#: (buckets, how often a distinct word's features fall into each, distinct words) of texts that have words.
Sample = list[tuple[np.ndarray, np.ndarray, int]]


@dataclass
class ToxicityModel:
    weights: np.ndarray  # float32, by bucket
    bias: float


def word_features(word: str) -> list[int]:
    from zlib import crc32

    names = [f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n)]
    return [crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS for name in names]


def distinct_words(text: str | None) -> set[str]:
    return set(WORDS.findall(text.lower())) if text else set()


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of all features of a text in order, their counts, and the number of distinct words."""
    words = distinct_words(text)
    ids = np.array([i for word in words for i in word_features(word)], np.int64)
    return *np.unique(ids, return_counts=True), len(words)


def values(sample: Sample, model: ToxicityModel) -> np.ndarray:
    return np.array(
        [(model.weights[ids] * counts).sum(dtype=np.float64) / words**0.5 + model.bias for ids, counts, words in sample]
    )


def calibrated(model: ToxicityModel, fp: np.ndarray, fu: np.ndarray, prior: float) -> ToxicityModel:
    """The model with slope and shift of least non-negative risk on values of rows it was not trained on."""
    best = (np.inf, 1.0, 0.0)
    for slope in np.geomspace(0.25, 8, 21):
        for shift in np.linspace(-6, 6, 97):
            p, u = slope * fp + shift, slope * fu + shift
            second = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
            risk = prior * np.logaddexp(0, -p).mean() + max(0.0, second) + 1e-4 * slope**2
            best = min(best, (risk, slope, shift))
    return ToxicityModel((best[1] * model.weights).astype(np.float32), float(best[1] * model.bias + best[2]))


def train(positives: Sample, unlabelled: Sample, prior: float) -> ToxicityModel | None:
    """The calibrated model of both samples."""
    if not positives:
        return None
    unlabelled = unlabelled or positives

    def name(row) -> bytes:
        return row[0].tobytes() + row[1].tobytes()

    held_p, held_u = [], []
    for part in range(PARTS):
        apart = {name(p) for p in positives[part::PARTS]}
        rest_p = [p for p in positives if name(p) not in apart]
        rest_u = [u for i, u in enumerate(unlabelled) if i % PARTS != part and name(u) not in apart]
        if rest_p and rest_u and apart:
            model = _trained(rest_p, rest_u, prior)
            held_p.append(values(positives[part::PARTS], model))
            held_u.append(values(unlabelled[part::PARTS], model))
    model = _trained(positives, unlabelled, prior)
    if not held_p:  # a single confirmed text: nothing to hold apart
        return model
    return calibrated(model, np.concatenate(held_p), np.concatenate(held_u), prior)


def _step_scales(positives: Sample, unlabelled: Sample) -> np.ndarray:
    """Per bucket, how far its share among confirmed texts stands out."""
    in_p, in_u = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for ids, _, _ in positives:
        in_p[ids] += 1
    for ids, _, _ in unlabelled:
        in_u[ids] += 1
    expected = (in_p + in_u) * len(positives) / (len(positives) + len(unlabelled))
    return np.clip((in_p - expected) / np.sqrt(expected + 0.3) / STANDS_OUT, LEAST_STEP, 1.0)


def _trained(positives: Sample, unlabelled: Sample, prior: float) -> ToxicityModel:
    rng = np.random.default_rng(11)
    scales = _step_scales(positives, unlabelled)
    weights, squares, bias = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2), float(np.log(prior / (1 - prior)))
    mean_weights, mean_bias, averaged = np.zeros(BUCKETS), 0.0, 0
    epochs = max(EPOCHS, -(-STEPS // -(-len(unlabelled) // BATCH)))
    for epoch in range(epochs):
        order = rng.permutation(len(unlabelled))
        for at in range(0, len(order), BATCH):
            u = [unlabelled[i] for i in order[at : at + BATCH]]
            batch = u + [positives[i] for i in rng.integers(0, len(positives), POSITIVE_BATCH)]
            lengths = np.array([len(ids) for ids, _, _ in batch])
            scale = 1 / np.sqrt([words for _, _, words in batch])
            ids = np.concatenate([ids for ids, _, _ in batch])
            counts = np.concatenate([counts for _, counts, _ in batch])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            value = np.add.reduceat(weights[ids] * counts, starts) * scale + bias
            fu, fp = value[: len(u)], value[len(u) :]
            second = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            slope_u, slope_p = _logistic(fu) / len(fu), -prior * _logistic(fp) / len(fp)
            if second >= 0:
                slope_p = slope_p - prior * _logistic(-fp) / len(fp)
            else:
                slope_u, slope_p = -slope_u, -slope_p
            slope = np.concatenate([slope_u, slope_p])
            touched, place = np.unique(ids, return_inverse=True)
            gradient = np.bincount(place, np.repeat(slope * scale, lengths) * counts) + DECAY * weights[touched]
            squares[touched] += gradient**2
            weights[touched] -= RATE * scales[touched] * gradient / np.sqrt(squares[touched])
            bias -= 0.1 * slope.sum()
        if epoch >= epochs // 2:
            averaged += 1
            mean_weights += (weights - mean_weights) / averaged
            mean_bias += (bias - mean_bias) / averaged
    return ToxicityModel(mean_weights.astype(np.float32), mean_bias)


def _features_udf():
    @F.pandas_udf("ids binary, counts binary, words int")
    def features(texts: pd.Series) -> pd.DataFrame:
        bags = [bag(text) for text in texts]
        rows = [(ids.astype("<i4").tobytes(), counts.astype("<i4").tobytes(), words) for ids, counts, words in bags]
        return pd.DataFrame(rows, columns=["ids", "counts", "words"])

    return features


def _collected(rows: DataFrame, order: Column, limit: int, text: str) -> Sample:
    """Bags of the rows of smallest ``order``, at most ``limit`` different ones; wordless ones are dropped.

    The last number to be taken is found from the numbers alone, so only chosen texts are reduced.
    """
    named = rows.select(order.alias("order"), F.col(text).cast("string").alias("text"))
    last = named.select("order").distinct().orderBy("order").limit(limit).agg(F.max("order").alias("last")).first()["last"]
    if last is None:
        return []
    chosen = named.filter(F.col("order") <= last).groupBy("order").agg(F.first("text").alias("text"))
    found = chosen.select("order", _features_udf()("text").alias("f")).select("order", "f.*").collect()
    return [
        (np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["counts"], "<i4"), r["words"])
        for r in sorted(found, key=lambda r: r["order"])
        if r["words"]
    ]


def fit(
    documents: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> ToxicityModel | None:
    """The model learned from the rows of both tables where ``learn``, a condition on the id, holds.

    The class prior is the share of confirmed ids among labelled ones.
    """
    spark = documents.sparkSession
    learn = F.lit(True) if learn is None else learn
    judged = (
        labels.filter(learn & F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("id"))
        .agg(F.max(F.col(label).cast("int")).alias("toxic"))
    )
    share = judged.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not share["toxic"]:
        return None
    prior = min(0.9, max(0.01, share["toxic"] / share["n"]))
    # A bounded table of ids, broadcast; the texts stay where they are.
    chosen = judged.filter("toxic = 1").orderBy(F.xxhash64("id"), "id").limit(POSITIVES).select("id")
    rows = documents.filter(learn)
    draw = F.xxhash64(F.col(doc_id), F.col(text))
    confirmed = rows.join(F.broadcast(chosen), rows[doc_id] == chosen["id"], "left_semi")
    million = 1_000_000
    part = min(million, 2 * million * UNLABELLED // max(1, rows.count()) + 1)
    some = rows.filter(F.pmod(F.xxhash64(draw), F.lit(million)) < part)
    return train(_collected(confirmed, draw, POSITIVES, text), _collected(some, draw, UNLABELLED, text), prior)


def value(text: str | None, table: np.ndarray, bias: float, known: dict[str, float]) -> float:
    words = distinct_words(text)
    weights = []
    for word in words:
        weight = known.get(word)
        if weight is None:
            if len(known) >= CACHED_WORDS:
                known.clear()
            weight = known[word] = float(table[word_features(word)].sum())
        weights.append(weight)
    return fsum(weights) / len(words) ** 0.5 + bias if words else bias


def _score_udf(shared):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        (table, bias), known = shared.value, {}
        for texts in batches:
            values = np.array([value(t, table, bias, known) for t in texts], float)
            yield pd.Series(_logistic(values))

    return score


def score(documents: DataFrame, model: ToxicityModel | None, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, score, predicted (1 if the score is at least ``threshold``)."""
    spark = documents.sparkSession
    if model is None:
        found = F.lit(0.0)
    else:
        found = _score_udf(spark.sparkContext.broadcast((model.weights, model.bias)))(F.col(text).cast("string"))
    return documents.select(doc_id, found.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
