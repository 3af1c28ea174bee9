"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased, everything but letters becomes one blank, and every run of two to four
characters is hashed into a table of embeddings.  Their mean goes through a linear softmax.  Both
are trained by stochastic gradient descent in numpy on the driver, on a bounded sample: at most
``PER_LANGUAGE`` labelled rows per language in expectation (chosen by hash of id and text) of the
``LANGUAGES`` most frequent labels.  Each row gives its whole text, as counts of buckets, ``PIECES`` short
pieces spread over it, and one piece of noise: its letters in random order, which is to be no language more
than another.  A fifth of the sampled rows is set apart: it fixes the temperature of the softmax, and the
confidence below which a text is rejected, the largest that rejects at most ``REJECTED`` of the rightly
recognised texts and pieces.

Averaging and the linear layer commute, so scoring sums rows of one (bucket, language) table, over
whole texts, in blocks.  The model is a few numbers per bucket and language and travels to the
tasks by broadcast; it does not grow with the data.

Nulls and empties: a text that is null or has no letter is ``und`` with score 0 and rejected.  Rows
without a language or id train nothing wrong: those without a language are left out.  Without any
labelled row every text is ``und``.  Ties go to the first language in order.  Repeated rows are
scored one by one; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BUCKETS, WIDTH, GRAMS = 1 << 16, 16, (2, 3, 4)
LANGUAGES, PER_LANGUAGE, PIECES, REJECTED = 256, 600, 6, 0.0005
EPOCHS, RATE = 3, 0.5
UNKNOWN = "und"
BLOCK = 1 << 16


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # float32, buckets x languages: embeddings times weights
    bias: np.ndarray
    temperature: float
    threshold: float


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def subwords(text: str, is_letter: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of all subwords, block by block; nothing if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = is_letter[codes]
    if not alpha.any():
        return
    codes = np.where(alpha, codes, np.uint32(32))
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]
    blank = np.array([32], np.uint32)
    codes = np.concatenate([blank, codes[keep], blank])
    for i in range(0, len(codes), BLOCK):
        part = codes[i : i + BLOCK + max(GRAMS) - 1]
        value = part.copy()
        for n in range(2, max(GRAMS) + 1):
            value = value[:-1] * np.uint32(0x01000193) ^ part[n - 1 :]
            if n in GRAMS and len(value):
                yield (value[:BLOCK] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def logits(text: str | None, table: np.ndarray, bias: np.ndarray, is_letter: np.ndarray) -> np.ndarray | None:
    total, count = np.zeros(table.shape[1]), 0
    for ids in subwords(text or "", is_letter):
        total += table[ids].sum(axis=0, dtype=np.float64)
        count += len(ids)
    return total / count + bias if count else None


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def bag(text: str | None, is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's subwords in order and how often each occurs, block by block."""
    total = np.zeros(BUCKETS, np.int64)
    for ids in subwords(text or "", is_letter):
        total += np.bincount(ids, minlength=BUCKETS)
    ids = np.flatnonzero(total).astype(np.int32)
    return ids, total[ids]


@dataclass
class Sampled:
    language: str
    apart: bool
    whole: tuple[np.ndarray, np.ndarray]
    pieces: list[str]


def train(samples: list[Sampled]) -> LanguageModel | None:
    """The model of sampled rows, given in a fixed order."""
    languages = sorted({sample.language for sample in samples})
    if not languages:
        return None
    is_letter, place = letters(), {language: i for i, language in enumerate(languages)}
    rng = np.random.default_rng(7)
    embeddings = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    weights, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    weights += rng.normal(0, 0.1, weights.shape)
    even = np.full(len(languages), 1 / len(languages))
    fit, apart = [], []  # (buckets, shares, wanted chances)
    for sample in samples:
        wanted = np.eye(len(languages))[place[sample.language]]
        noise = list(sample.pieces[1])
        rng.shuffle(noise)
        bags = [(sample.whole, wanted), *((bag(piece, is_letter), wanted) for piece in sample.pieces)]
        if not sample.apart and len(languages) > 1:
            bags.append((bag("".join(noise), is_letter), even))
        into = apart if sample.apart else fit
        into += [(ids, (counts / counts.sum()).astype(np.float32), chances) for (ids, counts), chances in bags if len(ids)]
    fit = fit or apart
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(fit)):
            ids, shares, wanted = fit[k]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = shares @ embeddings[ids]
            error = softmax(hidden @ weights + bias) - wanted
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= rate * error
            embeddings[ids] -= np.outer(shares, rate * WIDTH * back)
    table = (embeddings @ weights).astype(np.float32)
    apart = apart or [f for f in fit if f[2].max() == 1]
    raw = np.array([shares @ table[ids] + bias for ids, shares, _ in apart])
    targets = np.array([int(wanted.argmax()) for _, _, wanted in apart])
    temperatures = np.geomspace(0.05, 20, 60)
    losses = [-np.log(softmax(raw / t)[np.arange(len(raw)), targets] + 1e-12).mean() for t in temperatures]
    temperature = float(temperatures[int(np.argmin(losses))])
    chances = softmax(raw / temperature)
    right = chances.max(axis=1)[chances.argmax(axis=1) == targets]
    threshold = float(np.quantile(right, REJECTED)) if len(right) else 0.0
    return LanguageModel(languages, table, bias, temperature, threshold)


def _bag_udf():
    @F.pandas_udf("ids binary, counts binary")
    def bags(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        is_letter = letters()
        for texts in batches:
            found = [bag(text, is_letter) for text in texts]
            rows = [(ids.astype("<i4").tobytes(), counts.astype("<i4").tobytes()) for ids, counts in found]
            yield pd.DataFrame(rows, columns=["ids", "counts"])

    return bags


def sampled_rows(
    documents: DataFrame, learn: Column, doc_id: str, text: str, lang: str, per_language: int = PER_LANGUAGE
) -> list[Sampled]:
    """A bounded sample of the rows where ``learn`` holds: bags of whole texts, and pieces of at most 300,
    100 and 30 characters.  Repeated rows are drawn once."""
    named = documents.filter(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.col(doc_id).alias("id")
    )
    frequent = named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["count"] for r in frequent.collect()}
    if not counts:
        return []
    million = 1_000_000
    share = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(million, million * per_language // n + 1))])
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(million))
    drawn = named.filter(draw < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0))).withColumn(
        "order", F.xxhash64("text", "id", "lang")
    )
    most = 2 * per_language * len(counts)
    last = drawn.select("order").distinct().orderBy("order").limit(most).agg(F.max("order").alias("last")).first()["last"]
    if last is None:
        return []
    chosen = drawn.filter(F.col("order") <= last).groupBy("order").agg(F.first("lang").alias("lang"), F.first("text").alias("text"))
    length = F.char_length("text")
    sizes = [300, 100, 30] * (PIECES // 3)
    pieces = [F.substring("text", F.floor(length * (k / len(sizes))).cast("int") + 1, F.lit(size)) for k, size in enumerate(sizes)]
    sample = chosen.select("order", "lang", F.array(*pieces).alias("pieces"), _bag_udf()("text").alias("bag"))
    return [
        Sampled(
            r["lang"],
            r["order"] % 5 == 0,
            (np.frombuffer(r["bag"]["ids"], "<i4"), np.frombuffer(r["bag"]["counts"], "<i4")),
            r["pieces"],
        )
        for r in sorted(sample.collect(), key=lambda r: r["order"])
    ]


def fit(
    documents: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> LanguageModel | None:
    return train(sampled_rows(documents, F.lit(True) if learn is None else learn, doc_id, text, lang))


def _predict_udf(shared):
    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        is_letter = letters()
        languages, table, bias, temperature, threshold = shared.value
        for texts in batches:
            rows = []
            for text in texts:
                raw = logits(text, table, bias, is_letter) if languages else None
                if raw is None:
                    rows.append((UNKNOWN, 0.0, True))
                else:
                    chances = softmax(raw / temperature)
                    best = int(chances.argmax())
                    rows.append((languages[best], float(chances[best]), bool(chances[best] < threshold)))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    return predict


def identify(documents: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """(doc, found): each row as a struct, and (lang_pred, score, rejected)."""
    spark = documents.sparkSession
    known = model or LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    parts = (known.languages, known.table, known.bias, known.temperature, known.threshold)
    shared = spark.sparkContext.broadcast(parts)
    found = _predict_udf(shared)(F.col(text).cast("string"))
    return documents.select(F.struct("*").alias("doc"), found.alias("found"))


def drop_rejected(documents: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    return identify(documents, model, text).filter(~F.col("found.rejected")).select("doc.*")
