"""The registered queries of the corpus operators, and DuckDB SQL where SQL can express them.

Each query applies its operator with production parameters to a whole table and derives the columns
of its contract from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.llm import (
    decontaminate,
    langid,
    licenses,
    lines,
    minhash,
    packing,
    pii,
    planes,
    secrets,
    toxicity,
    urls,
    variants,
    warc,
)
from gradeflow.llm.sql import ORACLES

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = licenses.known_licenses(spark)
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), known, cue=licenses.CUE)


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


@query
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("kept"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id",
        *[pii.count_kind(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@query
def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), RULES)


@query
def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def remainder(parts: int) -> Column:
    """crc32 of doc_id as text, modulo ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), learn=remainder(4) != 2)
    found = toxicity.score(documents, model, threshold=0.3)
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents, learn=remainder(3) != 1)
    found = langid.identify(documents, model).select("doc.doc_id", "found.*")
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end=1, capacity=2048)


@query
def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.quality(table(spark, sf_dir, "documents"))


@query
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select(
        "doc_id",
        *[pii.count_kind(F.col("spans"), kind).alias(f"n_{kind}") for kind in secrets.BASE_KINDS],
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


def misspelt(doc_id: Column, run: Column, one_in: int = 31) -> Column:
    """``run``, or, for one in so many by the hash of id and run, ``run`` without one code point."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = variants.runs_of(table(spark, sf_dir, "documents"), min_length=7)
    counted = variants.count_words(runs, misspelt(F.col("doc_id"), F.col("run")), min_length=7, min_count=2)
    return variants.group_variants(counted, min_ratio=10)


@query
def op13_bit_plane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = planes.cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3)
    return planes.with_inertia(assigned, centroids)


__all__ = ["ORACLES", "QUERIES"]
