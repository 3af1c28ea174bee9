"""Registered corpus queries against their SQL, and the pipeline against its stages."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import corpus_pipeline
import pytest
from conftest import TESTDATA
from corpus import messy, messy_texts
from parity import compare, duck_connection

import __spark_entry__ as contract
from gradeflow.llm import langid, pii, queries, toxicity

SMALL = f"{TESTDATA}/sf0.001"


def test_every_operator_and_the_pipeline_are_registered():
    names = set(contract.queries())
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_duckdb(spark, name):
    con = duck_connection(SMALL)
    assert compare(queries.QUERIES[name](spark, SMALL), con, queries.ORACLES[name]) is None


def test_stages_keep_the_columns_and_what_they_should(spark):
    docs = messy(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        assert kept.columns == docs.columns, name
        ids = [r.doc_id for r in kept.collect()]
        assert set(ids) <= {d for d, *_ in messy_texts()}, name
        assert 8 in ids, name
    assert stage(spark, messy(spark, []), SMALL).count() == 0


def test_pipeline_runs_every_stage_on_what_is_left(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.select("doc_id").distinct().count())
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[2] == counts[4]
    whole = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert whole.columns == docs.columns and whole.agg({"length": "sum"}).first()[0] == docs.agg({"length": "sum"}).first()[0]


def _column_types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema}


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_personal_data_query_keeps_its_contract(spark):
    found = queries.QUERIES["op4_personal_data"](spark, SMALL)
    types = _column_types(found)
    assert [types[c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == ["bigint"] * 4
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = brute_base_spans(texts[r.doc_id])
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == _digest(listed) and set(listed.split(",")) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in pii.BASE_KINDS]


def brute_base_spans(text):
    text, spans = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            spans.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append(("phone", *m.span()))
    return sorted(spans, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


def test_url_query_keeps_its_contract(spark):
    found = {r.page_id: r for r in queries.QUERIES["op5_url_templates"](spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(found) == len(pages)
    for page in pages:
        r, (host, path) = found[page.page_id], ("", "")
        if page.url is not None and "://" in page.url:
            rest = page.url.split("://", 1)[1]
            host = re.split("[/?#]", rest, maxsplit=1)[0]
            path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(h + p, v) for v, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_learned_queries_keep_their_contracts(spark):
    texts = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    toxic = queries.QUERIES["op7_toxicity"](spark, SMALL)
    assert _column_types(toxic) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = toxic.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    spoken = queries.QUERIES["op8_language"](spark, SMALL)
    types = _column_types(spoken)
    assert (types["held_out"], types["lang_pred"], types["score"]) == ("boolean", "string", "double")
    rows = spoken.collect()
    learned = {t.lang for i, t in texts.items() if t.lang is not None and zlib.crc32(str(i).encode()) % 3 != 1}
    right = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        wordless = not any(c.isalpha() for c in texts[r.doc_id].text or "")
        assert r.lang_pred == "und" if wordless else r.lang_pred in learned
        right += r.lang_pred == texts[r.doc_id].lang
    assert right > 0.95 * len(rows)


def test_scores_follow_from_the_models(spark):
    """Scores recomputed in plain Python from the fitted numbers."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    for r in toxicity.score(docs, model).collect():
        words = set(re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower()))
        total = 0.0
        for word in words:
            for name in [f"={word}", *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) > n)]:
                total += float(model.weights[zlib.crc32(name.encode()) % toxicity.BUCKETS])
        value = model.bias + (total / math.sqrt(len(words)) if words else 0.0)
        assert abs(r.score - 1 / (1 + math.exp(-value))) < 1e-6
    model = langid.fit(docs)
    for r in langid.identify(docs, model).limit(60).collect():
        kept = "".join(c if c.isalpha() else " " for c in (r.doc.text or "").lower())
        kept = " " + re.sub(" +", " ", kept).strip() + " " if kept.strip() else ""
        sums, count = [0.0] * len(model.languages), 0
        for n in (2, 3, 4):
            for i in range(len(kept) - n + 1):
                value = ord(kept[i])
                for c in kept[i + 1 : i + n]:
                    value = value * 0x01000193 & 0xFFFFFFFF ^ ord(c)
                bucket = (value * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - langid.BUCKETS.bit_length() + 1
                sums = [s + float(w) for s, w in zip(sums, model.table[bucket], strict=True)]
                count += 1
        if not count:
            assert (r.found.lang_pred, r.found.score, r.found.rejected) == ("und", 0.0, True)
            continue
        raw = [(s / count + float(b)) / model.temperature for s, b in zip(sums, model.bias, strict=True)]
        chances = [math.exp(x - max(raw)) for x in raw]
        best = max(chances) / sum(chances)
        assert abs(r.found.score - best) < 1e-6
        assert r.found.lang_pred == model.languages[chances.index(max(chances))]
        assert r.found.rejected == (r.found.score < model.threshold)


def test_packing_query_keeps_its_contract(spark):
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = queries.QUERIES["op9_packing"](spark, SMALL).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for doc, parts in pieces.items():
        ids = [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1]
        place = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == place and r.length > 0 and r.doc_tokens == len(ids)
            piece = ids[place : place + r.length]
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))
            place += r.length
        assert place == len(ids)
    for parts in sequences.values():
        place = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        assert place <= 2048
