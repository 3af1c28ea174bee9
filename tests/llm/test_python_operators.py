"""Personal data, URL templates, archives, toxicity, language and packing."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus import as_set, messy, messy_texts, prose

from gradeflow.llm import langid, packing, pii, toxicity, urls, warc

# --- personal data ---

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], list(BASE).index(s[0])))


def noisy(rng, length):
    pieces = ["a", "b.c", "@", "x@y.zz", ".", "-", " ", "+", "1", "23", "255", "256", "(4)", "4111 1111 1111 1111", "10.0.0.1",
              "+1 (988) 555-2485", "é", "\n", "://", "http://u:p@h.example/", "0", "00", "%", "_"]
    return "".join(rng.choice(pieces) for _ in range(length))


def test_base_spans_match_the_patterns():
    rng, automaton = random.Random(2), pii.anchors()
    for _ in range(3000):
        text = noisy(rng, rng.randrange(30))
        base = [s for s in pii.find_spans(text, automaton) if s[0] in pii.BASE_KINDS]
        assert base == brute_spans(text), text


@pytest.mark.parametrize("run", ["1" * 50_000, "a@" * 20_000, "1.2." * 20_000, "+1 " * 20_000, "1 " * 30_000, "a://" * 10_000])
def test_long_runs_take_linear_time(run):
    automaton = pii.anchors()

    def seconds(text: str) -> float:
        times = []
        for _ in range(3):
            start = time.perf_counter()
            pii.find_spans(text, automaton)
            times.append(time.perf_counter() - start)
        return min(times)

    assert seconds(run * 4) < 10 * seconds(run) + 0.05  # a quadratic search takes 16 times as long


def test_added_kinds_and_redaction():
    automaton = pii.anchors()
    text = "see https://bob:pw@host.example/x, IBAN: GB82 WEST 1234 5698 7654 32 or account no 12345678, account 10.0.0.1"
    kinds = {(k, text[s:e]) for k, s, e in pii.find_spans(text, automaton)}
    assert ("url", "https://bob:pw@host.example") in kinds and ("iban", "GB82 WEST 1234 5698 7654 32") in kinds
    assert ("account", "12345678") in kinds and ("ip", "10.0.0.1") in kinds
    clean = pii.redacted(text, pii.find_spans(text, automaton))
    assert clean == "see [URL]/x, IBAN: [IBAN] or account no [ACCOUNT], account [IP]"
    assert not pii.find_spans(clean, automaton) and pii.redacted(None, []) is None
    assert not pii.find_spans("a clean text, 3.5 of 10 on 2024-01-01.", automaton)


def test_personal_data_of_messy_rows(spark):
    docs = messy(spark)
    found = {(r.doc_id, len(r.spans)) for r in pii.find_personal_data(docs).collect()}
    assert (None, 1) in found and (4, 0) in found and len(pii.find_personal_data(docs).collect()) == len(messy_texts())
    redacted = pii.redact(docs)
    assert redacted.columns == docs.columns
    texts = [r.text for r in redacted.collect()]
    assert sum(t is not None and "[EMAIL]" in t for t in texts) == 1 and sum(t is None for t in texts) == 2
    assert pii.redact(messy(spark, [])).count() == 0


# --- addresses ---

RULES = [("block", "net", "/es/"), ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/")]


def brute_judge(addresses):
    """The template tree in plain Python: (host, path, rule, verdict, purity) per address."""
    rows = []
    for url in addresses:
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split(r"[/?#]", rest, maxsplit=1)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
        segments = [s for s in path.split("/") if s]
        shape = [re.sub(r"^.*[0-9].*?(\.[A-Za-z]{1,5})?$", lambda m: "*" + (m[1] or ""), s) for s in segments[: urls.DEPTH]]
        shape += ["**"] * (len(segments) > urls.DEPTH)
        rows.append([host, path, rule, verdict, tuple(shape)])
    segs = {(r[0], r[4]): list(r[4]) for r in rows}
    count = Counter((r[0], r[4]) for r in rows)
    for level in range(max((len(r[4]) for r in rows), default=0)):
        literals = defaultdict(Counter)
        for k, s in segs.items():
            if len(s) > level and not s[level].startswith("*"):
                literals[k[0], tuple(s[:level])][s[level]] += count[k]
        for k, s in segs.items():
            c = literals.get((k[0], tuple(s[:level])), {})
            if len(s) > level and not s[level].startswith("*") and len(c) >= urls.FAN and sum(c.values()) < urls.REUSE * len(c):
                s[level] = "*"
    stats = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        s = segs[r[0], r[4]]
        for d in range(len(s) + 1):
            node = stats[r[0], tuple(s[:d])]
            node[0] += 1
            node[1] += r[3] is not None
            node[2] += r[3] == "block"

    def share(n, b):
        value = (b + 1) / (n + 2)
        return value, value * (1 - value) / (n + 3)

    siblings = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    cells = {}
    for (host, branch), (_, n, b) in stats.items():
        value, variance = share(n, b)
        if branch and math.sqrt(variance) <= urls.SURE:
            cells[host, branch] = math.floor(value * urls.CELLS + 0.5)
            group = siblings[host, branch[:-1]][cells[host, branch]]
            group[0] += n
            group[1] += b
    merged = {}
    for key, groups in siblings.items():
        run, members = None, []
        for cell in sorted(groups):
            n, b = groups[cell]
            if run is not None:
                (low, low_variance), (high, high_variance) = share(*run), share(n, b)
                if abs(high - low) <= 2 * math.sqrt(low_variance + high_variance):
                    run[0] += n
                    run[1] += b
                    members.append(cell)
                    merged[key, cell] = run
                    continue
            run, members = [n, b], [cell]
            merged[key, cell] = run
    out = []
    for host, path, rule, verdict, shape in rows:
        p, s = urls.BASE_RATE, segs[host, shape]
        for d in range(len(s) + 1):
            pages, n, b = stats[host, tuple(s[:d])]
            if d == 0:
                n = pages
            elif (host, tuple(s[:d])) in cells:
                n, b = merged[(host, tuple(s[: d - 1])), cells[host, tuple(s[:d])]]
            p = (b + urls.PRIOR_PAGES * p) / (n + urls.PRIOR_PAGES)
        out.append((host, path, rule, verdict or ("block" if p >= urls.REJECT else "allow"), round(p, 9)))
    return out


def test_url_templates_match_brute_force(spark):
    rng = random.Random(6)
    words = ["news", "blog", "es", "en", "shop"]
    pages = [None, "no scheme", "http://", "HTTP://WWW.Example.COM/en/a?b#c", "x://h.net?q=/es/", "x://h.net/es", "a://b://c/d"]
    for _ in range(600):
        host = rng.choice(["h.net", "a.h.net", "example.com", "www.example.com", "o.org", "net"])
        path = "".join(f"/{rng.choice([*words, str(rng.randrange(99)), f'p{rng.randrange(9)}.html', prose(rng, 1, 3000)])}" for _ in range(rng.randrange(9)))
        pages.append(f"http://{host}{path}{rng.choice(['', '/', '?x=1', '#y'])}")
    pages += [f"https://h.net/es/{i}" for i in range(200)] + ["https://h.net/es", "https://h.net/es?x"] * 3
    frame = spark.createDataFrame([(i, u, "host", "h") for i, u in enumerate(pages)], "page_id long, url string, segments string, above string")
    found = urls.judge_urls(frame, RULES).orderBy("page_id").collect()
    rows = [(r.host, r.path, r.rule, r.verdict, round(r.purity, 9)) for r in found]
    assert rows == brute_judge(pages)
    assert any(r.rule is None and r.verdict == "block" for r in found)
    assert urls.judge_urls(frame.limit(0), RULES).count() == 0


def test_only_branches_of_similar_shares_are_merged(spark):
    shares = {"a": 110, "b": 990, "c": 480, "d": 1970, "e": 2}  # rejected pages of 200, 1000, 500, 2000 and 4
    sizes = {"a": 200, "b": 1000, "c": 500, "d": 2000, "e": 4}
    pages = [f"http://q.net/{x}/{'bad' if i < n else 'good'}/y" for x, n in shares.items() for i in range(sizes[x])]
    pages += [f"http://q.net/{x}/other" for x in shares]
    rules = [("block" if kind == "bad" else "allow", "q.net", f"/{x}/{kind}/") for x in shares for kind in ("bad", "good")]
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    found = {r.path: r for r in urls.judge_urls(frame, rules).collect() if r.rule is None}
    verdicts = {path[1]: r.verdict for path, r in found.items()}
    assert verdicts == {"a": "allow", "b": "block", "c": "block", "d": "block", "e": "allow"}
    # b and d share their counts, c lies apart from them and a from all
    p = {path[1]: r.purity for path, r in found.items()}
    assert p["a"] < 0.7 and p["c"] < p["d"] - 0.01 and abs(p["b"] - p["d"]) < 1e-4


def test_deep_branches_are_judged_apart(spark):
    deep = "http://net/" + "/".join("abcdefghij")
    pages = [f"{deep}/es/{i}" for i in range(300)] + [f"{deep}/en/{i}" for i in range(300)]
    pages += [f"http://o.org/{'x/' * 8}{format(i, 'b').translate(str.maketrans('01', 'uv'))}/{j}" for i in range(30) for j in range(2)]
    pages.append("http://one.org" + "/s" * 300)
    rules = [("block", "net", f"/{'/'.join('abcdefghij')}/es/{d}") for d in range(1, 10)] + [("allow", "net", f"/{'/'.join('abcdefghij')}/en/{d}") for d in range(1, 10)]
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    found = {r.page_id: r for r in urls.judge_urls(frame, rules).collect()}
    assert len(found) == len(pages)
    assert found[0].rule is None and found[0].verdict == "block" and found[0].template.endswith("/j/es/*")
    assert found[300].rule is None and found[300].verdict == "allow" and found[300].template.endswith("/j/en/*")
    assert {found[i].template for i in range(600, 660)} == {"/" + "x/" * 8 + "*/*"}
    assert found[660].template == "/s" * 300


# --- archives ---


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip_and_errors(version):
    records = [("http://a b/é", b"x\n\ny"), (None, b""), ("u", b"\n" * 5), ("u", b"http://x 0 1 2 3\n")]
    data = warc.build_arc(records, version)
    parsed = list(warc.parse_arc(data))
    assert [p[3] for p in parsed] == [r[1] for r in records] and parsed[0][0] == "http://a%20b/é"
    assert [p[2] for p in parsed] == [warc.DATE] * 4 and list(warc.parse_arc(b"")) == []
    for broken in (data[:-3], b"nonsense\n", data + b"bad line\n", data.replace(b"%d 0 gradeflow" % version, b"9 0 gradeflow")):
        with pytest.raises(ValueError):
            list(warc.parse_arc(broken))
    assert warc.iso_date("19980203") == "1998-02-03T00:00:00Z" and warc.iso_date(warc.DATE) == "2024-01-01T00:00:00Z"


@pytest.mark.parametrize("version", [1, 2])
def test_pages_through_archives(spark, version, tmp_path):
    html = ["<p>é</p>", None, "", "same", "same", "same", "WARC/1.1\r\n\r\n\r\nWARC-Type: x\r\n", "x" * 300_000, "\x00\r\n"]
    rows = [(i, f"http://h/{i}", h, "k") for i, h in enumerate(html)] + [(None, None, "same", "k"), (None, "u", "lone", "k"), (7, "u", html[7], "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    found = [(r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(pages, version).collect()]
    expected = []
    for page, _, h, _ in rows:
        data = (h or "").encode()
        top = max((p for p, _, x, _ in rows if (x or "") == (h or "") and p is not None), default=None)
        revisit = top is not None and page != top
        expected.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert as_set(found) == as_set(expected)
    records = warc.convert(warc.archives(pages, version))
    assert warc.typed(records, min_bytes=5).filter("winner is not null").count() == 0  # "same" is too short
    typed = warc.typed(records, min_bytes=4)
    assert typed.filter("winner is not null").count() == 3
    warc.write_warc(typed, str(tmp_path / "plain"), "none")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "plain").glob("part-*")))
    blocks = list(warc.parse_warc(raw))
    assert len(blocks) == len(rows)
    for fields, block in blocks:
        assert fields["warc-block-digest"] == "sha1:" + warc.sha1_base32(block) and fields["warc-record-id"].startswith("<urn:uuid:")
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_archives_are_handled_in_bounded_pieces(spark, tmp_path):
    rows = [(i, "u", f"{i} " + "x" * 100_000) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    typed = warc.typed(warc.convert(warc.archives(pages)))
    warc.write_warc(typed.coalesce(1), str(tmp_path / "out"))
    plan = typed._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan  # workers make no pandas objects of their batches
    assert spark.read.format("binaryFile").load(str(tmp_path / "out")).count() == 1
    (file,) = (tmp_path / "out").glob("part-*")
    data = file.read_bytes()
    tracemalloc.start()
    keys = {row[0] for row in warc.read_file(data)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert keys == set(range(300)) and peak < 5_000_000  # of 30 MB unpacked
    sizes = [batch.num_rows for batch in warc.as_batches(((b"x" * 1_000_000,) for _ in range(20)), "record binary")]
    assert sum(sizes) == 20 and max(sizes) <= 5
    # many small partitions are no reason for as many files, each of which costs its executor processes
    warc.write_warc(typed.repartition(300), str(tmp_path / "dealt"))
    assert len(list((tmp_path / "dealt").glob("part-*"))) <= warc.WRITERS * spark.sparkContext.defaultParallelism


# --- toxicity and language ---


def spoken(rng, words, toxic=False, first="w"):
    text = [f"{first}{rng.randrange(300):x}" .translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(words)]
    for _ in range(4 if toxic else 0):
        text[rng.randrange(words)] = rng.choice(["vileness", "vilest", "viler", "vilely"])
    return " ".join(text)


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(3)
    rows = [(i, spoken(rng, rng.randrange(30, 200), i % 7 == 0), "en", "a") for i in range(1200)]
    docs = messy(spark, rows + [(5000, None, None, None), (5001, "", None, None), (None, spoken(rng, 50, True), None, None)])
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(600)] + [(3, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(found) == 1203 and all(0 <= r.score <= 1 for r in found.values()) and found[5000].predicted == found[5001].predicted == 0
    held = [found[i] for i in range(600, 1200)]
    assert sum(r.predicted == (r.doc_id % 7 == 0) for r in held) > 580 and found[None].predicted == 1
    assert toxicity.fit(docs, labels.filter("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(messy(spark, []), model).count() == 0


def test_non_negative_risk_keeps_the_bias_in_bounds():
    rng = np.random.default_rng(1)
    sample = [(np.unique(rng.integers(0, 500, 40)), np.ones(1), 20) for _ in range(300)]
    sample = [(ids, np.ones(len(ids), int), words) for ids, _, words in sample]
    model = toxicity.train(sample[:30], sample, 0.1)
    assert np.isfinite(model.weights).all() and abs(model.bias) < 50
    assert toxicity.train([], sample, 0.1) is None


def test_language_of_held_out_texts_and_rejection(spark):
    rng = random.Random(8)
    rows = [(i, spoken(rng, rng.randrange(3, 60), first="abcd"[i % 4] * 2), ["aa", "bb", "cc", "dd"][i % 4] if i < 400 else None, "s") for i in range(800)]
    odd = [(1000, None, "aa", None), (1001, "", "aa", None), (1002, "123 !?", "aa", None), (1003, "9 Ω", None, None), (None, "aaw aag", "aa", None)]
    docs = messy(spark, rows + odd)
    model = langid.fit(docs)
    found = {r.doc.doc_id: r.found for r in langid.identify(docs, model).collect()}
    right = sum(found[i].lang_pred == ["aa", "bb", "cc", "dd"][i % 4] for i in range(400, 800))
    assert right > 390
    for i in (1000, 1001, 1002):
        assert (found[i].lang_pred, found[i].score, found[i].rejected) == ("und", 0.0, True)
    assert found[1003].lang_pred in model.languages and 0 <= found[1003].score <= 1
    kept = langid.drop_rejected(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id < 800").count() >= 790
    nothing = langid.fit(docs.filter("lang is null"))
    assert nothing is None and langid.drop_rejected(docs, nothing).count() == 0
    assert langid.identify(messy(spark, []), model).count() == 0


def test_blocks_do_not_change_a_language_score(monkeypatch):
    text, is_letter = prose(random.Random(1), 500), langid.letters()
    rng = np.random.default_rng(0)
    table, bias = rng.normal(size=(langid.BUCKETS, 3)), np.zeros(3)
    whole = langid.logits(text, table, bias, is_letter)
    monkeypatch.setattr(langid, "BLOCK", 64)
    assert np.allclose(whole, langid.logits(text, table, bias, is_letter))


# --- packing ---


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


ODD = ["", " ", "\n\n", "don't I'LL 's 't", "<|endoftext|>x a<|startoftext|>", "ΑΣ Σ İstanbul ǅ ẞ ß", "e\u0301 \u0301a ﬁ Å",
       "\xa0a\x85b\tc\x1cd\u200be", "中文 ½² ١٢ 👍🏽", "ab12cd!!??", "x" * 5000, "a_b-c'd\"e"]


def test_word_encoder_equals_the_tokenizer():
    encoder, rng = packing.WordEncoder(tokenizer()), random.Random(4)
    chars = "abcXYZ éÉßẞİıΣσς'\n\t\u0301\xa0\x85\u200b0½中<|>.,!'sltd"
    for text in [*ODD, *("".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(1500))]:
        expected = [*encoder.whole.encode(text, add_special_tokens=False).ids, 1]
        assert encoder.encode(text, 1).tolist() == expected, text


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(7)
    for _ in range(200):
        sizes = [rng.randrange(1, 33) for _ in range(rng.randrange(40))]
        bins: list[list[int]] = []
        for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            for b in bins:
                if sum(sizes[i] for i in b) + sizes[item] <= 32:
                    b.append(item)
                    break
            else:
                bins.append([item])
        assert packing.first_fit_decreasing(sizes, 32) == bins
        packed = packing.pack_tails(sizes, 32)
        pieces = sorted(p for s in packed for p in s)
        assert [x for i, start, n in pieces for x in [(i, k) for k in range(start, start + n)]] == [(i, k) for i, n in enumerate(sizes) for k in range(n)]
        lengths = [sum(p[2] for p in s) for s in packed]
        assert all(n == 32 or n & (n - 1) == 0 for n in lengths) and sum(n < 32 for n in lengths) <= 5


def test_every_token_lies_in_one_piece(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 8)
    rows = messy_texts() + [(500 + i, t, None, None) for i, t in enumerate(ODD)]
    pieces = packing.pack(messy(spark, rows), tokenizer(), capacity=64).collect()
    encoder = packing.WordEncoder(tokenizer())
    expected, found = Counter(), defaultdict(list)
    texts = defaultdict(list)
    for doc, text, *_ in rows:
        ids = encoder.encode(text, 1)
        expected[doc] += len(ids)
        texts[doc].append(ids)
    sequences = defaultdict(list)
    for p in pieces:
        found[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
        assert any(len(ids) == p.doc_tokens and zlib.crc32(ids[p.start : p.start + p.length].astype("<u4").tobytes()) == p.ids_crc32 for ids in texts[p.doc_id])
    assert {d: sum(p.length for p in ps) for d, ps in found.items()} == expected
    for doc, ps in found.items():
        if len(texts[doc]) == 1:
            ends = sorted((p.start, p.length) for p in ps)
            assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False)) and ends[0][0] == 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(messy(spark, []), tokenizer()).count() == 0
