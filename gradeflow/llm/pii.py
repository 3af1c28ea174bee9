"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds anchors: at-signs, digits, plus signs, ``://`` and
identifier cues.  A local parser per kind expands each anchor to its bounds and validates it.

Base kinds, leftmost and non-overlapping per kind, a failing match consumes its text:
``email``, ``ip`` (parts at most 255), ``card`` (12 to 19 digits, Luhn), ``phone`` (9 to 15 digits).
Added kinds: ``url`` (an address with user information before its host), ``iban`` (after a cue,
mod 97), ``account`` (6 to 17 digits after a cue, outside base spans).

Positions count code points, ends are exclusive.  A null text is empty and has no spans; redaction
leaves it null.  Repeated rows are searched row by row; other columns pass through unread.  Work is
linear in the text: every parser resumes after what it consumed.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account")
SPANS = "array<struct<kind:string,start:int,end:int>>"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
CUES = {"iban": ("iban",), "account": ("account", "acct", "konto", "cuenta", "compte")}

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DIGITS = re.compile(r"[0-9]++")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
AUTHORITY = re.compile(r"[^\s/?#@]++@([A-Za-z0-9.\-\[\]:]++)")
IBAN = re.compile(r"[ :#.]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?: ?(?:no|nr|number|num)\b)?[ .:#=]{0,4}([0-9](?:-?[0-9]){5,16})(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def anchors():
    """The automaton; its values are (kind of anchor, length of the pattern)."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for sign, kind in (("@", "at"), ("+", "plus"), ("://", "scheme"), *((str(d), "digit") for d in range(10))):
        automaton.add_word(sign, (kind, len(sign)))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in (cue, cue.upper(), cue.capitalize()):
                automaton.add_word(form, (kind, len(form)))
    automaton.make_automaton()
    return automaton


def _run_left(text: str, start: int, least: int, allowed: frozenset) -> int:
    while start > least and text[start - 1] in allowed:
        start -= 1
    return start


def _ip_valid(found: str) -> bool:
    parts = [part.lstrip("0") for part in found.split(".")]
    return all(len(part) < 3 or (len(part) == 3 and int(part) <= 255) for part in parts)


def find_spans(text: str | None, automaton) -> list[tuple[str, int, int]]:
    """All spans of a text, sorted by start, then by kind as listed in ``KINDS``."""
    if not text:
        return []
    spans, later = [], []
    resume = dict.fromkeys(("email", "ip", "card", "phone", "url"), 0)
    for last, (anchor, length) in automaton.iter(text):
        at, end = last + 1 - length, last + 1
        if anchor == "digit":
            if at >= resume["ip"]:
                match = IP.match(text, at)
                resume["ip"] = match.end() if match else DIGITS.match(text, at).end()
                if match and _ip_valid(match[0]):
                    spans.append(("ip", at, match.end()))
            if at >= resume["card"] and (match := CARD.match(text, at)):
                resume["card"] = match.end()
                digits = re.sub("[ -]", "", match[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", at, match.end()))
        elif anchor == "at":
            match = DOMAIN.match(text, end)
            start = _run_left(text, at, resume["email"], LOCAL) if match else at
            if start < at:
                resume["email"] = match.end()
                spans.append(("email", start, match.end()))
        elif anchor == "plus":
            if at >= resume["phone"] and (match := PHONE.match(text, at)):
                resume["phone"] = match.end()
                if 9 <= sum(c.isdigit() for c in match[0]) <= 15:
                    spans.append(("phone", at, match.end()))
        elif anchor == "scheme":
            start = _run_left(text, at, resume["url"], SCHEME)
            if start < at and (match := AUTHORITY.match(text, end)):
                resume["url"] = match.end()
                spans.append(("url", start, match.end()))
        elif anchor == "iban":
            if (match := IBAN.match(text, end)) and iban_valid(match[1]):
                spans.append(("iban", match.start(1), match.end(1)))
        elif match := ACCOUNT.match(text, end):
            later.append(("account", match.start(1), match.end(1)))
    if later:
        base = merged(sorted((s for s in spans if s[0] in BASE_KINDS), key=lambda s: s[1]))
        ends = [s[2] for s in base]
        for span in dict.fromkeys(later):
            after = bisect_right(ends, span[1])  # the first base run that ends behind its start
            if after == len(base) or span[2] <= base[after][1]:
                spans.append(span)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def merged(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs of overlapping spans, sorted by start, as one span each with the kind of its first."""
    out: list[tuple[str, int, int]] = []
    for kind, start, end in spans:
        if out and start < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(end, out[-1][2]))
        else:
            out.append((kind, start, end))
    return out


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """``text`` with each span, or run of overlapping spans, replaced by the kind of its first."""
    if not spans:
        return text
    out, done = [], 0
    for kind, start, end in merged(spans):
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def _spans_udf():
    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        automaton = anchors()
        return pd.Series([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_spans(t, automaton)] for t in texts])

    return spans


def _redact_udf():
    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        automaton = anchors()
        return pd.Series([redacted(t, find_spans(t, automaton)) for t in texts], dtype=object)

    return redact


def find_personal_data(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id and ``spans``, an array of (kind, start, end)."""
    return documents.select(doc_id, _spans_udf()(F.col(text).cast("string")).alias("spans"))


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with personal data in ``text`` replaced by ``[KIND]``; all rows stay."""
    return documents.withColumn(text, _redact_udf()(F.col(text).cast("string")))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
