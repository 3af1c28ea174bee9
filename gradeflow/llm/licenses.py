"""Licence scan by digests of canonical texts.

A text is made canonical: A-Z in lower case, copyright lines dropped, signs and white space to one
blank, and equivalent spellings to one.  Its MD5 is looked up among the digests of known licence
texts: for the whole document, and for each of its lines as a text of its own, which finds licence
notices.  Digests meet in one hash join; texts never move.

Nulls and empties: a null text or one without letters has an empty canonical form and matches
nothing.  Repeated rows are scanned row by row; extra columns are ignored; equal known texts under
several names yield the smallest name.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.llm.common import broadcast_if_small, lower_ascii

#: Lines dropped before comparison, found after lower-casing.
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright[ \t]*(\(c\)|©|[0-9]|by )|\(c\)|©|all rights reserved)[^\n]*$"
SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Equivalent spellings, applied in this order to the blank-separated form.
SPELLINGS = (
    (r"\blicence", "license"),
    (r"\bnon commercial\b", "noncommercial"),
    (r"\bsub license", "sublicense"),
    (r"\bcopyright (owner|holder)s?\b", "copyright holder"),
    (r"\b(this|the) (work|software|program|file|project|code|text|document) is ", ""),
    (r"\b(released|distributed|published|available|provided) under\b", "licensed under"),
    (r"\bunder (the )?(terms|conditions) of\b", "under"),
    (r"\bunder the\b", "under"),
    (r"\bcreative commons attribution\b", "cc by"),
    (r"\bcc by noncommercial\b", "cc by nc"),
    (r"\bcc by share ?alike\b", "cc by sa"),
    (r"\b(gnu )?general public license\b", "gpl"),
    (r"\b(gnu )?lesser gpl\b", "lgpl"),
    (r"\bgnu (l?gpl)\b", "$1"),
    (r"\bversion ([0-9])", "$1"),
    (r"\bv([0-9])", "$1"),
    (r"\b([0-9]) 0\b", "$1"),
    (r"\b(gpl|mit|isc|apache|zlib|bsd|cc by) license\b", "$1"),
)

#: Known texts by SPDX name: notices, and short licences in full (public texts, fixed values).
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", "Licensed under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
#: Each notice and text listed here has one of these words, and SPELLINGS never make one.
CUE = r"(?i)under|permission|redistribution|subject|spdx"
TEXTS = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF '
        "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
        "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all "
        'copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)


def canonical(text: Column) -> Column:
    """The canonical form; an empty string for null."""
    form = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    form = F.trim(F.regexp_replace(form, SIGNS, " "))
    for spelling, one in SPELLINGS:
        form = F.regexp_replace(form, spelling, one)
    return F.trim(form)


#: Public full texts, one file by SPDX name.
FULL_TEXTS = Path(__file__).parent / "license_texts"
#: Usual titles of texts that do not begin with their own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "BSD-3-Clause-UC": ("BSD License", "BSD 3-Clause License"),
}
FURTHER_NOTICES = (
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2 or later."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3 or later."),
)
#: Names that stand in an identifier line as they are, and those that say "only" or "or later" behind.
PLAIN_NAMES = ("Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "MPL-1.1", "MPL-2.0", "CC0-1.0")
PLAIN_NAMES += ("CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
GNU_NAMES = ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "GFDL-1.2", "GFDL-1.3")


def identifier_lines() -> list[tuple[str, str]]:
    """Notices by machine-readable identifier."""
    names = [(name, name) for name in (*PLAIN_NAMES, *GNU_NAMES)]
    names += [(name, f"{name}{kind}") for name in GNU_NAMES for kind in ("-only", "-or-later")]
    return [(name, f"SPDX-License-Identifier: {identifier}") for name, identifier in names]


END = "END OF TERMS AND CONDITIONS"


def _forms(name: str, text: str) -> set[str]:
    """A full text with and without its title, and with and without what follows its terms."""
    whole = [text]
    if END in text:
        terms, _, _ = text.partition(END)
        whole += [terms, terms + END]
    if name in TITLES:
        return {form for body in whole for form in (body, *(f"{title}\n\n{body}" for title in TITLES[name]))}
    return {form for body in whole for form in (body, re.split(r"\n[ \t]*\n", body.strip(), maxsplit=1)[-1])}


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of all notices, and of all full texts in each of their forms."""
    files = [(path.stem, path.read_text("utf-8")) for path in sorted(FULL_TEXTS.glob("*.txt"))]
    full = [(name, form) for name, text in (*TEXTS, *files) for form in sorted(_forms(name, text))]
    return [*NOTICES, *FURTHER_NOTICES, *identifier_lines(), *full]


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license, text) of the texts known here; any table of that form can stand in for it."""
    return spark.createDataFrame(known_texts(), "license string, text string")


def license_digests(licenses: DataFrame) -> DataFrame:
    """(digest, license), one row per canonical text."""
    forms = licenses.select("license", canonical(F.col("text")).alias("form")).filter("form != '' and license is not null")
    return forms.groupBy(F.md5("form").alias("digest")).agg(F.min("license").alias("license"))


def scan_licenses(
    documents: DataFrame, licenses: DataFrame, cue: str | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``cue``, if given, is a pattern that every line equal to a known text holds; other lines are
    not made canonical.

    Per document: doc_id, digest (of the whole canonical text), license (that it is, else null),
    n_notices (lines that are known texts), notices (their distinct names, sorted)."""
    known = broadcast_if_small(license_digests(licenses))
    raw = F.coalesce(F.col(text), F.lit(""))
    whole = F.struct(F.lit(True).alias("whole"), F.md5(canonical(raw)).alias("digest"))
    lines = F.split(raw, "\n", -1)
    lines = F.transform(F.filter(lines, lambda x: x.rlike(cue)) if cue else lines, lambda x: F.struct(F.lit(False).alias("whole"), F.md5(canonical(x)).alias("digest")))
    # The row number is taken below the explode, not beside it.
    numbered = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), F.concat(F.array(whole), lines).alias("u")
    )
    units = numbered.select("row", "id", F.explode_outer("u").alias("u")).select("row", "id", "u.*")
    notice = F.when(~F.col("whole"), F.col("license"))
    return (
        units.join(known, "digest", "left")
        .filter("whole or license is not null")
        .groupBy("row", "id")
        .agg(
            F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"),
            F.max(F.when(F.col("whole"), F.col("license"))).alias("license"),
            F.count(notice).alias("n_notices"),
            F.array_join(F.sort_array(F.collect_set(notice)), ",").alias("notices"),
        )
        .select(F.col("id").alias(doc_id), "digest", "license", "n_notices", "notices")
    )
