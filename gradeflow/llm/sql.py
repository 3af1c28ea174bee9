"""DuckDB SQL of the corpus queries, written the direct way."""

from __future__ import annotations

from gradeflow.llm import licenses

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    form = f"regexp_replace({_lower(text)}, {_quoted(licenses.COPYRIGHT_LINE)}, '', 'g')"
    form = f"trim(regexp_replace({form}, {_quoted(licenses.SIGNS)}, ' ', 'g'))"
    for spelling, one in licenses.SPELLINGS:
        form = f"regexp_replace({form}, {_quoted(spelling)}, {_quoted(one.replace('$1', chr(92) + '1'))}, 'g')"
    return f"trim({form})"


_KNOWN = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in licenses.known_texts())

LICENSE_SCAN = f"""
WITH known AS (
  SELECT md5({_canonical('text')}) AS digest, min(license) AS license
  FROM (VALUES {_KNOWN}) v(license, text) GROUP BY 1
), whole AS (
  SELECT doc_id, md5({_canonical("coalesce(text, '')")}) AS digest FROM documents
), line AS (
  SELECT doc_id, md5({_canonical('x')}) AS digest
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)
), notice AS (
  SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM line JOIN known USING (digest) GROUP BY doc_id
)
SELECT w.doc_id, w.digest, k.license, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN notice n ON w.doc_id = n.doc_id
"""

_TOKEN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATION = f"""
WITH item AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all({_lower('text')}, {_TOKEN}) AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item, least(len(w), 10) AS length,
    array_to_string(list_slice(w, i + 1, i + 10), ' ') AS gram
  FROM (SELECT item, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, {_TOKEN}) AS w FROM documents
), spot AS (
  SELECT doc_id, w, length, unnest(range(len(w) - length + 1)) AS i
  FROM doc, (SELECT DISTINCT length FROM grams) WHERE len(w) >= length
), hit AS (
  SELECT doc_id, i, g.length, item
  FROM (SELECT doc_id, i, length, array_to_string(list_slice(w, i + 1, i + length), ' ') AS gram FROM spot) s
  JOIN grams g USING (length, gram)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + length)) AS p FROM (SELECT DISTINCT doc_id, i, length FROM hit))
  GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
  FROM hit GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_WORD = r"'[^\x20\x09-\x0D]+'"

NEAR_DUPLICATES = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, {_WORD}) AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 3), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, 1))) AS i FROM doc WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), link AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
  ) JOIN size p ON a = p.doc_id JOIN size q ON b = q.doc_id
  WHERE 100 * common >= 85 * (p.n + q.n - common)
), reach AS (
  SELECT doc_id, doc_id AS other FROM doc
  UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON r.other = l.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM doc d LEFT JOIN size USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON d.doc_id = c.doc_id
"""

_NORMAL = (
    f"trim(regexp_replace(regexp_replace({_lower('x')}, '[0-9]+', '0', 'g'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"
)

LINE_QUALITY = f"""
WITH doc AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'row ' || row_number() OVER ()) AS document, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), {_WORD}) AS w
  FROM documents
), line AS (
  SELECT doc_id, document, source, x, {_NORMAL} AS line, len(regexp_extract_all(x, {_WORD})) AS words
  FROM (SELECT doc_id, document, source, unnest(string_split(text, chr(10))) AS x FROM doc)
  WHERE regexp_matches(x, {_WORD})
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM line GROUP BY doc_id
), frequent AS (
  SELECT source, line FROM line WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT document) > 30
), lost AS (
  SELECT doc_id, count(*) AS n_frequent_lines, sum(words)::BIGINT AS n_lost_words
  FROM line l JOIN frequent f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source GROUP BY doc_id
), spot AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 3), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM doc WHERE len(w) > 2)
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM spot) WHERE n > 1
  ) GROUP BY doc_id
), measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_frequent_lines, 0) AS n_frequent_lines, coalesce(n_lost_words, 0) AS n_lost_words
  FROM doc LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN lost USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT *, NOT base_failed AND NOT 100 * n_lost_words > 70 * n_words AS kept FROM judged
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_QUAD = " || ".join(
    f"substr('{_BASE32}', ((('0x' || substr(hex, {5 * j + 1}, 5))::BIGINT >> {shift}) & 31)::INT + 1, 1)"
    for j in range(8)
    for shift in (15, 10, 5, 0)
)

ARC_TO_WARC = f"""
WITH page AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), winner AS (
  SELECT hex, max(page_id) AS page_id FROM page GROUP BY hex
)
SELECT p.page_id, payload_bytes::BIGINT AS payload_bytes, {_QUAD} AS payload_digest,
  CASE WHEN p.page_id = w.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> w.page_id THEN w.page_id END AS refers_to
FROM page p JOIN winner w USING (hex)
"""

_RUN = "'[a-zÀ-ÿ]{7,}'"

#: CRC-32 byte by byte, from a table of 256 remainders.
SPELLING_VARIANTS = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, bit:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS remainders
), run AS (
  SELECT doc_id, unnest(regexp_extract_all({_lower("coalesce(text, '')")}, {_RUN})) AS run FROM documents
), hashed AS (
  SELECT run, xor(4294967295, list_reduce(
    list_transform(range(strlen(key)), lambda b: ('0x' || substr(hex(key), 2 * b + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, remainders[(xor(c, b) & 255) + 1]), 4294967295)) AS h
  FROM (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM run), crc
), damaged AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed
), counted AS (
  SELECT word, count(*) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), cut AS (
  SELECT word, n, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM counted)
), near AS (
  SELECT x.word, y.word AS other, y.n AS other_n
  FROM cut x JOIN cut y ON x.i = y.i AND x.head = y.head AND x.tail = y.tail AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN counted y ON x.head || x.tail = y.word
  UNION SELECT y.word, x.word, x.n FROM cut x JOIN counted y ON x.head || x.tail = y.word
), best AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place
  FROM near
), formed AS (
  SELECT c.word, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM counted c LEFT JOIN best b ON c.word = b.word AND place = 1
), chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON f.word = c.word JOIN formed r ON c.root = r.word WHERE r.form IS NULL
"""


def _round(number: int) -> str:
    return f"""
), assigned{number} AS (
  SELECT row, vec_id, c, k, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY row ORDER BY distance, k) AS place FROM (
      SELECT row, vec_id, c, k, list_inner_product(c, c) + list_inner_product(m, m) - 2 * list_inner_product(c, m) AS distance
      FROM kept, centroid{number}
    )
  ) WHERE place = 1"""


def _moved(number: int) -> str:
    return f"""
), total{number} AS (
  SELECT k, j, sum(c[j]::BIGINT) AS s, count(*) AS n
  FROM (SELECT k, c, unnest(range(1, 65)) AS j FROM assigned{number}) GROUP BY k, j
), centroid{number + 1} AS (
  SELECT o.k, coalesce(t.m, o.m) AS m FROM centroid{number} o LEFT JOIN (
    SELECT k, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY j) AS m FROM total{number} GROUP BY k
  ) t ON o.k = t.k"""


BIT_PLANE_CLUSTERS = f"""
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS c
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x::DOUBLE))) = 64
), centroid0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, c AS m
  FROM (SELECT sha256('1:' || vec_id) AS h, c FROM kept ORDER BY h LIMIT 16){"".join(_round(r) + _moved(r) for r in range(3))}{_round(3)}
), digest AS (
  SELECT k, sha256(array_to_string(list_transform(m, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256 FROM centroid3
)
SELECT vec_id, a.k::INT AS cluster, distance::BIGINT AS distance,
  (sum(distance) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  centroid_sha256
FROM assigned3 a JOIN digest d ON a.k = d.k
"""

ORACLES = {
    "op1_license_scan": LICENSE_SCAN,
    "op2_decontamination": DECONTAMINATION,
    "op3_minhash_dedup": NEAR_DUPLICATES,
    "op6_arc_to_warc": ARC_TO_WARC,
    "op10_line_quality": LINE_QUALITY,
    "op12_spelling_variants": SPELLING_VARIANTS,
    "op13_bit_plane_clusters": BIT_PLANE_CLUSTERS,
}
