"""DuckDB SQL for the same results, written the direct way.

Where the Spark side keeps sums per fold, buckets an order or pre-aggregates candidates, the SQL
here joins every fold with all other rows, sorts globally, or lists all candidates.
"""

from __future__ import annotations

TOKEN = r"<title>|<text>|<question>|<summary>|<reference>|[\p{L}\p{N}]+"
PLAIN = r"[\p{L}\p{N}]+"
GAP = r"[^\p{L}\p{N}]*[\p{L}\p{N}]+"
SENTENCE = r"[^.!?\n]+[.!?]*"

CTES = {
    "prompts": r"""
        SELECT concat('src', CAST(item_id AS VARCHAR)) AS prompt_id,
               regexp_extract(text, '^\S+(?:\s+\S+){0,2}') AS prompt_title,
               regexp_extract(text, '^[^.!?\n]+[.!?]*') AS prompt_question,
               text AS prompt_text
        FROM benchmark""",
    "train_responses": """
        SELECT CAST(d.doc_id AS VARCHAR) AS student_id, d.source AS prompt_id, d.text,
               CAST(l.quality AS DOUBLE) AS content, CAST(l.toxic AS DOUBLE) AS wording
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "test_responses": """
        SELECT CAST(doc_id AS VARCHAR) AS student_id, source AS prompt_id, text
        FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "all_responses": """
        SELECT CAST(doc_id AS VARCHAR) AS student_id, source AS prompt_id, text FROM documents""",
    "train": """
        SELECT student_id, prompt_id, prompt_title, prompt_question, prompt_text, text,
               '' AS reference_summary, content, wording
        FROM train_responses JOIN prompts USING (prompt_id)""",
    "test": """
        SELECT student_id, prompt_id, prompt_title, prompt_question, prompt_text, text,
               '' AS reference_summary
        FROM test_responses JOIN prompts USING (prompt_id)""",
    "everything": """
        SELECT student_id, prompt_id, prompt_title, prompt_question, prompt_text, text,
               '' AS reference_summary
        FROM all_responses JOIN prompts USING (prompt_id)""",
    "train_x": f"""
        SELECT *, ln(1 + length(input_text)) AS log_chars,
               ln(1 + len(regexp_extract_all(lower(input_text), '{TOKEN}'))) AS log_tokens
        FROM (SELECT *, '<summary> ' || text || ' <question> ' || prompt_question AS input_text
              FROM train)""",
    "test_x": """
        SELECT *, ln(1 + length('<summary> ' || text || ' <question> ' || prompt_question)) AS log_chars
        FROM test""",
    "folds": "SELECT DISTINCT prompt_id AS fold FROM train",
    "lines": """
        SELECT f.fold, count(*) AS n,
               regr_slope(content, log_chars) AS slope_content,
               regr_intercept(content, log_chars) AS intercept_content,
               regr_slope(wording, log_chars) AS slope_wording,
               regr_intercept(wording, log_chars) AS intercept_wording
        FROM folds f JOIN train_x t ON t.prompt_id <> f.fold GROUP BY f.fold""",
    "line_oof": """
        SELECT t.student_id, t.prompt_id, t.content, t.wording,
               intercept_content + slope_content * log_chars AS predicted_content,
               intercept_wording + slope_wording * log_chars AS predicted_wording
        FROM train_x t JOIN lines m ON m.fold = t.prompt_id""",
    "mean_oof": """
        SELECT t.student_id, t.prompt_id, t.content, t.wording, m.predicted_content,
               m.predicted_wording
        FROM train t JOIN (
            SELECT f.fold, avg(content) AS predicted_content, avg(wording) AS predicted_wording
            FROM folds f JOIN train o ON o.prompt_id <> f.fold GROUP BY f.fold) m
        ON m.fold = t.prompt_id""",
    "each_model": """
        SELECT student_id, fold, intercept_content + slope_content * log_chars AS content,
               intercept_wording + slope_wording * log_chars AS wording
        FROM test_x CROSS JOIN lines""",
    "logs": """
        SELECT CAST(floor((step - 1) / 100) + 1 AS BIGINT) AS epoch, step, val, n FROM (
            SELECT CAST(floor(event_id / 32) + 1 AS BIGINT) AS step, avg(value) AS val,
                   count(*) AS n
            FROM events GROUP BY 1)""",
    "corpus": f"""
        SELECT student_id, regexp_extract_all(
                   lower('<summary> ' || text || ' <question> ' || prompt_question), '{TOKEN}') AS tokens
        FROM everything""",
    "vocab": """
        SELECT token, 8 + row_number() OVER (ORDER BY n DESC, token) AS id, n FROM (
            SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM corpus)
            WHERE token NOT IN ('<title>', '<text>', '<question>', '<summary>', '<reference>')
            GROUP BY token ORDER BY n DESC, token LIMIT 5000)""",
    "token_ids": """
        SELECT student_id, pos, coalesce(CASE token WHEN '<title>' THEN 4 WHEN '<text>' THEN 5
                   WHEN '<question>' THEN 6 WHEN '<summary>' THEN 7 WHEN '<reference>' THEN 8 END,
                   id, 1) AS id
        FROM (SELECT student_id, unnest(tokens[1:510]) AS token,
                     generate_subscripts(tokens[1:510], 1) AS pos FROM corpus) t
        LEFT JOIN vocab USING (token)""",
    "encoded": """
        SELECT c.student_id, list_concat([2], coalesce(b.body, []), [3]) AS ids
        FROM corpus c LEFT JOIN (
            SELECT student_id, list(CAST(id AS INTEGER) ORDER BY pos) AS body FROM token_ids GROUP BY 1) b
        ON b.student_id = c.student_id""",
    "batched": """
        SELECT student_id, (row_number() OVER (ORDER BY md5('666:1:' || student_id), student_id) - 1)
               AS position
        FROM all_responses""",
    "counts": r"""
        SELECT word, count(*) AS n FROM (
            SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM all_responses)
        GROUP BY word""",
    "positions": """
        SELECT word, n, unnest(range(1, CAST(length(word) + 1 AS BIGINT))) AS i FROM counts""",
    "cuts": """
        SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM positions""",
    "swaps": """
        SELECT word, n, substr(word, 1, i - 1) || substr(word, i + 1, 1) || substr(word, i, 1)
               || substr(word, i + 2) AS swapped
        FROM positions
        WHERE i < length(word) AND substr(word, i, 1) <> substr(word, i + 1, 1)""",
    "candidates": """
        SELECT u.word, d.word AS fix, d.n FROM cuts u JOIN cuts d ON u.i = d.i AND u.rest = d.rest
        WHERE u.n < 5 AND d.n >= 5
        UNION SELECT u.word, d.word, d.n FROM cuts u JOIN counts d ON u.rest = d.word
        WHERE u.n < 5 AND d.n >= 5
        UNION SELECT u.word, d.word, d.n FROM counts u JOIN cuts d ON u.word = d.rest
        WHERE u.n < 5 AND d.n >= 5
        UNION SELECT u.word, d.word, d.n FROM swaps u JOIN counts d ON u.swapped = d.word
        WHERE u.n < 5 AND d.n >= 5""",
    "fixes": """
        SELECT word, fix, n AS fix_n FROM (
            SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, fix) AS r FROM candidates)
        WHERE r = 1""",
    "runs": r"""
        SELECT student_id, unnest(regexp_extract_all(text, '\p{L}+|[^\p{L}]+')) AS run,
               generate_subscripts(regexp_extract_all(text, '\p{L}+|[^\p{L}]+'), 1) AS pos
        FROM all_responses""",
    "vectors": """
        SELECT CAST(label AS VARCHAR) AS "group", vec_id AS pos,
               CASE WHEN vec_id % 5 <> 0 THEN 1 ELSE 0 END AS mask, embedding
        FROM embeddings""",
    "cells": """
        SELECT "group", pos, mask, CAST(unnest(embedding) AS DOUBLE) AS v,
               generate_subscripts(embedding, 1) - 1 AS dim
        FROM vectors""",
}

DEPENDS = {
    "train": ["train_responses", "prompts"],
    "test": ["test_responses", "prompts"],
    "everything": ["all_responses", "prompts"],
    "train_x": ["train"],
    "test_x": ["test"],
    "folds": ["train"],
    "lines": ["folds", "train_x"],
    "line_oof": ["train_x", "lines"],
    "mean_oof": ["folds", "train"],
    "each_model": ["test_x", "lines"],
    "corpus": ["everything"],
    "vocab": ["corpus"],
    "token_ids": ["corpus", "vocab"],
    "encoded": ["corpus", "token_ids"],
    "batched": ["all_responses"],
    "counts": ["all_responses"],
    "positions": ["counts"],
    "cuts": ["positions"],
    "swaps": ["positions"],
    "candidates": ["counts", "cuts", "swaps"],
    "fixes": ["candidates"],
    "runs": ["all_responses"],
    "cells": ["vectors"],
}


def with_(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` preceded by the named CTEs and all they build on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in DEPENDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"


# ``+ 1e-10`` below shifts means of two-decimal values off exact rounding ties, as on the Spark side.
def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def _summary_ctes(source: str, key: str, col: str, low: int, high: int) -> str:
    """CTEs that end in ``summaries(key, summary)`` for the texts of ``source``."""
    return f"""
    sized AS MATERIALIZED (SELECT {key}, {col} AS body, len(regexp_extract_all({col}, '{PLAIN}')) AS size
              FROM {source}),
    sentences AS MATERIALIZED (
        SELECT {key}, unnest(regexp_extract_all(body, '{SENTENCE}')) AS sentence,
               generate_subscripts(regexp_extract_all(body, '{SENTENCE}'), 1) AS pos
        FROM sized WHERE size >= {high}),
    toks AS MATERIALIZED (
        SELECT {key}, pos, unnest(regexp_extract_all(lower(sentence), '{PLAIN}')) AS token
        FROM sentences),
    freq AS (SELECT {key}, token, count(*) AS f FROM toks GROUP BY 1, 2),
    ranked AS (
        SELECT {key}, pos, count(*) AS n, sum(f) / count(*) AS score
        FROM toks JOIN freq USING ({key}, token) GROUP BY 1, 2),
    cumulated AS (
        SELECT *, sum(n) OVER (PARTITION BY {key} ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING) AS up_to
        FROM ranked),
    chosen AS (
        SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY {key} ORDER BY pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
        FROM cumulated WHERE up_to <= {high} OR up_to - n < {low}),
    summaries AS (
        SELECT {key}, string_agg(trim(CASE WHEN before + n <= {high} THEN sentence
                   ELSE array_to_string(list_slice(regexp_extract_all(sentence, '{GAP}'), 1, {high} - before), '')
                   END), ' ' ORDER BY pos) AS summary
        FROM chosen JOIN sentences USING ({key}, pos) WHERE before < {high} GROUP BY 1
        UNION ALL SELECT {key}, body FROM sized WHERE size < {high})"""


def _pooled(value: str, digits: int = 6) -> str:
    return with_(
        f"""SELECT "group", dim, {r(value, "value", digits)} FROM cells GROUP BY 1, 2""", "cells"
    )


def _pairs(source: str, columns: str) -> str:
    """CTE body that pairs each row with the next in hash order, around the end."""
    nexts = ", ".join(
        f"coalesce(lead({c}) OVER w, first_value({c}) OVER w) AS second_{c}" for c in columns.split()
    )
    firsts = ", ".join(f"{c} AS first_{c}" for c in columns.split())
    return f"""SELECT {firsts}, {nexts} FROM {source}
               WINDOW w AS (ORDER BY md5('666:' || student_id), student_id)"""


def _label(t: str) -> str:
    return f"CAST(sign(first_{t} - second_{t}) AS BIGINT) AS label_{t}"


SCORES = (
    "sqrt(avg((content - predicted_content) ** 2)) AS c, "
    "sqrt(avg((wording - predicted_wording) ** 2)) AS w"
)
THREE = ", ".join([r("(c + w) / 2", "MCRMSE"), r("c", "ContentRMSE"), r("w", "WordingRMSE")])


def _report(source: str) -> str:
    return with_(_report_body(source), source)


def _report_body(source: str) -> str:
    return f""", per_fold AS (SELECT prompt_id AS fold, count(*) AS n_rows, {SCORES} FROM {source} GROUP BY 1),
        levels AS (
            SELECT 'fold' AS level, fold, n_rows, (c + w) / 2 AS m, c, w FROM per_fold
            UNION ALL SELECT 'cv', NULL, CAST(sum(n_rows) AS BIGINT), avg((c + w) / 2), avg(c), avg(w) FROM per_fold
            UNION ALL SELECT 'oof', NULL, n, (c + w) / 2, c, w
            FROM (SELECT count(*) AS n, {SCORES} FROM {source}))
        SELECT level, fold, n_rows, {r("m", "MCRMSE")}, {r("c", "ContentRMSE")}, {r("w", "WordingRMSE")}
        FROM levels"""


def _ridge(rows: str, lam: float = 1.0, columns: str | None = None) -> str:
    """Closed-form ridge with two features over ``rows(fold, x1, x2, content, wording)``."""
    per_target = " UNION ALL ".join(
        f"""SELECT fold, '{t}' AS target, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg({t}) AS my,
            var_pop(x1) * count(*) + {lam} AS a, covar_pop(x1, x2) * count(*) AS b,
            var_pop(x2) * count(*) + {lam} AS d, covar_pop(x1, {t}) * count(*) AS e,
            covar_pop(x2, {t}) * count(*) AS f
        FROM rows_ GROUP BY fold"""
        for t in ("content", "wording")
    )
    return f""", rows_ AS MATERIALIZED ({rows}),
    sums AS ({per_target}),
    solved AS (SELECT *, (e * d - b * f) / (a * d - b * b) AS w1, (a * f - b * e) / (a * d - b * b) AS w2
               FROM sums)
    SELECT {columns or RIDGE_COLUMNS} FROM solved"""


def _reweighted(target: str, steps: int, threshold: float) -> tuple[str, str]:
    """CTEs that refine a line by weights min(1, threshold / error), and the last CTE's name."""
    ctes, line = [], None
    for step in range(steps):
        error = f"abs({target} - (SELECT a FROM {line}) - (SELECT b FROM {line}) * log_chars)" if line else "0"
        rows, line = f"rows_{target}_{step}", f"line_{target}_{step}"
        previous = f"CASE WHEN {error} > {threshold} THEN {threshold} / {error} ELSE 1.0 END"
        ctes.append(
            f"""{rows} AS MATERIALIZED (SELECT log_chars AS x, {target} AS y, {previous} AS w FROM train_x WHERE prompt_id <> 'src3'),
            mean_{rows} AS MATERIALIZED (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM {rows}),
            {line} AS MATERIALIZED (
                SELECT sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS b,
                       any_value(my) - b * any_value(mx) AS a, count(*) AS n
                FROM {rows}, mean_{rows})"""
        )
    return ", ".join(ctes), line


def _huber_steps(steps: int = 3, threshold: float = 0.4) -> str:
    parts = {t: _reweighted(t, steps, threshold) for t in ("content", "wording")}
    lines = " UNION ALL ".join(
        f"SELECT 'src3' AS fold, '{t}' AS target, n, {r('a', 'intercept')}, {r('b', 'slope')} FROM {line}"
        for t, (_, line) in parts.items()
    )
    return f", {', '.join(ctes for ctes, _ in parts.values())} {lines}"


def _rank_pairs(lam: float = 1.0) -> str:
    """Squared pairwise loss over every pair of rows of one prompt, in closed form for two features."""
    per_target = " UNION ALL ".join(
        f"""SELECT fold, '{t}' AS target, count(*) AS n, sum(x1 * x1) + {lam} AS a, sum(x1 * x2) AS b,
            sum(x2 * x2) + {lam} AS d, sum(x1 * {t}) AS e, sum(x2 * {t}) AS f FROM fitted GROUP BY fold"""
        for t in ("content", "wording")
    )
    return f""", pairs AS MATERIALIZED (
        SELECT s.prompt_id, s.log_chars - o.log_chars AS x1, s.log_tokens - o.log_tokens AS x2,
               s.content - o.content AS content, s.wording - o.wording AS wording
        FROM train_x s JOIN train_x o ON s.prompt_id = o.prompt_id AND s.student_id < o.student_id),
    fitted AS (
        SELECT fold, pairs.* FROM folds JOIN pairs ON prompt_id <> fold
        UNION ALL SELECT 'all', * FROM pairs),
    sums AS ({per_target})
    SELECT fold, target, n, {r("(e * d - b * f) / (a * d - b * b)", "w_chars")},
           {r("(a * f - b * e) / (a * d - b * b)", "w_tokens")} FROM sums"""


def _word_ridge(size: int, lam: str, value: str, steps: int, scaled: bool) -> str:
    """CTEs up to word_oof: held-out predictions of ridge models on word counts, by conjugate gradients.

    Each step joins every model with all words of its rows.  ``lam`` may use a model's number ``n`` of
    rows, ``value`` the number ``n`` of times a word is seen; ``scaled`` divides residuals by the diagonal.
    """
    by = "/ d" if scaled else ""
    diagonal = (
        f"""SELECT fold, id, coalesce(s2, 0) - s1 * s1 / n + {lam} AS d FROM (
            SELECT fold, id, n, s1, (SELECT sum(v * v) FROM x WHERE x.id = c.id AND x.prompt_id <> c.fold) AS s2
            FROM centre c)"""
        if scaled
        else "SELECT fold, id, 1.0 AS d FROM centre"
    )
    return f""", word_counts AS MATERIALIZED (
        SELECT student_id, token, count(*) AS n
        FROM (SELECT student_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS token FROM train)
        WHERE token NOT IN ('<title>', '<text>', '<question>', '<summary>', '<reference>') GROUP BY 1, 2),
    words AS MATERIALIZED (
        SELECT token, row_number() OVER (ORDER BY sum(n) DESC, token) AS id
        FROM word_counts GROUP BY token ORDER BY sum(n) DESC, token LIMIT {size}),
    labelled AS MATERIALIZED (SELECT student_id, prompt_id, content, wording FROM train),
    x AS MATERIALIZED (
        SELECT student_id, prompt_id, id, CAST({value} AS DOUBLE) AS v
        FROM word_counts JOIN words USING (token) JOIN labelled USING (student_id)),
    y AS MATERIALIZED (
        SELECT student_id, prompt_id, 'content' AS target, content AS y FROM labelled
        UNION ALL SELECT student_id, prompt_id, 'wording', wording FROM labelled),
    mean_y AS MATERIALIZED (
        SELECT fold, target, count(*) AS n, avg(y) AS my FROM folds JOIN y ON prompt_id <> fold GROUP BY 1, 2),
    centre AS MATERIALIZED (
        SELECT f.fold, w.id, f.n, coalesce(s.s1, 0) AS s1 FROM (SELECT DISTINCT fold, n FROM mean_y) f
        CROSS JOIN words w
        LEFT JOIN (SELECT fold, id, sum(v) AS s1 FROM folds JOIN x ON prompt_id <> fold GROUP BY 1, 2) s
        ON s.fold = f.fold AND s.id = w.id),
    diagonal AS MATERIALIZED ({diagonal}),
    start AS MATERIALIZED (
        SELECT c.fold, m.target, c.id, c.n, c.s1, d.d, coalesce(xy, 0) - s1 * my AS b
        FROM centre c JOIN mean_y m USING (fold) JOIN diagonal d USING (fold, id)
        LEFT JOIN (SELECT fold, target, id, sum(v * y) AS xy FROM folds JOIN x ON x.prompt_id <> fold
                   JOIN y USING (student_id) GROUP BY 1, 2, 3) p USING (fold, target, id)),
    steps AS (
        SELECT 0 AS step, fold, target, id, n, s1, d, CAST(0 AS DOUBLE) AS w, b AS r, b {by} AS p FROM start
        UNION ALL
        SELECT step + 1, fold, target, id, n, s1, d, w, r, r {by} + lower_ / nullif(height, 0) * p FROM (
            SELECT *, sum(r * r {by}) OVER (PARTITION BY fold, target) AS lower_ FROM (
                SELECT step, fold, target, id, n, s1, d, p, height, w + a * p AS w, r - a * q AS r FROM (
                    SELECT *, coalesce(height / nullif(sum(p * q) OVER (PARTITION BY fold, target), 0), 0) AS a FROM (
                        SELECT s.*, sum(r * r {by}) OVER (PARTITION BY fold, target) AS height,
                               coalesce(xxp, 0) - s1 / n * sum(s1 * p) OVER (PARTITION BY fold, target) + {lam} * p AS q
                        FROM steps s LEFT JOIN (
                            SELECT fold, target, x.id, sum(x.v * xp) AS xxp
                            FROM (SELECT fold, target, student_id, sum(v * p) AS xp
                                  FROM steps JOIN x USING (id) WHERE prompt_id <> fold GROUP BY 1, 2, 3)
                            JOIN x USING (student_id) GROUP BY 1, 2, 3) USING (fold, target, id)))))
        WHERE step < {steps}),
    weights AS MATERIALIZED (SELECT * FROM steps WHERE step = {steps}),
    offsets AS (
        SELECT fold, target, my - m AS intercept FROM mean_y
        JOIN (SELECT fold, target, sum(w * s1 / n) AS m FROM weights GROUP BY 1, 2) USING (fold, target)),
    scored AS MATERIALIZED (
        SELECT l.student_id, o.target, o.intercept + coalesce(s.xw, 0) AS p
        FROM labelled l JOIN offsets o ON o.fold = l.prompt_id
        LEFT JOIN (SELECT student_id, target, sum(v * w) AS xw FROM x JOIN weights k
                   ON k.id = x.id AND k.fold = x.prompt_id GROUP BY 1, 2) s
        ON s.student_id = l.student_id AND s.target = o.target),
    word_oof AS MATERIALIZED (
        SELECT l.*, c.p AS predicted_content, w.p AS predicted_wording FROM labelled l
        JOIN scored c ON c.student_id = l.student_id AND c.target = 'content'
        JOIN scored w ON w.student_id = l.student_id AND w.target = 'wording')"""


RIDGE_COLUMNS = ", ".join(
    ["fold, target, n", r("my - w1 * m1 - w2 * m2", "intercept"), r("w1", "w_chars"), r("w2", "w_tokens")]
)


def _loss(body: str) -> str:
    return with_(f"SELECT {body} FROM line_oof", "line_oof")


C, W = "(predicted_content - content)", "(predicted_wording - wording)"


def _smooth(d: str) -> str:
    return f"CASE WHEN abs({d}) < 0.4 THEN 0.5 * {d} * {d} / 0.4 ELSE abs({d}) - 0.2 END"


def _huber(d: str) -> str:
    return f"CASE WHEN abs({d}) <= 0.4 THEN 0.5 * {d} * {d} ELSE 0.4 * (abs({d}) - 0.2) END"


def _tied(t: str) -> str:
    gap = f"(first_predicted_{t} - second_predicted_{t})"
    label = f"sign(first_{t} - second_{t})"
    return f"CASE WHEN {label} = 0 THEN abs({gap}) ELSE greatest(-{label} * {gap} + 0.5, 0) END"


def _line_rows(source: str, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT fold, '{t}' AS target, n, {r(f"intercept_{t}", "intercept")},
            {r(f"slope_{t}", "slope")} FROM {source}"""
        for t in ("content", "wording")
    )


INTERVAL = "PARTITION BY epoch, floor((step - 1) / 10) ORDER BY step ROWS UNBOUNDED PRECEDING"
RUNNING = f"SELECT epoch, step, sum(val * n) OVER ({INTERVAL}) / sum(n) OVER ({INTERVAL}) AS running FROM logs"
PADDED_IDS = "array_to_string(list_concat(ids, list_transform(range(len(ids), {to}), lambda x: 0)), ',')"
MASK = (
    "array_to_string(list_concat(list_transform(ids, lambda x: 1), "
    "list_transform(range(len(ids), {to}), lambda x: 0)), ',')"
)

ORACLES: dict[str, str] = {
    "scan_prompts": with_("SELECT * FROM prompts", "prompts"),
    "scan_responses": with_("SELECT * FROM train_responses", "train_responses"),
    "scan_predictions": with_(
        f"""SELECT student_id, prompt_id, content, wording, {r("predicted_content", "predicted_content")},
            {r("predicted_wording", "predicted_wording")} FROM line_oof""",
        "line_oof",
    ),
    "saved_models": with_(
        f"SELECT fold, target, intercept, slope FROM ({_line_rows('lines')})", "lines"
    ),
    "metric_log": with_(
        f"""SELECT 'events' AS run_id, epoch, epoch * 100 AS step, 'value' AS metric,
            {r("sum(val * n) / sum(n) + 1e-10", "value", 8)} FROM logs GROUP BY epoch""",
        "logs",
    ),
    "assemble_train": with_("SELECT * FROM train", "train"),
    "assemble_test": with_("SELECT * FROM test", "test"),
    "compose_prompt": with_(
        """SELECT student_id, '<question> ' || prompt_question || ' <summary> ' || text || ' <title> '
           || prompt_title AS input_text FROM everything""",
        "everything",
    ),
    "select_targets": with_(
        """SELECT student_id, content AS first, wording AS second, wording AS single,
           CAST(2 AS BIGINT) AS n_labels, CAST(1 AS BIGINT) AS n_single FROM train""",
        "train",
    ),
    "fold_split": with_(
        """SELECT student_id, prompt_id, CASE WHEN prompt_id = 'src3' THEN 'valid' ELSE 'train' END AS role
           FROM train""",
        "train",
    ),
    "fold_frames": with_(
        """SELECT fold, CASE WHEN prompt_id = fold THEN 'valid' ELSE 'train' END AS role, count(*) AS n_rows
           FROM folds CROSS JOIN train GROUP BY 1, 2""",
        "folds",
    ),
    "folds": with_("SELECT fold FROM folds", "folds"),
    "union_folds": with_(
        f"""SELECT student_id, prompt_id, {r("predicted_content", "predicted_content")},
            {r("predicted_wording", "predicted_wording")} FROM line_oof""",
        "line_oof",
    ),
    "pair_rows": with_(
        f""", paired AS ({_pairs("train", "student_id content wording")})
        SELECT *, {_label("content")}, {_label("wording")} FROM paired""",
        "train",
    ),
    "rmse_single": with_(
        f"SELECT {r('sqrt(avg((wording - predicted_wording) ** 2))', 'RMSE')} FROM mean_oof", "mean_oof"
    ),
    "mcrmse": with_(f"SELECT {THREE} FROM (SELECT {SCORES} FROM mean_oof)", "mean_oof"),
    "fold_scores": with_(
        f"""SELECT fold, n_rows, {THREE}
        FROM (SELECT prompt_id AS fold, count(*) AS n_rows, {SCORES} FROM mean_oof GROUP BY 1)""",
        "mean_oof",
    ),
    "cv_macro": with_(
        f"""SELECT count(*) AS n_folds, {r("avg((c + w) / 2)", "MCRMSE")}, {r("avg(c)", "ContentRMSE")},
            {r("avg(w)", "WordingRMSE")}
        FROM (SELECT prompt_id, {SCORES} FROM mean_oof GROUP BY 1)""",
        "mean_oof",
    ),
    "oof_pooled": with_(
        f"SELECT n_rows, {THREE} FROM (SELECT count(*) AS n_rows, {SCORES} FROM mean_oof)", "mean_oof"
    ),
    "score_report": _report("line_oof"),
    "score_report_rows": _report("line_oof"),
    "mean_baseline_report": _report("mean_oof"),
    "eval_holdout": with_(
        f"""SELECT {r("(c + w) / 2", "eval_MCRMSE")}, {r("c", "eval_ContentRMSE")},
            {r("w", "eval_WordingRMSE")}
        FROM (SELECT {SCORES} FROM line_oof WHERE prompt_id = 'src3')""",
        "line_oof",
    ),
    "loss_mse": _loss(r(f"avg(({C} ** 2 + {W} ** 2) / 2)", "MSE")),
    "loss_rmse_eps": _loss(r(f"sqrt(avg(({C} ** 2 + {W} ** 2) / 2) + 1e-6)", "RMSE")),
    "loss_mcrmse": with_(
        f"""SELECT {r("(c + w) / 2", "MCRMSE")}, {r("c", "C")}, {r("w", "W")}
        FROM (SELECT sqrt(avg({C} ** 2) + 1e-6) AS c, sqrt(avg({W} ** 2) + 1e-6) AS w FROM line_oof)""",
        "line_oof",
    ),
    "loss_smoothl1": _loss(r(f"avg(({_smooth(C)} + {_smooth(W)}) / 2)", "SmoothL1")),
    "loss_huber": _loss(r(f"avg(({_huber(C)} + {_huber(W)}) / 2)", "Huber")),
    "loss_ranking": with_(
        f""", paired AS ({_pairs("line_oof", "student_id content wording predicted_content predicted_wording")})
        SELECT {r(f"avg(({_tied('content')} + {_tied('wording')}) / 2)", "Ranking")} FROM paired""",
        "line_oof",
    ),
    "batch_weighted_mean": with_(
        f"""SELECT 'events' AS run_id, epoch, {r("sum(val * n) / sum(n) + 1e-10", "avg", 8)},
            CAST(sum(n) AS BIGINT) AS n FROM logs GROUP BY epoch""",
        "logs",
    ),
    "running_meter": with_(
        f"SELECT epoch, step, {r('running + 1e-10', 'running', 8)} FROM ({RUNNING})", "logs"
    ),
    "running_meter_epoch": with_(
        f"""SELECT epoch, step, {r("sum(val * n) OVER w / sum(n) OVER w + 1e-10", "running", 8)} FROM logs
        WINDOW w AS (PARTITION BY epoch ORDER BY step ROWS UNBOUNDED PRECEDING)""",
        "logs",
    ),
    "interval_log": with_(
        f"SELECT epoch, step, {r('running + 1e-10', 'running', 8)} FROM ({RUNNING}) WHERE step % 10 = 0", "logs"
    ),
    "assign_batches": with_(
        "SELECT student_id, position, CAST(floor(position / 32) AS BIGINT) AS batch_id FROM batched",
        "batched",
    ),
    "sample_rows": with_(
        "SELECT * FROM all_responses ORDER BY md5('666:' || student_id), student_id LIMIT 50",
        "all_responses",
    ),
    "token_counts": with_(
        """SELECT student_id, CAST(len(tokens) AS BIGINT) AS n_tokens,
           CAST(len(list_distinct(tokens)) AS BIGINT) AS n_distinct FROM corpus""",
        "corpus",
    ),
    "vocab_ranked": with_(
        """SELECT token, 8 + row_number() OVER (ORDER BY n DESC, token) AS id, n
           FROM (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM corpus)
                 WHERE token NOT IN ('<title>', '<text>', '<question>', '<summary>', '<reference>') GROUP BY token)""",
        "corpus",
    ),
    "vocab_topk": with_("SELECT token, id, n FROM vocab", "vocab"),
    "assign_batches_null_keys": with_(
        """SELECT CAST(floor(p / 32) AS BIGINT) AS batch_id, count(*) AS n, min(p) AS first, max(p) AS last
           FROM (SELECT row_number() OVER (ORDER BY student_id) - 1 AS p FROM all_responses) GROUP BY 1""",
        "all_responses",
    ),
    "compose_with_text": with_(
        """SELECT student_id, '<text> ' || prompt_text || ' <summary> ' || text AS input_text
           FROM everything""",
        "everything",
    ),
    "encode_tokens_join": with_(
        """SELECT student_id, array_to_string(ids, ',') AS input_ids,
           array_to_string(list_transform(ids, lambda x: 1), ',') AS attention_mask FROM encoded""",
        "encoded",
    ),
    "encode_tokens": with_(
        """SELECT student_id, array_to_string(ids, ',') AS input_ids,
           array_to_string(list_transform(ids, lambda x: 1), ',') AS attention_mask FROM encoded""",
        "encoded",
    ),
    "pad_static": with_(
        f"""SELECT student_id, {PADDED_IDS.format(to=512)} AS input_ids,
            {MASK.format(to=512)} AS attention_mask FROM encoded""",
        "encoded",
    ),
    "pad_dynamic": with_(
        f"""SELECT student_id, batch_id, padded_length, {PADDED_IDS.format(to="padded_length")} AS input_ids,
            {MASK.format(to="padded_length")} AS attention_mask
        FROM (SELECT student_id, ids, CAST(floor(position / 32) AS BIGINT) AS batch_id,
                     max(len(ids)) OVER (PARTITION BY floor(position / 32)) AS padded_length
              FROM encoded JOIN batched USING (student_id))""",
        "encoded",
        "batched",
    ),
    "vocab_features": with_(
        """SELECT student_id, id, count(*) AS n
        FROM (SELECT student_id, unnest(tokens) AS token FROM corpus) JOIN vocab USING (token)
        GROUP BY 1, 2""",
        "vocab",
    ),
    "spell_dictionary": with_("SELECT word, n FROM counts WHERE n >= 5", "counts"),
    "spell_candidates": with_("SELECT word, fix, fix_n FROM fixes", "fixes"),
    "correct_spelling": with_(
        """SELECT student_id, string_agg(CASE WHEN fix IS NULL THEN run
               WHEN substr(run, 1, 1) <> lower(substr(run, 1, 1)) THEN upper(substr(fix, 1, 1)) || substr(fix, 2)
               ELSE fix END, '' ORDER BY pos) AS text
        FROM runs LEFT JOIN fixes ON lower(run) = word GROUP BY student_id""",
        "runs",
        "fixes",
    ),
    "length_gate": with_(
        f"""SELECT student_id, n_tokens, n_tokens < 128 AS keep_full FROM (
            SELECT student_id, CAST(len(regexp_extract_all(text, '{PLAIN}')) AS BIGINT) AS n_tokens
            FROM all_responses)""",
        "all_responses",
    ),
    "extractive_summary": with_(
        f""", {_summary_ctes("all_responses", "student_id", "text", 56, 128)}
        SELECT student_id, summary FROM summaries""",
        "all_responses",
    ),
    "assemble_summarised": with_(
        f""", {_summary_ctes("prompts", "prompt_id", "prompt_text", 10, 24)}
        SELECT student_id, '<summary> ' || text || ' <reference> ' || summary AS input_text
        FROM all_responses JOIN summaries USING (prompt_id)""",
        "all_responses",
        "prompts",
    ),
    "pool_mean": _pooled("sum(v * mask) / greatest(sum(mask), 1e-9)"),
    "pool_max": _pooled("max(CASE WHEN mask = 1 THEN v ELSE -1e-9 END)"),
    "pool_gem": _pooled(
        "pow(sum(pow(greatest(v, 1e-6) * mask, 3)) / greatest(sum(mask), 1e-6), CAST(1 AS DOUBLE) / 3)"
    ),
    "pool_first": _pooled("arg_min(v, pos)"),
    "attention_pool": with_(
        f""", scores AS (SELECT "group", pos, sum(tanh(v)) AS s FROM cells GROUP BY 1, 2),
        weights AS (
            SELECT "group", pos, exp(s - max(s) OVER g) / sum(exp(s)) OVER g * exp(max(s) OVER g) AS a
            FROM scores WINDOW g AS (PARTITION BY "group"))
        SELECT "group", dim, {r("sum(v * a * mask) / greatest(sum(mask), 1e-9)", "value", 8)}
        FROM cells JOIN weights USING ("group", pos) GROUP BY 1, 2""",
        "cells",
    ),
    "attention_pool_masked": with_(
        f""", shown AS (SELECT "group", pos, dim, v, CASE WHEN "group" = '0' THEN 0 ELSE mask END AS mask FROM cells),
        scores AS (SELECT "group", pos, mask, sum(tanh(v)) AS s FROM shown GROUP BY 1, 2, 3),
        weights AS (
            SELECT "group", pos, CASE WHEN mask = 0 THEN 0.0 ELSE exp(s - max(s) FILTER (mask <> 0) OVER g)
                   / sum(exp(s)) FILTER (mask <> 0) OVER g * exp(max(s) FILTER (mask <> 0) OVER g) END AS a
            FROM scores WINDOW g AS (PARTITION BY "group"))
        SELECT "group", dim, {r("sum(v * a * mask) / greatest(sum(mask), 1e-9)", "value", 8)}
        FROM shown JOIN weights USING ("group", pos) GROUP BY 1, 2""",
        "cells",
    ),
    "linear_head": f"""
        SELECT vec_id, {r("sum(v / (dim + 1)) + 0.5", "predicted_content")},
               {r("sum(CASE WHEN dim % 2 = 0 THEN v ELSE -v END) - 0.25", "predicted_wording")}
        FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v,
                     generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
        GROUP BY vec_id""",
    "logo_ols": with_(_line_rows("lines"), "lines"),
    "logo_mean": with_(
        " UNION ALL ".join(
            f"""SELECT fold, '{t}' AS target, count(*) AS n, {r(f"avg({t})", "intercept")}
            FROM folds f JOIN train t ON t.prompt_id <> f.fold GROUP BY fold"""
            for t in ("content", "wording")
        ),
        "folds",
    ),
    "logo_ridge": with_(
        _ridge(
            """SELECT fold, log_chars AS x1, log_tokens AS x2, content, wording
            FROM folds f JOIN train_x t ON t.prompt_id <> f.fold"""
        ),
        "folds",
        "train_x",
    ),
    "logo_ridge_large_mean": with_(
        _ridge(
            """SELECT fold, log_chars AS x1, log_tokens AS x2, content, wording
            FROM folds f JOIN train_x t ON t.prompt_id <> f.fold""",
            columns=", ".join(["fold, target, n", r("w1", "w_chars"), r("w2", "w_tokens")]),
        ),
        "folds",
        "train_x",
    ),
    "logo_ridge_sparse": with_(
        f"""{_word_ridge(5000, "0.2 * n", "ln(1 + n)", 45, scaled=False)}
        SELECT student_id, prompt_id, {r("predicted_content", "predicted_content")},
            {r("predicted_wording", "predicted_wording")} FROM word_oof""",
        "folds",
        recursive=True,
    ),
    "logo_ridge_words": with_(_word_ridge(32, "1.0", "n", 120, scaled=True) + _report_body("word_oof"), "folds", recursive=True),
    "rank_fit": with_(_rank_pairs(), "folds", "train_x"),
    "fold_huber_steps": with_(_huber_steps(), "train_x"),
    "fold_squared": with_(
        _ridge(
            """SELECT 'src3' AS fold, log_chars AS x1, log_tokens AS x2, content, wording
            FROM train_x WHERE prompt_id <> 'src3'""",
            lam=0.0,
            columns=RIDGE_COLUMNS.replace(", 6)", ", 4)"),
        ),
        "train_x",
    ),
    "full_ridge": with_(
        _ridge("SELECT 'all' AS fold, log_chars AS x1, log_tokens AS x2, content, wording FROM train_x"),
        "train_x",
    ),
    "full_model": with_(
        " UNION ALL ".join(
            f"""SELECT 'all' AS fold, '{t}' AS target, count(*) AS n,
                {r(f"regr_intercept({t}, log_chars)", "intercept")},
                {r(f"regr_slope({t}, log_chars)", "slope")} FROM train_x"""
            for t in ("content", "wording")
        ),
        "train_x",
    ),
    "fold_gram": with_(
        f""", z AS MATERIALIZED (
            SELECT "group", pos, CAST(dim + 1 AS BIGINT) AS j, v FROM cells
            UNION ALL SELECT "group", pos, 0, 1 FROM vectors
            UNION ALL SELECT "group", pos, 65, mask FROM vectors)
        SELECT a."group" AS fold, a.j * 66 - a.j * (a.j - 1) // 2 + b.j - a.j AS cell,
               {r("sum(a.v * b.v)", "value")}
        FROM z a JOIN z b ON a."group" = b."group" AND a.pos = b.pos AND a.j <= b.j GROUP BY 1, 2""",
        "cells",
    ),
    "oof_predictions": with_(
        f"""SELECT student_id, prompt_id, content, wording, {r("predicted_content", "predicted_content")},
            {r("predicted_wording", "predicted_wording")} FROM line_oof""",
        "line_oof",
    ),
    "batch_scoring": f"""
        SELECT vec_id, {r("list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))", "prediction", 4)}
        FROM embeddings""",
    "predict_ensemble": with_(
        f"""SELECT student_id, {r("avg(content)", "content")}, {r("avg(wording)", "wording")}
        FROM each_model GROUP BY student_id""",
        "each_model",
    ),
    "ensemble_mean": with_(
        f"""SELECT student_id, {r("avg(content)", "content")}, {r("avg(wording)", "wording")}
        FROM each_model GROUP BY student_id""",
        "each_model",
    ),
    "ensemble_rows": with_(
        f"""SELECT student_id, {r("avg(content)", "content")}, {r("avg(wording)", "wording")}
        FROM each_model GROUP BY student_id""",
        "each_model",
    ),
    "ensemble_by_target": with_(
        f"""SELECT student_id, {r("avg(prediction) FILTER (target = 'content')", "content")},
            {r("avg(prediction) FILTER (target = 'wording')", "wording")},
            {r("stddev_pop(prediction) FILTER (target = 'content')", "content_spread")},
            {r("stddev_pop(prediction) FILTER (target = 'wording')", "wording_spread")}
        FROM (SELECT student_id, 'content' AS target, content AS prediction FROM each_model
              UNION ALL SELECT student_id, 'wording', wording FROM each_model) GROUP BY student_id""",
        "each_model",
    ),
    "stream_meter": f"""
        SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type AS metric,
               {r("avg(value) + 1e-10", "avg", 8)}, count(*) AS n
        FROM events GROUP BY 1, 2""",
    "stream_score": with_(
        f""", model AS (SELECT regr_slope(content, log_chars) AS sc, regr_intercept(content, log_chars) AS ic,
                   regr_slope(wording, log_chars) AS sw, regr_intercept(wording, log_chars) AS iw FROM train_x),
        x AS (SELECT student_id, prompt_id,
                     ln(1 + length('<summary> ' || text || ' <question> ' || prompt_question)) AS log_chars
              FROM everything)
        SELECT student_id, prompt_id, {r("ic + sc * log_chars", "content")}, {r("iw + sw * log_chars", "wording")}
        FROM x CROSS JOIN model""",
        "train_x",
        "everything",
    ),
}
# other ways to the same rows
ORACLES["eval_written"] = ORACLES["eval_holdout"]
ORACLES["model_file_predictions"] = ORACLES["oof_predictions"]
ORACLES["model_file_ensemble"] = ORACLES["ensemble_mean"]
