"""Building blocks of the SQL that the retrieval queries are checked against."""

from __future__ import annotations

from gleanix.functions.porter import DOUBLES, STEP_2, STEP_3, STEP_4
from gleanix.functions.text import CLEANING, PREFIX


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def clean(expression: str) -> str:
    for pattern, replacement in [PREFIX, *CLEANING]:
        expression = f"regexp_replace({expression}, {literal(pattern)}, {literal(replacement.replace('$', chr(92)))}, 'g')"
    return expression


def tokens(text: str) -> str:
    line = f"regexp_replace({text}, '[\\r\\n\\t]+', ' ', 'g')"
    return f"string_split_regex(rtrim(lower({clean(line)}), ' '), '\\s+')"


#: What the latest of a record's rows has most of.
LATEST = "(coalesce(epoch_us(read_at), -9223372036854775807), sha256(doc_in))"
DOCS = f"docs AS (SELECT doc_id, arg_max(doc_in, {LATEST}) AS text FROM collection_tsv WHERE doc_in IS NOT NULL GROUP BY doc_id)"
QUERIES = "qs AS (SELECT qid, coalesce(q.t, '') AS text FROM (SELECT qid, max({'l': line_no, 't': text}) AS q FROM queries_test GROUP BY qid))"
STOP = "st AS (SELECT list(DISTINCT word) AS sw FROM stop_words)"


def _cases(table: dict[str, str], region: str, extra: dict[str, str] | None = None) -> str:
    rows = []
    for s in sorted(table, key=lambda x: (-len(x), x)):
        condition = f"length(w) - {len(s)} >= {region}" + (f" AND {extra[s]}" if extra and s in extra else "")
        rows.append(f"WHEN ends_with(w, '{s}') THEN CASE WHEN {condition} THEN left(w, length(w) - {len(s)}) || '{table[s]}' ELSE w END")
    return "CASE " + " ".join(rows) + " ELSE w END"


def stem_ctes(source: str) -> str:
    """CTEs that end in ``stemmed(w0, w)`` for the distinct words w0 of ``source(w0)``."""
    v, c = "[aeiouy]", "[^aeiouy]"
    short = f"regexp_matches(w, '{c}{v}[^aeiouywxY]$')"
    return ",\n".join(
        [
            f"p0 AS (SELECT w0, regexp_replace(regexp_replace(w0, '^y', 'Y'), '({v})y', '\\1Y', 'g') AS w FROM {source})",
            f"p1 AS (SELECT *, CASE WHEN regexp_matches(w, '^{c}*{v}+{c}') THEN length(regexp_extract(w, '^{c}*{v}+{c}')) ELSE length(w) END AS r1, CASE WHEN regexp_matches(w, '^(?:{c}*{v}+{c}){{2}}') THEN length(regexp_extract(w, '^(?:{c}*{v}+{c}){{2}}')) ELSE length(w) END AS r2 FROM p0)",
            "p2 AS (SELECT * REPLACE (CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, length(w) - 2) WHEN ends_with(w, 'ss') THEN w WHEN ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END AS w) FROM p1)",
            f"p3 AS (SELECT *, NOT ends_with(w, 'eed') AND regexp_matches(w, '{v}.*(ed|ing)$') AS cutoff FROM p2)",
            "p4 AS (SELECT * REPLACE (CASE WHEN ends_with(w, 'eed') THEN CASE WHEN length(w) - 3 >= r1 THEN left(w, length(w) - 1) ELSE w END WHEN cutoff THEN regexp_replace(w, '(ed|ing)$', '') ELSE w END AS w) FROM p3)",
            f"p5 AS (SELECT * REPLACE (CASE WHEN NOT cutoff THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN regexp_matches(w, '({'|'.join(DOUBLES)})$') THEN left(w, length(w) - 1) WHEN length(w) = r1 AND {short} THEN w || 'e' ELSE w END AS w) FROM p4)",
            f"p6 AS (SELECT * REPLACE (CASE WHEN regexp_matches(w, '{v}.*[yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w) FROM p5)",
            f"p7 AS (SELECT * REPLACE ({_cases(STEP_2, 'r1')} AS w) FROM p6)",
            f"p8 AS (SELECT * REPLACE ({_cases(STEP_3, 'r1')} AS w) FROM p7)",
            f"p9 AS (SELECT * REPLACE ({_cases(dict.fromkeys(STEP_4, ''), 'r2', {'ion': "regexp_matches(w, '[st]ion$')"})} AS w) FROM p8)",
            f"p10 AS (SELECT * REPLACE (CASE WHEN ends_with(w, 'e') AND (length(w) - 1 >= r2 OR length(w) - 1 >= r1 AND NOT regexp_matches(w, '{c}{v}[^aeiouywxY]e$')) THEN left(w, length(w) - 1) ELSE w END AS w) FROM p9)",
            "stemmed AS (SELECT w0, replace(CASE WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN left(w, length(w) - 1) ELSE w END, 'Y', 'y') AS w FROM p10)",
        ]
    )


def terms(name: str, source: str, key: str, variant: str) -> str:
    """CTEs that end in ``name(key, pos, term)``: the terms of ``source(key, text)`` by the raw, stop or stem variant."""
    parts = [f"{name}_a AS (SELECT {key}, {tokens('text')} AS ws FROM {source})"]
    if variant == "raw":
        parts.append(f"{name}_b AS (SELECT {key}, ws FROM {name}_a)")
    else:
        parts.append(f"{name}_b AS (SELECT {key}, list_filter(ws, lambda t: NOT list_contains(sw, t)) AS ws FROM {name}_a, st)")
    parts.append(f"{name}_c AS (SELECT {key}, unnest(ws) AS w0, unnest(range(len(ws))) AS pos FROM {name}_b)")
    if variant != "stem":
        return ",\n".join([*parts, f"{name} AS (SELECT {key}, pos, substring(w0, 1, 20) AS term FROM {name}_c)"])
    return ",\n".join([*parts, f"{name} AS (SELECT {key}, pos, substring(w, 1, 20) AS term FROM {name}_c JOIN stemmed USING (w0))"])


def index(variant: str, queries: bool = False) -> str:
    """CTEs docs, t, posts(term, doc_id, tf, dl), lex(term, cf, df), n and avgdl; with ``queries`` also qt(qid, term)."""
    parts = [DOCS, STOP, QUERIES]
    if variant == "stem":
        both = f"SELECT unnest({tokens('text')}) AS w0 FROM docs" + (f" UNION SELECT unnest({tokens('text')}) FROM qs" if queries else "")
        parts += [f"voc AS (SELECT DISTINCT w0 FROM ({both}))", stem_ctes("voc")]
    parts += [
        terms("t", "docs", "doc_id", variant),
        "dt AS (SELECT doc_id, count(*)::INT AS dl FROM t GROUP BY 1)",
        "stats AS (SELECT (SELECT count(*) FROM docs) AS n, (SELECT (sum(dl) // count(*))::DOUBLE FROM dt) AS avgdl)",
        "posts AS (SELECT term, doc_id, count(*)::INT AS tf, any_value(dl) AS dl FROM t JOIN dt USING (doc_id) GROUP BY 1, 2)",
        "lex AS (SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM posts GROUP BY 1)",
    ]
    if queries:
        parts += [terms("q", "qs", "qid", variant), "qt AS (SELECT DISTINCT qid, term FROM q)"]
    return "WITH " + ",\n".join(parts)


TFIDF = "(1 + ln(tf)) * CASE WHEN n // df < 1 THEN '-inf'::DOUBLE ELSE ln(n // df) END"
BM25 = "tf / (1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl) + tf) * ln(n::DOUBLE / df)"


def ranked(weight: str, mode: str, k: int, df: str = "df") -> str:
    """The k best documents of every query in qt."""
    need = "WHERE c = nt" if mode == "and" else ""
    return f"""ql AS (SELECT qid, term, {df} AS df, count(*) OVER (PARTITION BY qid) AS nt FROM qt JOIN lex USING (term)),
s AS (SELECT qid, doc_id, sum({weight}) AS score, count(*) AS c, any_value(nt) AS nt FROM posts JOIN ql USING (term), stats GROUP BY 1, 2),
r AS (SELECT qid, doc_id, round(score, 6) AS score FROM (SELECT * FROM s {need}) WHERE score > -1),
top AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r QUALIFY rank <= {k})"""
