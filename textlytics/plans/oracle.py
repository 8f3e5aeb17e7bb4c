"""Shared DuckDB SQL pieces for the oracle queries.

The analyser is written once here with the same pattern and stop list as
:mod:`textlytics.functions.text`, so every oracle tokenises identically.
"""

from __future__ import annotations

from ..functions.text import MAX_TOKEN_LENGTH, STOP_WORDS, TOKEN_PATTERN


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(sql_str(i) for i in items) + "]"


STOP_SQL = sql_list(STOP_WORDS)
RX_SQL = sql_str(TOKEN_PATTERN)


def analyze_sql(expr: str) -> str:
    """DuckDB list of terms for a text expression (same rules as functions.text.analyze)."""
    return (f"list_filter(regexp_extract_all(lower(coalesce({expr}, '')), {RX_SQL}), "
            f"lambda t: length(t) <= {MAX_TOKEN_LENGTH} AND NOT list_contains({STOP_SQL}, t))")


def title_sql(expr: str) -> str:
    """Ticket text as matched and shown by the keyword reports: the whole text."""
    return f"coalesce({expr}, '')"


def norm_sql(n: str) -> str:
    r = f"(1.0 / sqrt({n}))"
    p = f"pow(2.0, floor(log2({r})) - 2)"
    return f"(floor({r} / {p}) * {p})"


# Corpus CTEs: tok (doc_id, terms), post (doc_id, term, tf, doc_len, doc_terms),
# dfs (term, df), ndocs (n).  Every oracle starts with this prefix.
CORPUS = f"""WITH
tok AS (SELECT doc_id, {analyze_sql('text')} AS terms FROM documents),
post AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf, max(doc_len) AS doc_len, max(doc_terms) AS doc_terms
  FROM (SELECT doc_id, unnest(terms) AS term, len(terms)::BIGINT AS doc_len,
               len(list_distinct(terms))::BIGINT AS doc_terms FROM tok)
  GROUP BY doc_id, term),
dfs AS (SELECT term, count(*)::BIGINT AS df FROM post GROUP BY term),
ndocs AS (SELECT count(*)::BIGINT AS n FROM documents)"""


def with_corpus(body: str) -> str:
    """``body`` either starts with ', name AS (...)' (more CTEs) or with SELECT."""
    body = body.strip()
    return CORPUS + ("\n" if body.startswith(",") else "\n") + body


def scored_sql(kw_terms_sql: str) -> str:
    """CTEs kt(keyword, term) → sc(keyword, doc_id, score, matched), same formula as search._scored."""
    return f""",
kt AS ({kw_terms_sql}),
qs AS (SELECT kt.keyword, kt.term,
              1 + ln((SELECT n FROM ndocs) / (coalesce(d.df, 0) + 1.0)) AS idf
       FROM kt LEFT JOIN dfs d ON d.term = kt.term),
qn AS (SELECT keyword, count(*) AS n_q, 1.0 / sqrt(sum(idf * idf)) AS qnorm FROM qs GROUP BY keyword),
sc0 AS (SELECT qs.keyword, p.doc_id, sum(sqrt(p.tf) * qs.idf * qs.idf * {norm_sql('p.doc_len')}) AS s,
               count(*) AS matched
        FROM post p JOIN qs ON p.term = qs.term GROUP BY qs.keyword, p.doc_id),
sc AS (SELECT sc0.keyword, doc_id, round(matched / n_q * qnorm * s, 6) AS score, matched
       FROM sc0 JOIN qn ON qn.keyword = sc0.keyword)"""


def keyword_terms_sql(keywords_sql: str) -> str:
    """(keyword, term) from a SELECT giving one ``keyword`` column (distinct keywords)."""
    return (f"SELECT DISTINCT keyword, unnest(list_distinct({analyze_sql('keyword')})) AS term "
            f"FROM (SELECT DISTINCT keyword FROM ({keywords_sql}) WHERE keyword IS NOT NULL)")


def values_sql(col: str, items, lower: bool = False) -> str:
    rows = ", ".join(f"({sql_str(i.lower() if lower else i)})" for i in items)
    return f"SELECT * FROM (VALUES {rows}) AS v({col})"
