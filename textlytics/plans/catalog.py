"""Registered queries: one per operator key of the inventory.

Each query takes ``(spark, sf_dir)``, reads the driver's parquet tables and
returns a lazy DataFrame (sinks and streams run their write inside).  The
matching DuckDB SQL sits next to it; ``oracle=None`` marks a query with a
rows-only check (tested against brute force in ``tests/`` instead).
Computed columns carry the same names in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as ix
from ..operators import search as se
from ..operators import stats as st
from ..operators import term_table as tt
from ..operators.ordering import cut, running_totals
from ..session import scratch_path
from ..sources import fixtures as fx
from .oracle import (analyze_sql, keyword_terms_sql, scored_sql, sql_list, sql_str, title_sql,
                     values_sql, with_corpus)

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(key: str, oracle: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn
    return deco


def _post(spark, sf_dir):
    return ix.postings(fx.corpus(spark, sf_dir))


def _docs(spark, sf_dir):
    return fx.corpus(spark, sf_dir)


def _indexed(spark, sf_dir):
    """Postings of the text, written to the shared folder and read back, for queries that read all
    of them in several passes: analyse once, then query.  (A saved index is also sorted by
    term, for lookups; that is a shuffle of all postings, and these queries look up none.)"""
    path = scratch_path(spark, "postings")
    _post(spark, sf_dir).write.parquet(path)
    return spark.read.schema(ix.POSTINGS_SCHEMA).parquet(path)


def _listed(spark, sf_dir, terms, col="term"):
    """Postings of listed terms: only texts that can have one are analysed."""
    return ix.listed_postings(_docs(spark, sf_dir), terms.select(F.col(col).alias("term")))


def _searched(spark, sf_dir, keywords, col="keyword"):
    """Postings of the terms that a table of keywords asks for; written, since a search reads them
    twice (frequencies, then scores) and the texts should be analysed once."""
    return cut(ix.listed_postings(_docs(spark, sf_dir), se.keyword_terms(keywords, col)))


def _r6(c):
    return F.round(c, 6)


KW_SQL = values_sql("keyword", [k for k in fx.KEYWORDS], lower=True)

# ============================================================ text analysis


@query("analyze_text", with_corpus("""
SELECT doc_id, len(terms)::BIGINT AS n_terms, array_to_string(terms, ' ') AS terms FROM tok"""))
def q_analyze_text(spark, sf_dir):
    a = ix.analyzed_docs(_docs(spark, sf_dir))
    return a.select("doc_id", F.col("doc_len").alias("n_terms"), F.array_join("terms", " ").alias("terms"))


@query("term_positions", f"""
SELECT doc_id, (pos - 1)::BIGINT AS pos, term FROM (
  SELECT doc_id, unnest(toks) AS term, unnest(generate_series(1, len(toks))) AS pos
  FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {sql_str(ix.TOKEN_PATTERN)}) AS toks
        FROM documents))
WHERE length(term) <= 255 AND NOT list_contains({sql_list(ix.STOP_WORDS)}, term)""")
def q_term_positions(spark, sf_dir):
    return ix.term_positions(_docs(spark, sf_dir))


@query("document_terms", with_corpus("""
SELECT doc_id, array_to_string(list_sort(list_distinct(terms)), ' ') AS terms FROM tok"""))
def q_document_terms(spark, sf_dir):
    t = st.document_terms(_docs(spark, sf_dir))
    return t.select("doc_id", F.array_join("terms", " ").alias("terms"))


_INDEX_SQL = f"""
SELECT doc_id, field, term, count(*)::BIGINT AS tf, any_value(len(terms))::BIGINT AS doc_len,
       any_value(len(list_distinct(terms)))::BIGINT AS doc_terms
FROM (SELECT doc_id, field, terms, unnest(terms) AS term FROM (
  SELECT doc_id, field, {analyze_sql('value')} AS terms FROM (
    SELECT doc_id, 'text' AS field, text AS value FROM documents
    UNION ALL SELECT doc_id, 'lang', lang FROM documents
    UNION ALL SELECT doc_id, 'n_chars', n_chars::VARCHAR FROM documents
    UNION ALL SELECT doc_id, 'source', source FROM documents)))
GROUP BY doc_id, field, term"""


@query("index_documents", _INDEX_SQL)
def q_index_documents(spark, sf_dir):
    path = scratch_path(spark, "index")
    ix.write_index(_docs(spark, sf_dir), path)
    return ix.load_index(spark, path)


@query("append_document", _INDEX_SQL)
def q_append_document(spark, sf_dir):
    # an index of the documents in other languages, to which the French ones are added
    d, path = _docs(spark, sf_dir), scratch_path(spark, "index")
    french = F.col("lang").eqNullSafe("fr")
    ix.write_index(d.where(~french), path)
    ix.append_documents(path, d.where(french))
    return ix.load_index(spark, path)

# ============================================================ statistics


@query("total_docs", "SELECT count(*)::BIGINT AS total_docs FROM documents")
def q_total_docs(spark, sf_dir):
    return st.total_docs(_docs(spark, sf_dir))


@query("doc_freq", with_corpus(f""", q AS (SELECT DISTINCT keyword AS term FROM ({KW_SQL}))
SELECT q.term, coalesce(d.df, 0)::BIGINT AS df FROM q LEFT JOIN dfs d ON d.term = q.term"""))
def q_doc_freq(spark, sf_dir):
    terms = fx.keyword_list(spark).select(F.col("keyword").alias("term"))
    return st.doc_freq(_listed(spark, sf_dir, terms), terms)


_PROBES = ("from", "ouen", "qzxjv")


@query("term_freq", with_corpus(f""", probes AS (
  SELECT d.doc_id, w.term FROM documents d, ({values_sql('term', _PROBES)}) w)
SELECT pr.doc_id, pr.term, coalesce(p.tf, -1)::BIGINT AS tf, p.tf IS NOT NULL AS present
FROM probes pr LEFT JOIN post p ON p.doc_id = pr.doc_id AND p.term = pr.term"""))
def q_term_freq(spark, sf_dir):
    # every document probed for a frequent, a rare and an absent term
    probes = _docs(spark, sf_dir).select(
        "doc_id", F.explode(F.array(*[F.lit(t) for t in _PROBES])).alias("term"))
    return st.term_freq(_listed(spark, sf_dir, fx.term_list(spark, _PROBES)), probes)


@query("terms_by_doc_freq", with_corpus("""
SELECT row_number() OVER (ORDER BY df DESC, term)::BIGINT AS rank, term, df FROM dfs"""))
def q_terms_by_doc_freq(spark, sf_dir):
    ranked = running_totals(st.doc_freqs(_post(spark, sf_dir)), [F.desc("df"), F.asc("term")])
    return ranked.select(F.col("rank").cast("long").alias("rank"), "term", "df")


@query("listed_terms_by_doc_freq", with_corpus(f"""
SELECT row_number() OVER (ORDER BY df DESC, term)::BIGINT AS rank, term, df
FROM dfs WHERE term IN (SELECT keyword FROM ({KW_SQL}))"""))
def q_listed_terms_by_doc_freq(spark, sf_dir):
    terms = fx.keyword_list(spark).select(F.col("keyword").alias("term"))
    a5 = st.listed_terms_by_doc_freq(_listed(spark, sf_dir, terms), terms)
    # the listed result is bounded by the keyword list: a plain window is fine
    from pyspark.sql import Window
    return a5.select(F.row_number().over(Window.orderBy(F.desc("df"), F.asc("term"))).cast("long").alias("rank"),
                     "term", "df")


@query("top_terms", with_corpus(f"""
SELECT row_number() OVER (ORDER BY df DESC, term)::BIGINT AS rank, term, df FROM dfs
WHERE df::DOUBLE > {fx.TOP_CUTOFF} * (SELECT max(df) FROM dfs) OR df = (SELECT max(df) FROM dfs)
ORDER BY df DESC, term LIMIT {fx.TOP_N}"""))
def q_top_terms(spark, sf_dir):
    return st.top_terms(_post(spark, sf_dir), fx.TOP_CUTOFF, fx.TOP_N)


@query("top_terms_cutoff", with_corpus(f"""
SELECT row_number() OVER (ORDER BY df DESC, term)::BIGINT AS rank, term, df FROM dfs
WHERE df::DOUBLE > {fx.TOP_CUTOFF} * (SELECT max(df) FROM dfs) OR df = (SELECT max(df) FROM dfs)"""))
def q_top_terms_cutoff(spark, sf_dir):
    # frequencies need the documents' distinct terms only, not their counts
    a7 = st.leading_terms(rp.set_doc_freqs(ix.document_sets(_docs(spark, sf_dir))), fx.TOP_CUTOFF)
    ranked = running_totals(a7, [F.desc("df"), F.asc("term")])
    return ranked.select(F.col("rank").cast("long").alias("rank"), "term", "df")


@query("df_tf_listing", with_corpus("""
SELECT p.term, d.df, p.doc_id, p.tf FROM post p JOIN dfs d ON d.term = p.term"""))
def q_df_tf_listing(spark, sf_dir):
    return st.df_tf_listing(_indexed(spark, sf_dir))


@query("idf", with_corpus("""
SELECT term, df, round(1 + ln((SELECT n FROM ndocs) / (df + 1.0)), 6) AS idf FROM dfs"""))
def q_idf(spark, sf_dir):
    t = st.idf_table(_post(spark, sf_dir), _docs(spark, sf_dir))
    return t.select("term", "df", _r6(F.col("idf")).alias("idf"))


@query("tfidf_weights", with_corpus("""
SELECT p.doc_id, p.term, p.tf, round(1 + ln((SELECT n FROM ndocs) / (d.df + 1.0)), 6) AS idf,
       round(sqrt(p.tf) * (1 + ln((SELECT n FROM ndocs) / (d.df + 1.0))), 6) AS weight
FROM post p JOIN dfs d ON d.term = p.term"""))
def q_tfidf_weights(spark, sf_dir):
    t = st.tfidf_weights(_indexed(spark, sf_dir), _docs(spark, sf_dir))
    return t.select("doc_id", "term", "tf", _r6(F.col("idf")).alias("idf"), _r6(F.col("weight")).alias("weight"))


def _term_table(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    n = docs.count()
    return tt.save_term_table(_post(spark, sf_dir), n, scratch_path(spark, "term-table"), tt.enough_buckets(docs)), n


@query("term_table_doc_freqs", with_corpus("SELECT term, df FROM dfs"))
def q_term_table_doc_freqs(spark, sf_dir):
    return tt.table_doc_freqs(_term_table(spark, sf_dir)[0])


@query("term_table_df_tf_listing", ORACLE["df_tf_listing"])
def q_term_table_df_tf_listing(spark, sf_dir):
    return tt.table_df_tf_listing(_term_table(spark, sf_dir)[0])


@query("term_table_tfidf_weights", ORACLE["tfidf_weights"])
def q_term_table_tfidf_weights(spark, sf_dir):
    t = tt.table_tfidf_weights(*_term_table(spark, sf_dir))
    return t.select("doc_id", "term", "tf", _r6(F.col("idf")).alias("idf"), _r6(F.col("weight")).alias("weight"))


@query("tf_matrix", with_corpus(""", dict AS (SELECT term, (row_number() OVER (ORDER BY term) - 1)::BIGINT AS term_idx FROM dfs)
SELECT p.doc_id, dict.term_idx, p.term, p.tf FROM post p JOIN dict ON dict.term = p.term"""))
def q_tf_matrix(spark, sf_dir):
    return st.tf_matrix(_indexed(spark, sf_dir))


@query("df_vector", with_corpus("""
SELECT (row_number() OVER (ORDER BY term) - 1)::BIGINT AS term_idx, term, df FROM dfs"""))
def q_df_vector(spark, sf_dir):
    return st.df_vector(_post(spark, sf_dir))


@query("term_vectors", with_corpus("""
SELECT doc_id, term, 1.0::DOUBLE AS weight FROM post"""))
def q_term_vectors(spark, sf_dir):
    return st.term_vectors(_post(spark, sf_dir), "binary")


_OR_POS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}::BIGINT, {sql_str(t)})" for i, t in enumerate(fx.OR_TERMS)) + ") AS v(pos, term)"


@query("restricted_term_vectors", with_corpus(f""", tl AS ({_OR_POS_SQL})
SELECT p.doc_id, tl.pos, p.term, 1.0::DOUBLE AS weight FROM post p JOIN tl ON tl.term = p.term"""))
def q_restricted_term_vectors(spark, sf_dir):
    return st.restricted_term_vectors(_post(spark, sf_dir), fx.term_list(spark, fx.OR_TERMS))


@query("l1_normalize", with_corpus("""
SELECT doc_id, term, round(tf / sum(tf) OVER (PARTITION BY doc_id), 6) AS weight FROM post"""))
def q_l1_normalize(spark, sf_dir):
    post = ix.postings(_docs(spark, sf_dir), norm=True)
    v = st.l1_normalize(post.select("doc_id", "term", F.col("tf").cast("double").alias("weight"), "l1"), "l1")
    return v.select("doc_id", "term", _r6(F.col("weight")).alias("weight"))

# ============================================================ search


@query("search_keyword", with_corpus(scored_sql(keyword_terms_sql(values_sql("keyword", [fx.SEARCH_KEYWORD]))) + f"""
SELECT (row_number() OVER (ORDER BY score DESC, doc_id) - 1)::BIGINT AS rank, doc_id, score
FROM sc ORDER BY score DESC, doc_id LIMIT {fx.SEARCH_TOP_N}"""))
def q_search_keyword(spark, sf_dir):
    post = _searched(spark, sf_dir, se.single(spark, fx.SEARCH_KEYWORD))
    return se.search_keyword(post, _docs(spark, sf_dir), fx.SEARCH_KEYWORD, fx.SEARCH_TOP_N)


_OR_KT = f"SELECT DISTINCT 'q' AS keyword, term FROM ({values_sql('term', fx.OR_TERMS)})"


@query("search_any_term", with_corpus(scored_sql(_OR_KT) + f"""
SELECT (row_number() OVER (ORDER BY score DESC, doc_id) - 1)::BIGINT AS rank, doc_id, score
FROM sc ORDER BY score DESC, doc_id LIMIT {fx.SEARCH_TOP_N}"""))
def q_search_any_term(spark, sf_dir):
    terms = fx.term_list(spark, fx.OR_TERMS)
    return se.search_any_term(_listed(spark, sf_dir, terms), _docs(spark, sf_dir), terms, fx.SEARCH_TOP_N)


@query("search_in_id_order", with_corpus(scored_sql(_OR_KT) + f""",
top AS (SELECT doc_id FROM sc ORDER BY score DESC, doc_id LIMIT {fx.SEARCH_TOP_N})
SELECT d.doc_id, regexp_replace(d.text, '(\\r\\n|\\n|\\r)\\z', '') AS text
FROM documents d JOIN top ON top.doc_id = d.doc_id"""))
def q_search_in_id_order(spark, sf_dir):
    terms = fx.term_list(spark, fx.OR_TERMS)
    return se.search_in_id_order(_listed(spark, sf_dir, terms), _docs(spark, sf_dir), terms, fx.SEARCH_TOP_N)


@query("search_results_table", with_corpus(scored_sql(keyword_terms_sql(values_sql("keyword", [fx.SEARCH_KEYWORD]))) + f""",
top AS (SELECT (row_number() OVER (ORDER BY score DESC, doc_id) - 1)::BIGINT AS rank, doc_id, score
        FROM sc ORDER BY score DESC, doc_id LIMIT {fx.SEARCH_TOP_N})
SELECT top.rank, top.score, top.doc_id, d.text, d.source,
       (count(*) OVER ())::BIGINT AS matched
FROM top JOIN documents d ON d.doc_id = top.doc_id"""))
def q_search_results_table(spark, sf_dir):
    post = _searched(spark, sf_dir, se.single(spark, fx.SEARCH_KEYWORD))
    return se.search_results_table(post, _docs(spark, sf_dir), fx.SEARCH_KEYWORD, fx.SEARCH_TOP_N,
                                   fields=("text", "source"))


_BEST_TERMS = ("from", "tion", "Que", "ouen", "qzxjv")


@query("best_doc_for_term", with_corpus(scored_sql(
    f"SELECT DISTINCT term AS keyword, lower(term) AS term FROM ({values_sql('term', _BEST_TERMS)})") + """
SELECT keyword AS term, doc_id FROM (
  SELECT keyword, doc_id, row_number() OVER (PARTITION BY keyword ORDER BY score DESC, doc_id) AS rn FROM sc)
WHERE rn = 1"""))
def q_best_doc_for_term(spark, sf_dir):
    terms = fx.term_list(spark, _BEST_TERMS)
    return se.best_doc_for_term(_searched(spark, sf_dir, terms, "term"), _docs(spark, sf_dir), terms)


@query("batch_search", with_corpus(scored_sql(keyword_terms_sql(KW_SQL)) + f"""
SELECT keyword, (rn - 1)::BIGINT AS rank, doc_id, score FROM (
  SELECT keyword, doc_id, score, row_number() OVER (PARTITION BY keyword ORDER BY score DESC, doc_id) AS rn FROM sc)
WHERE rn <= {fx.SEARCH_TOP_N}"""))
def q_batch_search(spark, sf_dir):
    kw = fx.keyword_list(spark)
    return se.batch_search(_searched(spark, sf_dir, kw), _docs(spark, sf_dir), kw, fx.SEARCH_TOP_N)

# ============================================================ coverage and keyword reports

from ..operators import classify as nb  # noqa: E402
from ..operators import cosine as cs  # noqa: E402
from ..operators import matching as mt  # noqa: E402
from ..operators import pair_counts as pc  # noqa: E402
from ..operators import reports as rp  # noqa: E402
from ..operators import similar as sm  # noqa: E402

_KW_IDX_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}::BIGINT, {sql_str(k.lower())})" for i, k in enumerate(fx.KEYWORDS) if k) + ") AS v(kw_idx, keyword)"

_FIRST_COVER_SQL = """
first AS (SELECT doc_id, arg_min(p.term, struct_pack(k := -d.df, t := p.term)) AS term
          FROM {post} p JOIN {dfs} d ON d.term = p.term GROUP BY doc_id),
newc AS (SELECT term, count(*)::BIGINT AS n_new FROM first GROUP BY term)"""


@query("term_distribution", with_corpus(", " + _FIRST_COVER_SQL.format(post="post", dfs="dfs") + """
SELECT row_number() OVER w::BIGINT AS rank, dfs.term, dfs.df, coalesce(n_new, 0)::BIGINT AS n_new,
       (sum(coalesce(n_new, 0)) OVER w)::BIGINT AS covered,
       round(sum(coalesce(n_new, 0)) OVER w / (SELECT n FROM ndocs), 6) AS covered_share
FROM dfs LEFT JOIN newc ON newc.term = dfs.term
WINDOW w AS (ORDER BY dfs.df DESC, dfs.term ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def q_term_distribution(spark, sf_dir):
    d = _docs(spark, sf_dir)
    sets = ix.analyzed_docs(d).select("doc_id", F.array_distinct("terms").alias("terms"))
    r = rp.term_distribution_of_sets(sets, d)
    return r.withColumn("covered_share", _r6(F.col("covered_share")))


_LISTED_SQL = f""",
lpost AS (SELECT * FROM post WHERE term IN (SELECT keyword FROM ({KW_SQL}))),
ldfs AS (SELECT term, count(*)::BIGINT AS df FROM lpost GROUP BY term),""" + _FIRST_COVER_SQL.format(post="lpost", dfs="ldfs")


@query("keyword_summary_report", with_corpus(_LISTED_SQL + """
SELECT row_number() OVER w::BIGINT AS rank, ldfs.term AS keyword, ldfs.df AS n_reports,
       coalesce(n_new, 0)::BIGINT AS n_new_covered,
       round(sum(coalesce(n_new, 0)) OVER w / (SELECT n FROM ndocs), 6) AS pct_total_covered
FROM ldfs LEFT JOIN newc ON newc.term = ldfs.term
WINDOW w AS (ORDER BY ldfs.df DESC, ldfs.term ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def q_keyword_summary_report(spark, sf_dir):
    kw = fx.keyword_list(spark)
    r = rp.keyword_summary_report(_listed(spark, sf_dir, kw, "keyword"), _docs(spark, sf_dir), kw)
    return r.withColumn("pct_total_covered", _r6(F.col("pct_total_covered")))


@query("keyword_report_totals", with_corpus(f"""
SELECT (SELECT count(DISTINCT term) FROM post WHERE term IN (SELECT keyword FROM ({KW_SQL})))::BIGINT AS matched_keywords,
       (SELECT n FROM ndocs)::BIGINT AS total_reports"""))
def q_keyword_report_totals(spark, sf_dir):
    kw = fx.keyword_list(spark)
    return rp.keyword_report_totals(_listed(spark, sf_dir, kw, "keyword"), _docs(spark, sf_dir), kw)


_DETAIL_SQL = f"""
t AS (SELECT doc_id AS id, {title_sql('text')} AS title FROM documents),
kw AS ({_KW_IDX_SQL}),
detail AS (SELECT t.id, t.title, kw.keyword FROM t JOIN kw ON contains(lower(t.title), kw.keyword))"""


@query("keyword_detail_report", f"WITH {_DETAIL_SQL}\nSELECT id, title, keyword FROM detail")
def q_keyword_detail_report(spark, sf_dir):
    return rp.keyword_detail_report(fx.tickets(spark, sf_dir), fx.keyword_list(spark))


# a long list, drawn from another table: every word of five letters or more of the benchmark items
_WORD_PATTERN = r"[\p{L}]{5,}"


@query("keyword_list_matches", f"""
WITH kw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {sql_str(_WORD_PATTERN)})) AS keyword FROM benchmark)
SELECT d.doc_id AS id, kw.keyword FROM documents d JOIN kw ON contains(lower({title_sql('d.text')}), kw.keyword)""")
def q_keyword_list_matches(spark, sf_dir):
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_WORD_PATTERN), F.lit(0)))
    kw = fx.table(spark, sf_dir, "benchmark").select(found.alias("keyword")).distinct()
    return mt.keyword_matches(fx.tickets(spark, sf_dir), kw, "id")


@query("report_labels", f"""WITH {_DETAIL_SQL},
lab AS (SELECT id, array_to_string(list_sort(list_distinct(list(keyword))), '|') AS labels FROM detail GROUP BY id)
SELECT t.id, coalesce(lab.labels, '') AS labels FROM t LEFT JOIN lab ON lab.id = t.id""")
def q_report_labels(spark, sf_dir):
    t = fx.tickets(spark, sf_dir)
    r = rp.report_labels(t, rp.keyword_detail_report(t, fx.keyword_list(spark)))
    return r.select("id", F.array_join("labels", "|").alias("labels"))

# ============================================================ co-occurrence and similarity


M1_TERMS = ("from", "tion", "que", "der", "ouen", "erin", "ein", "qzxjv")
_M1_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}::BIGINT, {sql_str(t)})" for i, t in enumerate(M1_TERMS)) + ") AS v(pos, term)"


def _cooc_sql(tl_sql: str) -> str:
    return f""",
tl AS ({tl_sql}),
r AS (SELECT p.doc_id, tl.pos FROM post p JOIN tl ON tl.term = p.term),
cnt AS (SELECT a.pos AS pos_a, b.pos AS pos_b, count(*)::BIGINT AS n
        FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.pos <= b.pos GROUP BY 1, 2),
cooc AS (SELECT a.pos AS pos_a, a.term AS term_a, b.pos AS pos_b, b.term AS term_b,
                coalesce(cnt.n, 0)::BIGINT AS n_docs
         FROM tl a JOIN tl b ON a.pos <= b.pos LEFT JOIN cnt ON cnt.pos_a = a.pos AND cnt.pos_b = b.pos)"""


@query("term_cooccurrence", with_corpus(_cooc_sql(_M1_SQL) + "\nSELECT * FROM cooc"))
def q_term_cooccurrence(spark, sf_dir):
    terms = fx.term_list(spark, M1_TERMS)
    return sm.term_cooccurrence(_listed(spark, sf_dir, terms), terms)


_TOP20_SQL = f"""SELECT (row_number() OVER (ORDER BY df DESC, term) - 1)::BIGINT AS pos, term FROM dfs
WHERE df::DOUBLE > {fx.TOP_CUTOFF} * (SELECT max(df) FROM dfs) OR df = (SELECT max(df) FROM dfs)
ORDER BY df DESC, term LIMIT {fx.PAIRWISE_TOP_N}"""


@query("top_term_cooccurrence", with_corpus(_cooc_sql(_TOP20_SQL) + "\nSELECT * FROM cooc"))
def q_top_term_cooccurrence(spark, sf_dir):
    return sm.top_term_cooccurrence(_indexed(spark, sf_dir), fx.PAIRWISE_TOP_N, fx.TOP_CUTOFF)


@query("term_cooccurrence_listed", with_corpus(f""", tl AS ({_M1_SQL})
SELECT a.term AS term_a, b.term AS term_b, count(*)::BIGINT AS n_docs
FROM post a JOIN post b ON a.doc_id = b.doc_id WHERE a.term IN (SELECT term FROM tl) GROUP BY 1, 2"""))
def q_term_cooccurrence_listed(spark, sf_dir):
    return sm.term_cooccurrence_listed_of_sets(ix.document_sets(_docs(spark, sf_dir)), fx.term_list(spark, M1_TERMS))


# every pair of the vocabulary that a hundredth of the documents have in common
@query("term_cooccurrence_all", with_corpus(f""",
least AS (SELECT greatest(2, ceil(n / {fx.PAIR_SHARE}))::BIGINT AS m FROM ndocs),
fpost AS (SELECT p.doc_id, p.term FROM post p JOIN dfs d ON d.term = p.term WHERE d.df >= (SELECT m FROM least))
SELECT a.term AS term_a, b.term AS term_b, count(*)::BIGINT AS n_docs
FROM fpost a JOIN fpost b ON a.doc_id = b.doc_id AND a.term <= b.term
GROUP BY 1, 2 HAVING count(*) >= (SELECT m FROM least)"""))
def q_term_cooccurrence_all(spark, sf_dir):
    least = max(2, -(-_docs(spark, sf_dir).count() // fx.PAIR_SHARE))
    return pc.frequent_pairs(_indexed(spark, sf_dir), least)


def _cosine_sql(signature: str, dot: str, norm: str, weighted: str, decimals: int,
                kept: str = f"\nWHERE cosine >= {fx.MIN_COSINE}") -> str:
    """Representatives of equal vectors linked to each other, and each copy to its representative."""
    return with_corpus(f""",
nd AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM post),
wp AS (SELECT p.doc_id, p.term, p.tf, {weighted} AS w FROM post p JOIN dfs d ON d.term = p.term),
vec AS (SELECT doc_id, list({signature} ORDER BY term) AS s, sqrt(sum(w * w)) AS norm, count(*)::BIGINT AS n FROM wp GROUP BY doc_id),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id, norm, n FROM vec),
rp AS (SELECT wp.*, cls.norm, cls.n FROM wp JOIN cls ON cls.doc_id = wp.doc_id WHERE cls.doc_id = cls.class_id)
SELECT * FROM (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*)::BIGINT AS overlap,
         round({dot} / {norm}, {decimals}) AS cosine, false AS copy
  FROM rp a JOIN rp b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2){kept}
UNION ALL SELECT class_id, doc_id, n, 1.0, true FROM cls WHERE doc_id <> class_id""")


# all pairs of documents that share a term, however low their cosine
@query("pairwise_cosine", _cosine_sql("term", "count(*)", "max(sqrt(a.n::DOUBLE) * sqrt(b.n::DOUBLE))", "1.0::DOUBLE", cs.DECIMALS, ""))
def q_pairwise_cosine(spark, sf_dir):
    return cs.similar_pairs(_indexed(spark, sf_dir), None)


@query("pairwise_cosine_tf", _cosine_sql("(term, tf)", "sum(a.w * b.w)", "max(a.norm * b.norm)", "p.tf::DOUBLE", cs.DECIMALS))
def q_pairwise_cosine_tf(spark, sf_dir):
    return cs.similar_pairs(_indexed(spark, sf_dir), fx.MIN_COSINE, "tf")


# weights are no whole numbers, so sums differ in their last places between engines: 6 decimals
@query("pairwise_cosine_tfidf", _cosine_sql("(term, tf)", "sum(a.w * b.w)", "max(a.norm * b.norm)",
                                            "sqrt(p.tf) * (1 + ln((SELECT n FROM nd) / (d.df + 1.0)))", 6))
def q_pairwise_cosine_tfidf(spark, sf_dir):
    return cs.similar_pairs(_indexed(spark, sf_dir), fx.MIN_COSINE, "tfidf", 6)


@query("cosine_of_docs", with_corpus(""",
pairs AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
ov AS (SELECT pa.doc_a, pa.doc_b, count(*) AS ov FROM pairs pa
       JOIN post x ON x.doc_id = pa.doc_a JOIN post y ON y.doc_id = pa.doc_b AND y.term = x.term GROUP BY 1, 2),
nt AS (SELECT doc_id, max(doc_terms)::DOUBLE AS n FROM post GROUP BY doc_id)
SELECT pairs.doc_a, pairs.doc_b, round(coalesce(ov.ov / (sqrt(na.n) * sqrt(nb.n)), 0.0), 6) AS cosine
FROM pairs LEFT JOIN ov ON ov.doc_a = pairs.doc_a AND ov.doc_b = pairs.doc_b
LEFT JOIN nt na ON na.doc_id = pairs.doc_a LEFT JOIN nt nb ON nb.doc_id = pairs.doc_b"""))
def q_cosine_of_docs(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id")
    pairs = d.select(F.col("doc_id").alias("doc_a")).join(
        d.select(F.col("doc_id").alias("doc_b")), F.col("doc_b") == F.col("doc_a") + 1)
    r = sm.cosine_of_docs(_indexed(spark, sf_dir), pairs)
    return r.withColumn("cosine", _r6(F.col("cosine")))


_M6_COLS = ", ".join(
    f"coalesce(max(CASE WHEN b.pos = {i} THEN round(ov / (sqrt(na.n) * sqrt(nb.n)), 3) END), 0.0) AS c{i:02d}"
    for i in range(len(fx.MATRIX_DOCS)))
_M6_LIST = "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {d}::BIGINT)" for i, d in enumerate(fx.MATRIX_DOCS)) + ") AS v(pos, doc_id)"


@query("similarity_matrix_table", with_corpus(f""",
ml AS ({_M6_LIST}),
nt AS (SELECT doc_id, max(doc_terms)::DOUBLE AS n FROM post GROUP BY doc_id),
ov AS (SELECT x.doc_id AS doc_a, y.doc_id AS doc_b, count(*) AS ov FROM post x JOIN post y ON y.term = x.term
       WHERE x.doc_id IN (SELECT doc_id FROM ml) AND y.doc_id IN (SELECT doc_id FROM ml) GROUP BY 1, 2)
SELECT a.pos AS pos_a, a.doc_id AS doc_a, {_M6_COLS}
FROM ml a JOIN ml b ON a.pos < b.pos LEFT JOIN ov ON ov.doc_a = a.doc_id AND ov.doc_b = b.doc_id
LEFT JOIN nt na ON na.doc_id = a.doc_id LEFT JOIN nt nb ON nb.doc_id = b.doc_id
GROUP BY a.pos, a.doc_id"""))
def q_similarity_matrix_table(spark, sf_dir):
    listed = spark.createDataFrame(list(enumerate(fx.MATRIX_DOCS)), "pos long, doc_id long")
    cells = sm.cosine_matrix(_indexed(spark, sf_dir), listed)
    return sm.similarity_matrix_table(cells, len(fx.MATRIX_DOCS), row_label="doc_a")

# ============================================================ Naive Bayes


def _nb_sql(labelled_sql: str, target_sql: str) -> str:
    """CTEs: cls(doc_id, class) from ``labelled_sql`` (doc_id, category); pred(doc_id, predicted)
    for the documents of ``target_sql`` (doc_id)."""
    return f""",
cls AS (SELECT DISTINCT doc_id, unnest({analyze_sql('category')}) AS class FROM ({labelled_sql})),
dd AS (SELECT count(DISTINCT doc_id)::DOUBLE AS d FROM cls),
uu AS (SELECT count(*)::DOUBLE / count(DISTINCT doc_id) AS u FROM post),
cs AS (SELECT class, count(DISTINCT doc_id)::BIGINT AS n_docs,
              ln(count(DISTINCT doc_id)) - ln((SELECT d FROM dd)) AS log_prior,
              ln((SELECT u FROM uu) * count(DISTINCT doc_id) + (SELECT d FROM dd)) AS log_den
       FROM cls GROUP BY class),
hits AS (SELECT c.class, p.term, count(*)::BIGINT AS hits FROM post p JOIN cls c ON c.doc_id = p.doc_id
         GROUP BY c.class, p.term),
tgt AS ({target_sql}),
part AS (SELECT p.doc_id, h.class, sum(p.tf * ln(h.hits + 1.0)) AS s
         FROM post p JOIN hits h ON h.term = p.term WHERE p.doc_id IN (SELECT doc_id FROM tgt)
         GROUP BY p.doc_id, h.class),
dl AS (SELECT doc_id, len(terms) AS n FROM tok WHERE doc_id IN (SELECT doc_id FROM tgt)),
sc AS (SELECT dl.doc_id, cs.class, cs.log_prior - dl.n * cs.log_den + coalesce(part.s, 0) AS score
       FROM dl CROSS JOIN cs LEFT JOIN part ON part.doc_id = dl.doc_id AND part.class = cs.class),
pred AS (SELECT doc_id, class AS predicted FROM (
           SELECT doc_id, class, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, class) AS rn FROM sc)
         WHERE rn = 1)"""


_LANG_SQL = "SELECT doc_id, lang AS category FROM documents"
_ALL_SQL = "SELECT doc_id FROM documents"


def _lang_model(spark, sf_dir, post):
    d = _docs(spark, sf_dir)
    return nb.nb_train(post, d.select("doc_id", F.col("lang").alias("category")))


@query("nb_train", with_corpus(_nb_sql(_LANG_SQL, _ALL_SQL) + """
SELECT h.class, h.term, h.hits, cs.n_docs, round(cs.log_prior, 6) AS log_prior, round(cs.log_den, 6) AS log_den
FROM hits h JOIN cs ON cs.class = h.class"""))
def q_nb_train(spark, sf_dir):
    m = _lang_model(spark, sf_dir, _indexed(spark, sf_dir))
    return m.class_terms.join(m.classes, "class").select(
        "class", "term", "hits", "n_docs", _r6(F.col("log_prior")).alias("log_prior"),
        _r6(F.col("log_den")).alias("log_den"))


@query("nb_classify", with_corpus(_nb_sql(_LANG_SQL, _ALL_SQL) + "\nSELECT doc_id, predicted FROM pred"))
def q_nb_classify(spark, sf_dir):
    post = _indexed(spark, sf_dir)
    return nb.nb_classify(post, _docs(spark, sf_dir), _lang_model(spark, sf_dir, post)).select("doc_id", "predicted")


_QUALITY_SQL = ("SELECT d.doc_id, l.quality::VARCHAR AS category FROM documents d "
                "JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL")
_UNLABELLED_SQL = ("SELECT doc_id FROM documents WHERE doc_id NOT IN "
                   "(SELECT doc_id FROM labels WHERE quality IS NOT NULL)")


@query("nb_label_unlabelled", with_corpus(_nb_sql(_QUALITY_SQL, _UNLABELLED_SQL) + "\nSELECT doc_id, predicted FROM pred"))
def q_nb_label_unlabelled(spark, sf_dir):
    d = _docs(spark, sf_dir)
    labels = fx.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("category"))
    lab = d.select("doc_id").join(labels, "doc_id", "left")
    return nb.nb_label_unlabelled(_indexed(spark, sf_dir), d, lab).select("doc_id", "predicted")


_CATS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({sql_str(c)})" for c in fx.CATEGORIES) + ") AS v(c)"
_CM_SQL = _nb_sql(_LANG_SQL, _ALL_SQL) + f""",
cm AS (SELECT a.c AS actual, p.c AS predicted, count(x.doc_id)::BIGINT AS n
       FROM ({_CATS_SQL}) a CROSS JOIN ({_CATS_SQL}) p
       LEFT JOIN (SELECT pred.doc_id, lower(d.lang) AS actual, pred.predicted FROM pred
                  JOIN documents d ON d.doc_id = pred.doc_id) x
         ON x.actual = a.c AND x.predicted = p.c
       GROUP BY 1, 2)"""


def _lang_confusion(spark, sf_dir):
    post = _indexed(spark, sf_dir)
    d = _docs(spark, sf_dir)
    pred = nb.nb_classify(post, d, _lang_model(spark, sf_dir, post))
    return nb.confusion_matrix(pred, d.select("doc_id", F.col("lang").alias("category")), fx.CATEGORIES)


@query("confusion_matrix", with_corpus(_CM_SQL + "\nSELECT * FROM cm"))
def q_confusion_matrix(spark, sf_dir):
    return _lang_confusion(spark, sf_dir)


@query("accuracy_error", with_corpus(_CM_SQL + """
SELECT sum(n)::BIGINT AS total, sum(CASE WHEN actual = predicted THEN n ELSE 0 END)::BIGINT AS correct,
       CASE WHEN sum(n) = 0 THEN NULL ELSE sum(CASE WHEN actual = predicted THEN n ELSE 0 END) / sum(n) END AS accuracy,
       CASE WHEN sum(n) = 0 THEN NULL ELSE sum(CASE WHEN actual <> predicted THEN n ELSE 0 END) / sum(n) END AS error_rate
FROM cm"""))
def q_accuracy_error(spark, sf_dir):
    return nb.accuracy_error(_lang_confusion(spark, sf_dir))

# ============================================================ sources and sinks (round trips)

from ..functions import columns as fc  # noqa: E402
from ..plans import jobs  # noqa: E402
from ..sources import files as fl  # noqa: E402
from ..sources import tables as tb  # noqa: E402
from ..streaming import terms as stm  # noqa: E402


@query("read_delimited_records", """
SELECT doc_id::VARCHAR AS doc_id, text, lang, source, n_chars::VARCHAR AS n_chars FROM documents""")
def q_read_delimited_records(spark, sf_dir):
    path = scratch_path(spark, "records")
    fl.write_delimited(_docs(spark, sf_dir), path)
    return fl.read_delimited_records(spark, path, multi_line=True)  # texts hold line breaks


@query("union_sheets", """
SELECT doc_id::VARCHAR AS doc_id, text, lang, CASE WHEN lang = 'es' THEN NULL ELSE source END AS source,
       n_chars::VARCHAR AS n_chars FROM documents""")
def q_union_sheets(spark, sf_dir):
    d = _docs(spark, sf_dir)
    base = scratch_path(spark, "sheets")
    paths = []
    # a sheet for each language of the data (sheets are named things: few); 'es' has no source column
    for i, (lang,) in enumerate(sorted(d.select("lang").distinct().collect(), key=str)):
        p = f"{base}/{i}"
        sheet = d.where(F.col("lang").eqNullSafe(lang))
        fl.write_delimited(sheet.drop("source") if lang == "es" else sheet, p)
        paths.append(p)
    return fl.union_sheets(spark, paths, multi_line=True).select("doc_id", "text", "lang", "source", "n_chars")


@query("read_keywords", "SELECT lower(p_type) AS keyword FROM part")
def q_read_keywords(spark, sf_dir):
    path = scratch_path(spark, "keywords")
    fl.write_keywords(fx.table(spark, sf_dir, "part"), "p_type", path)
    return fl.read_keywords(spark, path)


@query("read_bug_reports", f"""
SELECT doc_id::VARCHAR AS id, coalesce({title_sql('text')}, '') AS title, coalesce(source, '') AS commit_notes
FROM documents""")
def q_read_bug_reports(spark, sf_dir):
    path = scratch_path(spark, "bugreports")
    t = fx.tickets(spark, sf_dir).select("id", "title", "commit_notes", F.lit("x").alias("extra"))
    fl.write_delimited(t, path)
    return fl.read_bug_reports(spark, path, multi_line=True)


_TOP_SQL = f"""SELECT row_number() OVER (ORDER BY df DESC, term)::BIGINT AS rank, term, df FROM dfs
WHERE df::DOUBLE > {fx.TOP_CUTOFF} * (SELECT max(df) FROM dfs) OR df = (SELECT max(df) FROM dfs)
ORDER BY df DESC, term LIMIT {fx.TOP_N}"""


@query("write_report_table", with_corpus(f"""
SELECT rank::VARCHAR AS rank, term, df::VARCHAR AS df FROM ({_TOP_SQL})"""))
def q_write_report_table(spark, sf_dir):
    path = scratch_path(spark, "report")
    fl.write_report_table(st.top_terms(_post(spark, sf_dir), fx.TOP_CUTOFF, fx.TOP_N), path)
    return fl.read_delimited_records(spark, path)


@query("write_text_report", with_corpus(f"""
SELECT rank::VARCHAR || ':' || term || '(' || df::VARCHAR || ');' AS value FROM ({_TOP_SQL})"""))
def q_write_text_report(spark, sf_dir):
    path = scratch_path(spark, "text-report")
    top = st.top_terms(_post(spark, sf_dir), fx.TOP_CUTOFF, fx.TOP_N)
    fl.write_text_report(top.select(F.format_string("%d:%s(%d);", "rank", "term", "df").alias("line")), path)
    return fl.read_text_report(spark, path)


_UPD = [(b, f"UPDATED {b}") for b in fx.LOOKUP_BRANDS]
_UPD_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({sql_str(k)}, {sql_str(v)})" for k, v in _UPD) + ") AS u(key, data)"


@query("update_cell_by_key", f"""
WITH firsts AS (SELECT p_brand, min(p_partkey) AS p_partkey FROM part
                WHERE p_brand IN (SELECT key FROM ({_UPD_SQL})) GROUP BY p_brand)
SELECT p.p_partkey, p.p_name, p.p_brand, coalesce(u.data, p.p_type) AS p_type, p.p_size, p.p_retailprice
FROM part p LEFT JOIN firsts f ON f.p_brand = p.p_brand AND f.p_partkey = p.p_partkey
LEFT JOIN ({_UPD_SQL}) u ON u.key = f.p_brand""")
def q_update_cell_by_key(spark, sf_dir):
    upd = spark.createDataFrame(_UPD, "key string, data string")
    return tb.update_cell_by_key(fx.table(spark, sf_dir, "part"), "p_brand", "p_type", upd, "p_partkey")

# ============================================================ projections, filters, scalar columns


@query("field_value_sets", """
SELECT DISTINCT field, value FROM (
  SELECT 'p_partkey' AS field, p_partkey::VARCHAR AS value FROM part UNION ALL
  SELECT 'p_brand', p_brand FROM part UNION ALL
  SELECT 'p_type', p_type FROM part UNION ALL
  SELECT 'p_size', p_size::VARCHAR FROM part UNION ALL
  SELECT 'p_retailprice', p_retailprice::VARCHAR FROM part UNION ALL
  SELECT 'p_name', p_name FROM part)
WHERE value IS NOT NULL AND value <> ''""")
def q_field_value_sets(spark, sf_dir):
    return tb.field_value_sets(fx.table(spark, sf_dir, "part"))


@query("key_value_lists", """
SELECT p_brand AS key, p_type AS value, count(*)::BIGINT AS n FROM part GROUP BY 1, 2""")
def q_key_value_lists(spark, sf_dir):
    return tb.key_value_lists(fx.table(spark, sf_dir, "part"), "p_brand", "p_type")


@query("first_row_matching", f"""
SELECT k.key, coalesce(min(p.p_partkey), -1)::BIGINT AS row_id
FROM ({values_sql('key', fx.LOOKUP_BRANDS)}) k LEFT JOIN part p ON p.p_brand = k.key GROUP BY k.key""")
def q_first_row_matching(spark, sf_dir):
    keys = spark.createDataFrame([(b,) for b in fx.LOOKUP_BRANDS], "key string")
    return tb.first_row_matching(fx.table(spark, sf_dir, "part"), "p_brand", keys, "p_partkey")


@query("normalise_cells", """
SELECT o_orderkey::VARCHAR AS o_orderkey, coalesce(o_custkey::VARCHAR, '') AS o_custkey, coalesce(o_orderstatus, '') AS o_orderstatus,
       coalesce(o_totalprice::VARCHAR, '') AS o_totalprice, coalesce(strftime(o_orderdate, '%m-%d-%Y'), '') AS o_orderdate,
       coalesce(o_orderpriority, '') AS o_orderpriority,
       coalesce(CASE WHEN o_orderstatus = 'F' THEN 'true' WHEN o_orderstatus IS NOT NULL THEN 'false' END, '') AS is_final
FROM orders""")
def q_normalise_cells(spark, sf_dir):
    return fc.normalise_cells(fx.table(spark, sf_dir, "orders").withColumn("is_final", F.col("o_orderstatus") == "F"))


@query("lowercase_values", "SELECT p_partkey, lower(p_type) AS value FROM part")
def q_lowercase_values(spark, sf_dir):
    p = fx.table(spark, sf_dir, "part")
    return p.select("p_partkey", fc.lowercase_values("p_type").alias("value"))


@query("include_filter", f"""
SELECT p_partkey, p_type FROM part WHERE p_type IN ({", ".join(sql_str(t) for t in fx.TYPE_FILTER)})""")
def q_include_filter(spark, sf_dir):
    vals = spark.createDataFrame([(t,) for t in fx.TYPE_FILTER], "value string")
    return tb.include_filter(fx.table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", vals)


@query("exclude_filter", f"""
SELECT p_partkey, p_type FROM part WHERE p_type NOT IN ({", ".join(sql_str(t) for t in fx.TYPE_FILTER)})""")
def q_exclude_filter(spark, sf_dir):
    vals = spark.createDataFrame([(t,) for t in fx.TYPE_FILTER], "value string")
    return tb.exclude_filter(fx.table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", vals)


@query("decode_urls", "SELECT doc_id, text AS decoded FROM documents")
def q_decode_urls(spark, sf_dir):
    # each whole text URL-encoded, then decoded back
    d = _docs(spark, sf_dir).select("doc_id", F.url_encode("text").alias("url"))
    return d.select("doc_id", fc.decode_url("url").alias("decoded"))


_DAMAGED = "CASE WHEN o_orderkey % 10 = 3 THEN replace(s, '-', '/') ELSE s END"


@query("parse_dates", f"""
SELECT o_orderkey, {_DAMAGED} AS date_text, try_strptime({_DAMAGED}, '%m-%d-%Y')::DATE::VARCHAR AS parsed
FROM (SELECT o_orderkey, strftime(o_orderdate, '%m-%d-%Y') AS s FROM orders)""")
def q_parse_dates(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", fc.format_date("o_orderdate").alias("s"))
    # every tenth order's text is damaged ('/' separators) and must parse to NULL
    o = o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 3, F.regexp_replace("s", "-", "/"))
                 .otherwise(F.col("s")).alias("date_text"))
    # parsed DATE compared as its ISO text
    return o.select("o_orderkey", "date_text", fc.parse_date("date_text").cast("string").alias("parsed"))


@query("format_dates", "SELECT o_orderkey, strftime(o_orderdate, '%m-%d-%Y') AS date_text FROM orders")
def q_format_dates(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", fc.format_date("o_orderdate").alias("date_text"))

# ============================================================ jobs and streams


@query("bug_report_job", with_corpus(_LISTED_SQL + f""",
{_DETAIL_SQL},
summary AS (SELECT row_number() OVER w::BIGINT AS rank, ldfs.term AS keyword, ldfs.df AS n_reports,
                   coalesce(n_new, 0)::BIGINT AS n_new, sum(coalesce(n_new, 0)) OVER w / (SELECT n FROM ndocs) AS share
            FROM ldfs LEFT JOIN newc ON newc.term = ldfs.term
            WINDOW w AS (ORDER BY ldfs.df DESC, ldfs.term ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT 'detail' AS sheet, concat_ws('|', id::VARCHAR, coalesce(title, ''), keyword) AS cells FROM detail
UNION ALL SELECT 'summary', concat_ws('|', rank::VARCHAR, keyword, n_reports::VARCHAR, n_new::VARCHAR,
                                      (round(share * 1000000)::BIGINT)::VARCHAR) FROM summary
UNION ALL SELECT 'totals', concat_ws('|', (SELECT count(*) FROM ldfs)::VARCHAR, (SELECT n FROM ndocs)::VARCHAR)"""))
def q_bug_report_job(spark, sf_dir):
    paths = jobs.bug_report_job(spark, _docs(spark, sf_dir), fx.keyword_list(spark), scratch_path(spark, "bugreport"))
    cells = jobs.sheet_cells(spark, paths)
    # the summary's share, a fraction in the sheet, is compared in millionths
    share = F.round(F.substring_index("cells", "|", -1).cast("double") * 1000000).cast("long").cast("string")
    return cells.select("sheet", F.when(F.col("sheet") == "summary", F.concat_ws(
        "|", F.substring_index("cells", "|", 4), share)).otherwise(F.col("cells")).alias("cells"))


def _doc_files(spark, sf_dir, name, n_files=4):
    """The corpus split into several files so a stream sees several micro-batches."""
    path = scratch_path(spark, name)
    _docs(spark, sf_dir).repartition(n_files, "doc_id").write.parquet(path)
    return path


@query("stream_term_doc_freq", with_corpus("SELECT term, df FROM dfs"))
def q_stream_term_doc_freq(spark, sf_dir):
    src = _doc_files(spark, sf_dir, "stream-docs")
    schema = _docs(spark, sf_dir).schema
    return stm.run_term_doc_freq(spark, src, schema, scratch_path(spark, "stream-df"))


@query("stream_keyword_tagging", f"WITH {_DETAIL_SQL}\nSELECT id, title, keyword FROM detail")
def q_stream_keyword_tagging(spark, sf_dir):
    src = _doc_files(spark, sf_dir, "stream-tickets")
    schema = _docs(spark, sf_dir).schema
    return stm.run_keyword_tagging(spark, src, schema, fx.keyword_list(spark), scratch_path(spark, "stream-tag"))
