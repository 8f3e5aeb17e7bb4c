"""Ranked retrieval as joins (Q1–Q6).

Scoring is the classic vector-space score of the original index:

* one term:  sqrt(tf) · idf · norm(doc_len)
* OR query:  coord · queryNorm · Σ_t sqrt(tf) · idf² · norm(doc_len)
  with coord = matched/|q|, queryNorm = 1/sqrt(Σ_q idf²); query terms absent
  from the corpus have df = 0 and still count in |q| and queryNorm.

``norm`` is read from the postings row (doc_len is carried there), so a search
is one broadcast join of the (small) query-term table against the postings,
one partial/final aggregate per document, and a top-N (TakeOrdered, or a
window group-limit per keyword that Spark applies before the shuffle).
The postings need not be those of all terms: :func:`index.listed_postings` gives those of
the query's terms and analyses only texts that can have one.
Scores are rounded to 6 decimals before ordering so ties are decided by
doc_id identically in every engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, TOKEN_PATTERN, analyze, idf, length_norm, tf_weight
from .stats import doc_freqs, n_docs

SCORE_DECIMALS = 6


def keyword_terms(keywords: DataFrame, col: str = "keyword", pattern: str = TOKEN_PATTERN,
                  stop=STOP_WORDS) -> DataFrame:
    """(keyword, term): each keyword run through the analyser; a multi-word
    keyword becomes an OR of its terms.  Keywords are de-duplicated."""
    stop = tuple(stop)
    return (keywords.select(F.col(col).alias("keyword")).where(F.col("keyword").isNotNull()).distinct()
            .select("keyword", F.explode(F.array_distinct(analyze("keyword", pattern, stop))).alias("term")))


def _scored(post: DataFrame, docs: DataFrame, kw_terms: DataFrame, quantized: bool = True) -> DataFrame:
    """(keyword, doc_id, score, matched) for every document matching ≥ 1 term of a keyword."""
    # the planner broadcasts the query side where its size allows
    kt = kw_terms.select("keyword", "term")
    qt = kw_terms.select("term").distinct()
    # df only for the query terms: semi-join first, then aggregate
    qdf = doc_freqs(post.join(qt, "term", "left_semi"))
    # per-keyword norms ride on the same table (a window over one keyword's terms)
    per_kw = Window.partitionBy("keyword")
    stats = (kt.join(qdf, "term", "left")
             .withColumn("idf", idf(F.coalesce("df", F.lit(0)), n_docs(docs)))
             .withColumn("n_q", F.count(F.lit(1)).over(per_kw))
             .withColumn("qnorm", F.lit(1.0) / F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(per_kw))))
    hits = post.join(stats.select("keyword", "term", "idf", "n_q", "qnorm"), "term")
    contrib = tf_weight("tf") * F.col("idf") * F.col("idf") * length_norm("doc_len", quantized)
    agg = hits.groupBy("keyword", "doc_id").agg(
        F.sum(contrib).alias("_s"), F.count(F.lit(1)).alias("matched"),
        F.max("n_q").alias("n_q"), F.max("qnorm").alias("qnorm"))
    return agg.select("keyword", "doc_id",
                      F.round(F.col("matched") / F.col("n_q") * F.col("qnorm") * F.col("_s"),
                              SCORE_DECIMALS).alias("score"),
                      "matched")


def single(spark, keyword: str) -> DataFrame:
    """A keyword table of one keyword."""
    return spark.createDataFrame([(keyword,)], "keyword string")


def search_any_term(post: DataFrame, docs: DataFrame, terms: DataFrame, top_n: int = 100,
                    quantized: bool = True) -> DataFrame:
    """Q2: OR of the terms in ``terms.term``, ranked: (rank 0-based, doc_id, score)."""
    kt = terms.select(F.lit("q").alias("keyword"), "term").distinct()
    s = _scored(post, docs, kt, quantized)
    top = s.orderBy(F.desc("score"), F.asc("doc_id")).limit(int(top_n))
    w = Window.orderBy(F.desc("score"), F.asc("doc_id"))  # ≤ top_n rows
    return top.select((F.row_number().over(w) - 1).cast("long").alias("rank"), "doc_id", "score")


def search_keyword(post: DataFrame, docs: DataFrame, keyword: str, top_n: int = 100,
                   quantized: bool = True) -> DataFrame:
    """Q1: rank documents for one keyword (analysed like the text; several
    words become an OR query).  (rank 0-based, doc_id, score)."""
    spark = post.sparkSession
    kt = keyword_terms(single(spark, keyword)).select("term")
    return search_any_term(post, docs, kt, top_n, quantized)


def search_in_id_order(post: DataFrame, docs: DataFrame, terms: DataFrame, top_n: int = 100,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Q3: the top-N hits' stored text, in document-id order, one trailing
    line break removed.  Scores are dropped, as in the original."""
    hits = search_any_term(post, docs, terms, top_n).select("doc_id")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                    F.regexp_replace(F.col(text_col), r"(\r\n|\n|\r)\z", "").alias("text"))
    return d.join(hits, "doc_id").orderBy("doc_id")


def search_results_table(post: DataFrame, docs: DataFrame, keyword: str, top_n: int = 100,
                         id_col: str = "doc_id", fields: Sequence[str] = ("text",)) -> DataFrame:
    """Q4: (rank, score, doc_id, the chosen stored fields, matched) — matched = hits returned."""
    hits = search_keyword(post, docs, keyword, top_n)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(f) for f in fields if f != "doc_id"])
    return (hits.join(d, "doc_id")
            .withColumn("matched", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).cast("long"))
            .select("rank", "score", "doc_id", *[f for f in fields if f != "doc_id"], "matched"))


def best_doc_for_term(post: DataFrame, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Q5: for each term (analysed like the text), the doc of its best hit; terms
    without hits give no row.  max_by is a partial/final aggregate, so a hot
    term is reduced before the shuffle."""
    kt = keyword_terms(terms, "term")
    s = _scored(post, docs, kt)
    return (s.groupBy("keyword")
            .agg(F.max_by("doc_id", F.struct(F.col("score"), -F.col("doc_id"))).alias("doc_id"))
            .select(F.col("keyword").alias("term"), "doc_id"))


def batch_search(post: DataFrame, docs: DataFrame, keywords: DataFrame, top_n: int = 100,
                 col: str = "keyword") -> DataFrame:
    """Q6: Q1 for a whole table of keywords at once.

    (keyword, rank 0-based, doc_id, score).  ``row_number() <= N`` per keyword
    is planned with a partial window group-limit before the shuffle, so a
    keyword matching a third of the corpus ships at most N rows per task."""
    kt = keyword_terms(keywords, col)
    s = _scored(post, docs, kt)
    w = Window.partitionBy("keyword").orderBy(F.desc("score"), F.asc("doc_id"))
    return (s.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= int(top_n))
            .select("keyword", (F.col("_rn") - 1).cast("long").alias("rank"), "doc_id", "score"))
