"""Coverage and keyword reports.

Coverage: walking terms in (df desc, term asc) order, a document is "newly
covered" by the first term it contains.  That first term is simply the
per-document minimum of (−df, term), instead of the original's loop of searches
over a driver-side bit set.  It is found in two phases: the ``TOP`` leading terms
travel as a list, in order, and the first of them that a document has is found in the
document's own row.  They cover most documents; only terms of documents that have none of
them are shuffled and joined with all frequencies.  The running share over the whole
vocabulary uses :func:`ordering.running_totals`, never a one-task window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import keyword_matches
from .ordering import cut, running_totals
from .stats import n_docs

#: leading terms that are looked for in the row
TOP = 256


def term_sets(post: DataFrame) -> DataFrame:
    """(doc_id, terms): the distinct terms of each document that has any, one row each."""
    return post.groupBy("doc_id").agg(F.collect_list("term").alias("terms"))  # the terms of one document


def set_doc_freqs(sets: DataFrame) -> DataFrame:
    """(term, df) from the documents' distinct terms."""
    return (sets.select(F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())
            .groupBy("term").agg(F.count(F.lit(1)).cast("long").alias("df")))


def first_covers(sets: DataFrame, dfs: DataFrame, top: int = TOP) -> DataFrame:
    """(term, n_new): documents whose first covering term (in df-desc, term-asc order) is ``term``.
    ``sets`` (see :func:`term_sets`) is read twice, ``dfs`` is written (see :func:`ordering.cut`)."""
    leading = [r.term for r in dfs.orderBy(F.desc("df"), F.asc("term")).limit(top).collect()]
    order = F.array(*[F.lit(t) for t in leading]).cast("array<string>")
    rows = sets.select("doc_id", "terms", F.get(F.array_intersect(order, "terms"), F.lit(0)).alias("first"))
    near = rows.where(F.col("first").isNotNull()).select(F.col("first").alias("term"))
    rest = (rows.where(F.col("first").isNull()).select("doc_id", F.explode_outer("terms").alias("term"))
            .join(dfs, "term").groupBy("doc_id")
            .agg(F.min(F.struct((-F.col("df")).alias("k"), F.col("term"))).getField("term").alias("term")).select("term"))
    return near.unionByName(rest).groupBy("term").agg(F.count(F.lit(1)).cast("long").alias("n_new"))


def _covered(sets: DataFrame, dfs: DataFrame, docs: DataFrame) -> DataFrame:
    """(rank, term, df, n_new, covered, covered_share) of every term of ``dfs``."""
    rows = dfs.join(first_covers(sets, dfs), "term", "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    ranked = running_totals(rows, [F.desc("df"), F.asc("term")], {"covered": "n_new"})
    return ranked.select(F.col("rank").cast("long").alias("rank"), "term", "df", "n_new",
                         F.col("covered").cast("long").alias("covered"),
                         (F.col("covered") / n_docs(docs)).alias("covered_share"))


def term_distribution(post: DataFrame, docs: DataFrame) -> DataFrame:
    """(rank, term, df, n_new, covered, covered_share) for every term."""
    return term_distribution_of_sets(term_sets(post), docs)


def term_distribution_of_sets(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """R1 from the documents' distinct terms (:func:`term_sets`, or analysed documents): no posting is shuffled
    but as a partial count by term, and those of documents without a leading term."""
    sets = cut(sets)
    return _covered(sets, cut(set_doc_freqs(sets)), docs)


def _listed(post: DataFrame, keywords: DataFrame) -> DataFrame:
    """Postings of listed terms (the planner broadcasts the list if its size allows)."""
    return post.join(keywords.select(F.col("keyword").alias("term")).distinct(), "term", "left_semi")


def keyword_summary_report(post: DataFrame, docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """R2: keywords that occur as terms, in df order: (rank, keyword,
    n_reports, n_new_covered, pct_total_covered).  Multi-word keywords never
    match a single term (as in the original)."""
    sets = cut(term_sets(_listed(post, keywords)))
    return _covered(sets, cut(set_doc_freqs(sets)), docs).select(
        "rank", F.col("term").alias("keyword"), F.col("df").alias("n_reports"), F.col("n_new").alias("n_new_covered"),
        F.col("covered_share").alias("pct_total_covered"))


def keyword_report_totals(post: DataFrame, docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """First header line — matched keywords (listed terms present) and total reports."""
    matched = _listed(post, keywords).select("term").distinct()
    return matched.agg(F.count(F.lit(1)).cast("long").alias("matched_keywords")).select(
        "matched_keywords", n_docs(docs).cast("long").alias("total_reports"))


def keyword_detail_report(tickets: DataFrame, keywords: DataFrame) -> DataFrame:
    """Every (report, keyword occurrence) where the lower-cased title
    contains the keyword: (id, title, keyword), one row per keyword occurrence
    in the list (``keywords`` = (kw_idx, keyword), repeats allowed)."""
    return keyword_matches(tickets, keywords, "id", "title")


def report_labels(tickets: DataFrame, detail: DataFrame) -> DataFrame:
    """Unique labels per report, sorted; reports without a match get []."""
    labels = detail.groupBy("id").agg(F.array_sort(F.collect_set("keyword")).alias("labels"))
    return (tickets.select("id").join(labels, "id", "left")
            .select("id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels")))

