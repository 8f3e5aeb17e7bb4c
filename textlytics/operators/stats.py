"""Corpus statistics and term vectors.

Inputs are the corpus (``docs``) and its postings ``post`` =
(doc_id, term, tf, doc_len, doc_terms) from :func:`operators.index.postings`.
Term-level results are vocabulary-sized: they are never broadcast blindly and
never ranked with an unpartitioned window (see :mod:`.ordering`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import idf as idf_expr
from ..functions.text import tf_weight
from .index import analyzed_docs
from .ordering import cut, running_totals

# ---------------------------------------------------------------- scalars


def n_docs(docs: DataFrame) -> Column:
    """Corpus size as a scalar sub-query column (docs without terms count too)."""
    return docs.select(F.count(F.lit(1))).scalar()


def total_docs(docs: DataFrame) -> DataFrame:
    """A1: number of documents in the corpus."""
    return docs.agg(F.count(F.lit(1)).cast("long").alias("total_docs"))

# ---------------------------------------------------------------- term tables


def doc_freqs(post: DataFrame) -> DataFrame:
    """(term, df): documents containing each term (partial + final hash agg)."""
    return post.groupBy("term").agg(F.count(F.lit(1)).cast("long").alias("df"))


def terms_by_doc_freq(post: DataFrame) -> DataFrame:
    """A4: every term, df descending, ties in term byte order (distributed sort)."""
    return doc_freqs(post).orderBy(F.desc("df"), F.asc("term"))


def listed_terms_by_doc_freq(post: DataFrame, terms: DataFrame) -> DataFrame:
    """A5: A4 kept to an include list (``terms`` has a ``term`` column).

    The list is semi-joined *before* the aggregate so only listed postings are
    counted."""
    listed = post.join(terms.select("term").distinct(), "term", "left_semi")
    return doc_freqs(listed).orderBy(F.desc("df"), F.asc("term"))


def top_terms(post: DataFrame, cutoff: float = 0.1, n: int = 100) -> DataFrame:
    """(rank, term, df) — leading terms while df/df_top > cutoff and fewer
    than n; the first term is always kept.  Sorted list ⇒ "stop at the first
    failure" is a filter; the limit is a per-partition top-k (TakeOrdered)."""
    keep = max(int(n), 1) if cutoff < 1 else 1
    dfs = doc_freqs(post)
    top = dfs.select(F.max("df")).scalar()
    cand = dfs.where((F.col("df").cast("double") > F.lit(float(cutoff)) * top) | (F.col("df") == top))
    best = cand.orderBy(F.desc("df"), F.asc("term")).limit(keep)
    # at most `keep` rows remain: a single-partition window is bounded here
    w = Window.orderBy(F.desc("df"), F.asc("term"))
    return best.select(F.row_number().over(w).cast("long").alias("rank"), "term", "df")


def top_terms_cutoff(post: DataFrame, cutoff: float = 0.1) -> DataFrame:
    """Every term with df/df_top > cutoff, sorted; the first in (df descending, term)
    order is always kept, so with a cutoff of 1 or more it is the only one."""
    return leading_terms(doc_freqs(post), cutoff)


def leading_terms(dfs: DataFrame, cutoff: float = 0.1) -> DataFrame:
    """A7 from (term, df)."""
    dfs = cut(dfs)  # read three times
    first = dfs.select(F.min(F.struct((-F.col("df")).alias("k"), "term")).alias("f"))
    top = first.select((-F.col("f.k")).alias("top")).scalar()
    return (dfs.where((F.col("df").cast("double") > F.lit(float(cutoff)) * top)
                      | (F.col("term") == first.select("f.term").scalar()))
            .orderBy(F.desc("df"), F.asc("term")))


def doc_freq(post: DataFrame, terms: DataFrame) -> DataFrame:
    """A2: df for a table of terms, 0 when absent."""
    q = terms.select("term").distinct()
    hits = doc_freqs(post.join(q, "term", "left_semi"))
    return q.join(hits, "term", "left").select("term", F.coalesce("df", F.lit(0)).cast("long").alias("df"))


def term_freq(post: DataFrame, probes: DataFrame) -> DataFrame:
    """A3: (doc_id, term) probes → tf (−1 when absent) and ``present`` (the
    original reports 1 for any present term; both are returned)."""
    p = post.select("doc_id", "term", "tf")
    return (probes.select(F.col("doc_id").cast("long").alias("doc_id"), "term")
            .join(p, ["doc_id", "term"], "left")
            .select("doc_id", "term", F.coalesce("tf", F.lit(-1)).cast("long").alias("tf"),
                    F.col("tf").isNotNull().alias("present")))


def df_tf_listing(post: DataFrame) -> DataFrame:
    """Every (term, df, doc_id, tf).  df is aggregated, then joined back on term."""
    return post.select("doc_id", "term", "tf").join(cut(doc_freqs(post)), "term").select("term", "df", "doc_id", "tf")


def idf_table(post: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = 1 + ln(N/(df+1))."""
    return doc_freqs(post).withColumn("idf", idf_expr("df", n_docs(docs)))


def tfidf_weights(post: DataFrame, docs: DataFrame) -> DataFrame:
    """A10: (doc_id, term, tf, idf, weight = sqrt(tf)·idf)."""
    return (post.select("doc_id", "term", "tf").join(cut(idf_table(post, docs).select("term", "idf")), "term")
            .select("doc_id", "term", "tf", "idf", (tf_weight("tf") * F.col("idf")).alias("weight")))


def term_dictionary(post: DataFrame) -> DataFrame:
    """A12 / vocabulary: (term_idx 0-based in term byte order, term, df)."""
    ranked = running_totals(doc_freqs(post), [F.asc("term")], rank_col="_r")
    return ranked.select((F.col("_r") - 1).alias("term_idx"), "term", "df")


def df_vector(post: DataFrame) -> DataFrame:
    """The df row over the vocabulary, (term_idx, term, df)."""
    return term_dictionary(post)


def tf_matrix(post: DataFrame) -> DataFrame:
    """The doc × vocabulary term-frequency matrix in sparse long form
    (doc_id, term_idx, term, tf); absent cells are the implicit zeros."""
    d = cut(term_dictionary(post).select("term", "term_idx"))
    return post.select("doc_id", "term", "tf").join(d, "term").select("doc_id", "term_idx", "term", "tf")

# ---------------------------------------------------------------- documents and vectors


def document_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct terms of each document in term order, computed in-row."""
    a = analyzed_docs(docs, id_col, text_col)
    return a.select("doc_id", F.array_sort(F.array_distinct("terms")).alias("terms"))


def term_vectors(post: DataFrame, weight: str = "binary", docs: DataFrame | None = None) -> DataFrame:
    """T4: each document as a sparse vector (doc_id, term, weight).

    ``binary`` (the original's behaviour: 1 for a present term), ``tf`` or
    ``tfidf`` (needs ``docs`` for N)."""
    if weight == "binary":
        return post.select("doc_id", "term", F.lit(1.0).alias("weight"))
    if weight == "tf":
        return post.select("doc_id", "term", F.col("tf").cast("double").alias("weight"))
    if weight == "tfidf":
        return tfidf_weights(post, docs).select("doc_id", "term", "weight")
    raise ValueError(f"unknown weight {weight!r}")


def restricted_term_vectors(post: DataFrame, terms: DataFrame, weight: str = "binary") -> DataFrame:
    """T5: vectors over a given term list (term, pos); other terms ignored.
    The planner broadcasts the list if its size allows."""
    v = term_vectors(post.join(terms.select("term").distinct(), "term", "left_semi"), weight)
    return v.join(terms.select("term", "pos"), "term").select("doc_id", "pos", "term", "weight")


def l1_normalize(vectors: DataFrame, norm: str | None = None) -> DataFrame:
    """Divide each document's weights by their L1 norm.  ``norm`` names a column that has it (as
    ``postings(norm=True)`` does for tf) and is dropped; without one the vectors are shuffled, and the window is
    partitioned by document, so a task holds at most one document's terms."""
    if norm is not None:
        return vectors.withColumn("weight", F.col("weight") / F.col(norm)).drop(norm)
    w = Window.partitionBy("doc_id")
    return vectors.withColumn("weight", F.col("weight") / F.sum(F.abs("weight")).over(w))
