"""How the driver's tables play the original tool's inputs.

* corpus (ID, body)           → documents(doc_id, text)
* ticket title ("Subject")    → the whole text (there is no separate subject field)
* fully labelled category     → documents.lang
* partly labelled category    → labels.quality, left-joined (NULL = unlabelled)
* key → list / first row      → part.p_brand → part.p_type, row id p_partkey
* dates                       → orders.o_orderdate
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ticket_text

# --- fixed query parameters (like the substitution values of a benchmark) ---
# Report keyword list: frequent and rare corpus words, a two-word phrase, a
# mixed-case word, a repeat and one word absent from the corpus.
KEYWORDS = ("from", "tion", "Que", "der", "ouen", "erin", "de los", "ein", "from", "qzxjv")
# Single-keyword search (driver op 2 searched one keyword, top 100).
SEARCH_KEYWORD = "ouen"
SEARCH_TOP_N = 100
# OR query terms for search_any_term (one absent term included).
OR_TERMS = ("ouen", "eau", "los", "qzxjv")
# Category list for the confusion matrix.
CATEGORIES = ("de", "en", "es", "fr")
# Top-term parameters of driver ops 4 and 5.
TOP_CUTOFF = 0.1
TOP_N = 100
PAIRWISE_TOP_N = 20
# Whole-vocabulary pairs are those of one document in so many.
PAIR_SHARE = 100
# Least cosine of the weighted all-pairs joins, and the documents of the similarity matrix.
MIN_COSINE = 0.8
MATRIX_DOCS = tuple(range(20))
# Brands looked up by first_row_matching (one absent).
LOOKUP_BRANDS = ("Brand#1", "Brand#13", "Brand#7", "Brand#99")
# p_type values for the include/exclude filters.
TYPE_FILTER = ("ECONOMY", "SMALL")
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, commit_notes) bug-report rows from the corpus."""
    d = corpus(spark, sf_dir)
    return d.select(F.col("doc_id").alias("id"), ticket_text("text").alias("title"),
                    F.col("source").alias("commit_notes"))


def keyword_list(spark: SparkSession, words=KEYWORDS) -> DataFrame:
    """(kw_idx, keyword) lower-cased, not trimmed, not de-duplicated; blank
    keywords are dropped because they would match every title."""
    df = spark.createDataFrame(list(enumerate(words)), "kw_idx long, keyword string")
    return df.select("kw_idx", F.lower("keyword").alias("keyword")).where(F.col("keyword") != "")


def term_list(spark: SparkSession, words) -> DataFrame:
    """(pos, term): an ordered list of analysed terms."""
    return spark.createDataFrame([(i, w) for i, w in enumerate(words)], "pos long, term string")
