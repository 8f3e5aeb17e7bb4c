"""The postings as a table laid out by term (S3): bucketed and sorted, for queries that go through all terms.

A saved index (:func:`index.save_index`) serves lookups.  Document frequencies, weights and class counts
of all terms group or join all postings by term, each with a shuffle of them.  This table is shuffled
once, when it is written: rows are hashed by (term, part) into buckets and sorted in them, and Spark's
planner knows it, so that grouping by (term, part) and joining on them read the buckets as they are.

``part`` keeps a frequent term from being one task's work: it is a hash of the document id in as many parts as
keep each part of a term, at most one row for each document, at about ``PART_ROWS`` rows.  Up to that many
documents there is one part.  Sums by term go over rows of (term, part), not over postings.

The layout is recorded beside the table, so that another session can open it (:func:`open_term_table`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import idf, tf_weight
from .index import POSTINGS_SCHEMA
from .ordering import cut

#: documents for each part of a term, and rows of a bucket, about
PART_ROWS = 20_000_000
BUCKET_ROWS = 20_000_000
#: characters of text for each posting, at the least: one of the term and one after it
POSTING_CHARS = 2

KEY = ("term", "part")


def enough_buckets(docs: DataFrame, text_col: str = "text") -> int:
    """Buckets for the postings of ``docs``, from the length of their texts: none gets more than ``BUCKET_ROWS`` rows on
    average, and the postings need not be made and written once more to count them."""
    chars = docs.agg(F.coalesce(F.sum(F.length(text_col).cast("long")), F.lit(0))).first()[0]
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // (POSTING_CHARS * BUCKET_ROWS)))


def save_term_table(post: DataFrame, n_docs: int, path: str, buckets: int | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Write postings to ``path`` by term and open them.  ``n_docs`` sizes the parts, ``buckets`` (default: by the number
    of postings, which are written once more to count them, the session's shuffle partitions at least; see
    :func:`enough_buckets`) the tasks that later read it."""
    spark = post.sparkSession
    parts = max(1, -(-n_docs // part_rows))
    if buckets is None:
        post = cut(post)
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-post.count() // BUCKET_ROWS))
    rows = post.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    name = f"term_table_{uuid.uuid4().hex}"
    # dealt by the same hash as the buckets, so each task writes one whole bucket
    (rows.repartition(buckets, *KEY).sortWithinPartitions(*KEY, "doc_id")
     .write.format("parquet").bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name))
    spark.createDataFrame([(buckets, parts)], "buckets int, parts int").coalesce(1).write.mode("overwrite").json(f"{path}-layout")
    return spark.table(name)


def open_term_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`save_term_table` wrote to ``path``, in any session."""
    buckets = spark.read.schema("buckets int, parts int").json(f"{path}-layout").first().buckets
    name = f"term_table_{uuid.uuid4().hex}"
    where = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({POSTINGS_SCHEMA}, part int) USING parquet LOCATION '{where}' "
              f"CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(KEY)}) INTO {buckets} BUCKETS")
    return spark.table(name)


def part_counts(table: DataFrame) -> DataFrame:
    """(term, part, n): postings of each part of each term.  No shuffle."""
    return table.groupBy(*KEY).agg(F.count(F.lit(1)).cast("long").alias("n"))


def table_doc_freqs(table: DataFrame) -> DataFrame:
    """(term, df) from the rows of :func:`part_counts`."""
    return part_counts(table).groupBy("term").agg(F.sum("n").alias("df"))


def _part_dfs(table: DataFrame) -> DataFrame:
    """(term, part, df): the document frequency of its term for every part; written."""
    counts = cut(part_counts(table))
    return cut(counts.select(*KEY).join(cut(counts.groupBy("term").agg(F.sum("n").alias("df"))), "term").select(*KEY, "df"))


def table_df_tf_listing(table: DataFrame) -> DataFrame:
    """A8 from the table: (term, df, doc_id, tf).  Only the frequencies are shuffled, to the postings' buckets."""
    return table.join(_part_dfs(table), list(KEY)).select("term", "df", "doc_id", "tf")


def table_tfidf_weights(table: DataFrame, n_docs: int) -> DataFrame:
    """A10 from the table: (doc_id, term, tf, idf, weight), shuffled alike."""
    dfs = _part_dfs(table).withColumn("idf", idf("df", F.lit(n_docs)))
    return table.join(dfs, list(KEY)).select("doc_id", "term", "tf", "idf", (tf_weight("tf") * F.col("idf")).alias("weight"))
