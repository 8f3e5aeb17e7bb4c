"""Streaming forms (ST1, ST2) of incremental indexing and keyword tagging.

ST1 keeps document frequencies current while documents keep arriving:
documents → distinct terms per document (in-row) → ``groupBy(term).count()``
in Structured Streaming state.  A micro-batch writes only the terms whose count it changed, into a
folder of its own: written again from the start if the batch is repeated, and not looked at before it is
whole.  Counts only grow, so the result is each term's largest count over the whole folders; a batch that was
killed leaves the result of the one before.  Every so many batches the result so far is written as
one folder, which takes the place of those before it.  ST2 tags arriving tickets against a static
keyword list by the same join as the batch report: stateless, append mode.

Sinks are files in the given folder (on a cluster: the shared checkpoint
folder), with the stream's checkpoint next to them, so a restarted query
resumes where it stopped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import analyze, ticket_text
from ..operators.matching import keyword_matches


def term_doc_freq_stream(stream: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ST1 plan: streaming (term, df)."""
    terms = stream.select(F.col(id_col).cast("long").alias("doc_id"),
                          F.explode_outer(F.array_distinct(analyze(text_col))).alias("term"))
    return terms.where(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).cast("long").alias("df"))


def keyword_tagging_stream(stream: DataFrame, keywords: DataFrame, id_col: str = "doc_id",
                           text_col: str = "text") -> DataFrame:
    """ST2 plan: (id, title, keyword) for arriving tickets whose lower-cased
    title contains a keyword (one row per keyword occurrence in the list)."""
    t = stream.select(F.col(id_col).cast("long").alias("id"), ticket_text(text_col).alias("title"))
    return keyword_matches(t, keywords, "id", "title")


def _finish(q, timeout_s: int | None) -> None:
    """Wait for an availableNow query; a partial result is never returned."""
    try:
        if timeout_s is None:
            q.awaitTermination()
        elif not q.awaitTermination(timeout_s):  # raises what ended the query
            raise TimeoutError(f"the stream did not end within {timeout_s} s; its checkpoint can be resumed")
    finally:
        q.stop()


#: micro-batches after which the result so far is written as one folder
COMPACT_EVERY = 50


def _whole_folders(spark: SparkSession, result: str) -> dict[str, list[int]]:
    """The numbers of the folders epoch=.. and base=.. under ``result`` whose write was committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{result}/*/_SUCCESS")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"epoch": [], "base": []}
    for status in fs.globStatus(path) or []:
        kind, _, number = status.getPath().getParent().getName().partition("=")
        if kind in found:
            found[kind].append(int(number))
    return {k: sorted(v) for k, v in found.items()}


def read_term_doc_freq(spark: SparkSession, out_dir: str, upto: int | None = None) -> DataFrame:
    """The (term, df) that the stream writing to ``out_dir`` has reached: all committed batches
    (to number ``upto``).  Safe while the stream runs, and after it was killed."""
    result = os.path.join(out_dir, "result")
    whole = _whole_folders(spark, result)
    base = max((n for n in whole["base"] if upto is None or n <= upto), default=-1)
    parts = [f"{result}/base={base}"] if base >= 0 else []
    parts += [f"{result}/epoch={n}" for n in whole["epoch"] if n > base and (upto is None or n <= upto)]
    if not parts:
        return spark.createDataFrame([], DOC_FREQ_SCHEMA)
    return spark.read.schema(DOC_FREQ_SCHEMA).parquet(*parts).groupBy("term").agg(F.max("df").alias("df"))


DOC_FREQ_SCHEMA = "term string, df long"


def run_term_doc_freq(spark: SparkSession, source_path: str, schema, out_dir: str, max_files_per_trigger: int = 1000,
                      timeout_s: int | None = None, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """Run ST1 over every file now in ``source_path`` (availableNow) and return
    the final (term, df) table, see :func:`read_term_doc_freq`."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_path))
    result = os.path.join(out_dir, "result")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{result}/epoch={epoch}")
        if (epoch + 1) % compact_every == 0:
            read_term_doc_freq(spark, out_dir, epoch).write.mode("overwrite").parquet(f"{result}/base={epoch}")
            _drop_before(spark, result, epoch - compact_every)

    q = (term_doc_freq_stream(stream).writeStream.outputMode("update")
         .option("checkpointLocation", os.path.join(out_dir, "checkpoint"))
         .foreachBatch(write).trigger(availableNow=True).start())
    _finish(q, timeout_s)
    return read_term_doc_freq(spark, out_dir)


def _drop_before(spark: SparkSession, result: str, base: int) -> None:
    """Drop the folders that an earlier base stands for; those of the last interval stay for readers
    that began before the newest base was written."""
    whole = _whole_folders(spark, result)
    if base in whole["base"]:
        for kind, numbers in whole.items():
            for n in numbers:
                if n < base or kind == "epoch" and n == base:
                    path = spark._jvm.org.apache.hadoop.fs.Path(f"{result}/{kind}={n}")
                    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run_keyword_tagging(spark: SparkSession, source_path: str, schema, keywords: DataFrame,
                        out_dir: str, max_files_per_trigger: int = 1000, timeout_s: int | None = None) -> DataFrame:
    """Run ST2 over every file now in ``source_path`` into a parquet file sink
    (append) and return what the sink holds."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_path))
    result = os.path.join(out_dir, "result")
    q = (keyword_tagging_stream(stream, keywords).writeStream.outputMode("append").format("parquet")
         .option("path", result).option("checkpointLocation", os.path.join(out_dir, "checkpoint"))
         .trigger(availableNow=True).start())
    _finish(q, timeout_s)
    return spark.read.parquet(result)
