"""Jobs that run actions: the keyword bug-report job.

The original default job indexes the tickets, then writes a summary sheet
(keyword coverage) and a detail sheet (keyword matches in titles).  Here the
postings of the listed keywords are built once and persisted (memory and disk, so a lost executor
recomputes only its partitions), both reports are planned from them, and each
sheet is written to its own path.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ticket_text
from ..operators import reports as rp
from ..operators.index import listed_postings
from ..sources.files import read_delimited_records, write_report_table


def bug_report_job(spark: SparkSession, docs: DataFrame, keywords: DataFrame, out_dir: str,
                   id_col: str = "doc_id", text_col: str = "text") -> dict[str, str]:
    """Write the ``totals`` row (R3), ``summary`` (R2) and ``detail`` (R4) sheets
    under ``out_dir``; returns sheet → path."""
    listed = keywords.select(F.col("keyword").alias("term"))
    post = listed_postings(docs, listed, id_col, text_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tickets = docs.select(F.col(id_col).cast("long").alias("id"), ticket_text(text_col).alias("title"))
        summary = rp.keyword_summary_report(post, docs, keywords)
        detail = rp.keyword_detail_report(tickets, keywords)
        paths = {name: os.path.join(out_dir, name) for name in ("totals", "summary", "detail")}
        write_report_table(rp.keyword_report_totals(post, docs, keywords), paths["totals"])
        write_report_table(summary, paths["summary"])
        write_report_table(detail, paths["detail"])
        return paths
    finally:
        post.unpersist()


def sheet_cells(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(sheet, cells) of written sheets, read back from storage; cells are joined with ``|``."""
    parts = []
    for name, path in sorted(paths.items()):
        df = read_delimited_records(spark, path, multi_line=True)
        parts.append(df.select(F.lit(name).alias("sheet"),
                               F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in df.columns]).alias("cells")))
    return reduce(DataFrame.unionByName, parts)
