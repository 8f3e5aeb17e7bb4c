"""Sources and sinks (S1, S2, S5–S8): delimited files, sheets, keyword lists, reports.

Spreadsheet workbooks arrive as one delimited (or parquet) directory per
sheet; every cell is read as a string and blank cells become NULL.  Writes
go to the given path (on a cluster: a shared folder) and replace it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import read_records

# RFC-4180 style: quotes doubled, fields may span lines, whitespace kept.
_CSV_READ = {"header": "true", "escape": '"', "quote": '"', "inferSchema": "false", "mode": "PERMISSIVE"}
_CSV_WRITE = {"header": "true", "escape": '"', "quote": '"',
              "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_delimited_records(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """Line 1 names the fields, every later record is a row; all strings; missing
    cells are NULL.  A file is read in splits; with ``multi_line``, for quoted
    fields that hold line breaks, too (see :mod:`.records`)."""
    if multi_line:
        return read_records(spark, path, {**_CSV_READ, "sep": sep})
    return spark.read.options(**_CSV_READ).option("sep", sep).csv(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    """Write ``df`` as delimited text with a header, replacing ``path``."""
    (df.select([F.col(c).cast("string") for c in df.columns])
     .write.mode("overwrite").options(**_CSV_WRITE).option("sep", sep).csv(path))


def union_sheets(spark: SparkSession, paths: Sequence[str], fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """Every sheet with its own header, appended into one corpus by column
    name; a field missing from a sheet is NULL there."""
    def read(p):
        df = read_delimited_records(spark, p, multi_line=multi_line) if fmt == "csv" else spark.read.format(fmt).load(p)
        return df.select([F.col(c).cast("string") for c in df.columns])
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read(p) for p in paths])


def read_keywords(spark: SparkSession, path: str, column: int | None = None, sep: str = ",") -> DataFrame:
    """One keyword per line, no header, lower-cased; not trimmed and not
    de-duplicated (the list is used as written).  With ``column`` (from 0) the line
    is a delimited record and the keyword its cell there; a missing cell gives none."""
    if column is None:
        return spark.read.text(path).select(F.lower("value").alias("keyword"))
    names = ", ".join(f"c{i} string" for i in range(column + 1))
    cells = spark.read.schema(names).options(**{**_CSV_READ, "header": "false"}).option("sep", sep).csv(path)
    return cells.select(F.lower(f"c{column}").alias("keyword")).where(F.col("keyword").isNotNull())


def write_keywords(df: DataFrame, col: str, path: str) -> None:
    df.select(F.col(col).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_bug_reports(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The first three columns of a sheet (header skipped) as
    (id, title, commit_notes); blank cells become ''."""
    df = read_delimited_records(spark, path, multi_line=multi_line)
    c = df.columns[:3]
    return df.select(*[F.coalesce(F.col(x), F.lit("")).alias(n) for x, n in zip(c, ["id", "title", "commit_notes"])])


def write_report_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a report table (one "sheet") to its own path, replacing it."""
    if fmt == "csv":
        write_delimited(df, path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def write_text_report(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write one string column as text lines; ``mode`` makes the
    overwrite/append choice explicit (the original always truncated)."""
    (col,) = lines.columns
    lines.select(F.col(col).cast("string").alias("value")).write.mode(mode).text(path)


def read_text_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
