"""Delimited records whose quoted cells hold line breaks, read in splits.

Where a record ends depends on the quotes before it: with quotes doubled inside cells, a line begins a record
exactly if the number of quotes before it in its file is even.  So a file of any size is cut in parallel:

1. it is read as lines, in splits, and the quotes of each split are counted;
2. a row for each split, running over the splits of a file, gives the parity before each; these rows are sent to all tasks;
3. it is read again in the same splits, and the lines of a split, in their order, are put together to records in
   its task: whole ones, and what the split has of a record that begins before it or goes on after it;
4. only those parts, two for a split, are shuffled and joined, and each record is parsed by itself, with the rules of the CSV reader.

No text is shuffled or written on the way but such parts, and a task holds one batch of lines and one record.

The rows are those of the reader's own multi-line mode, which takes a whole file in one task, for files as
:func:`files.write_delimited` and other RFC 4180 writers make them: a cell with a quote is quoted.  Line
breaks inside of cells stay as they are (that mode makes \\r\\n a \\n in files whose lines end so).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import cut
from ..session import fixed_splits

#: what a split has of a record: all of it, its end, its beginning (or a part from between, if the split has nothing else)
WHOLE, END, BEGIN = 0, 1, 2


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line): the lines of all files with the split that they are in, in their order in it.  The
    splits are the same whenever the files are read in this session."""
    return (fixed_splits(spark).read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")))


def _split_parities(lines: DataFrame) -> DataFrame:
    """(file, block, odd, header): whether an odd number of quotes is before a split, and whether it is a file's first with lines."""
    own = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    splits = cut(lines.groupBy("file", "block").agg(F.sum(own.cast("long")).alias("own")))
    by_place = Window.partitionBy("file").orderBy("block")  # a row for each split
    earlier = by_place.rowsBetween(Window.unboundedPreceding, -1)
    return cut(splits.select("file", "block", (F.coalesce(F.sum("own").over(earlier), F.lit(0)) % 2 == 1).alias("odd"),
                             (F.row_number().over(by_place) == 1).alias("header")))


class _Split:
    """The lines of one split so far: puts records together, batch by batch."""

    def __init__(self, odd: bool):
        self.inside, self.open, self.begun = odd, [], not odd

    def add(self, lines: pa.Array) -> Iterator[tuple[int, str]]:
        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
        odd = (np.cumsum(quotes) + self.inside) % 2 == 1  # whether a record goes on after a line
        for line, on in zip(lines.to_pylist(), odd.tolist()):
            self.open.append(line)
            if not on:
                yield (WHOLE if self.begun else END), "\n".join(self.open)
                self.open, self.begun = [], True
        if len(odd):
            self.inside = bool(odd[-1])

    def rest(self) -> Iterator[tuple[int, str]]:
        if self.open:
            yield BEGIN, "\n".join(self.open)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, at, kind, value) of the records of splits (file, block, odd, line), whose lines come one after the other."""
    now, of, at = None, None, 0

    def rows(found: list[tuple[int, str]], file: str, block: int, first: int) -> pa.RecordBatch:
        n = len(found)
        return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()),
                                           pa.array([k for k, _ in found], pa.int32()), pa.array([v for _, v in found], pa.string())],
                                          names=["file", "block", "at", "kind", "value"])

    for batch in batches:
        if not batch.num_rows:
            continue
        file, block, odd, line = (batch.column(c) for c in ("file", "block", "odd", "line"))
        ends = pc.run_end_encode(pc.binary_join_element_wise(file, pc.cast(block, pa.string()), "\0")).run_ends.to_pylist()
        for lo, hi in zip([0] + ends, ends):
            key = (file[lo].as_py(), block[lo].as_py())
            if key != of:
                if now is not None and (found := list(now.rest())):
                    yield rows(found, *of, at)
                now, of, at = _Split(odd[lo].as_py()), key, 0
            if found := list(now.add(line.slice(lo, hi - lo))):
                yield rows(found, *of, at)
                at += len(found)
    if now is not None and (found := list(now.rest())):
        yield rows(found, *of, at)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(value): the text of every record but the header of each file."""
    lines = numbered_lines(spark, path)
    splits = _split_parities(lines)
    parts = (lines.join(F.broadcast(splits), ["file", "block"]).select("file", "block", "odd", "line")
             .mapInArrow(_parts, "file string, block long, at long, kind int, value string"))
    edges = cut(parts.where(F.col("kind") != WHOLE))  # two parts of a split at most
    whole = parts.where(F.col("kind") == WHOLE)
    # a record goes from the part that begins it to the one that ends it; the parts between are splits without a line break outside
    order = Window.partitionBy("file").orderBy("block", "at")
    ended = F.coalesce(F.sum(F.when(F.col("kind") == END, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = cut(edges.select("file", "block", "at", "kind").withColumn("record", ended))  # without texts
    of = (edges.join(places.drop("kind"), ["file", "block", "at"]).groupBy("file", "record")
          .agg(F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("p")))  # the parts of one record
    joined = of.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["at"].alias("at"),
                       F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"))
    first = splits.where("header").select("file", "block", F.lit(0).cast("long").alias("at"))
    return (whole.select("file", "block", "at", "value").unionByName(joined)
            .join(F.broadcast(first), ["file", "block", "at"], "left_anti").select("value"))


def read_records(spark: SparkSession, path: str, options: dict[str, str]) -> DataFrame:
    """The rows of a delimited file or folder with a header line in each file, all cells strings."""
    names = spark.read.options(**{**options, "multiLine": "true"}).csv(path).schema.names  # reads the first record
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    one = records(spark, path).select(F.regexp_replace("value", r"\r\z", "").alias("value")).where("value <> ''")
    rule = {k: v for k, v in options.items() if k not in ("header", "inferSchema")} | {"multiLine": "true"}
    row = F.from_csv("value", F.lit(schema.simpleString()[7:-1].replace(":", " ")), rule)
    return one.select(row.alias("r")).select([F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
