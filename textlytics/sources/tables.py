"""Table-shaped lookups over sheets.

Rows have no position in a distributed table, so "first row" always means
"lowest row id" of an explicit id column.  Per-key results are aggregates
(partial before the shuffle), never per-key windows, so a key holding a
third of the rows is reduced map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def field_value_sets(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Distinct (field, value) over the given fields (long form of
    field → set of values; the header itself is not a value; blanks skipped)."""
    fields = list(fields or df.columns)
    cells = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("c")
    return (df.select(cells).select("c.field", "c.value")
            .where(F.col("value").isNotNull() & (F.col("value") != "")).distinct())


def key_value_lists(df: DataFrame, key: str, value: str, distinct: bool = False) -> DataFrame:
    """Key → values, long form (key, value, n) with n the number of rows
    holding the value under the key (the multiset of the key's list).
    ``distinct=True`` is the older variant: each value once, blanks skipped."""
    d = df.select(F.col(key).alias("key"), F.col(value).cast("string").alias("value"))
    if distinct:
        return (d.where(F.col("value").isNotNull() & (F.col("value") != "")).distinct()
                .withColumn("n", F.lit(1).cast("long")))
    return d.groupBy("key", "value").agg(F.count(F.lit(1)).cast("long").alias("n"))


def key_value_arrays(lists: DataFrame) -> DataFrame:
    """P4 as arrays (key, sorted values with repeats) — for display of a
    bounded result only; the long form is what scales."""
    rep = F.expr("array_repeat(value, cast(n as int))")
    return lists.groupBy("key").agg(F.flatten(F.array_sort(F.collect_list(rep))).alias("values"))


def first_row_matching(df: DataFrame, col: str, keys: DataFrame, row_id: str) -> DataFrame:
    """For each key, the lowest ``row_id`` whose ``col`` equals it, else −1."""
    asked = df.select(F.col(col).alias("key"), F.col(row_id).alias("row_id")).join(keys.select("key").distinct(), "key", "left_semi")
    firsts = asked.groupBy("key").agg(F.min("row_id").alias("row_id"))
    return (keys.select("key").join(firsts, "key", "left")
            .select("key", F.coalesce("row_id", F.lit(-1)).cast("long").alias("row_id")))


def include_filter(df: DataFrame, col: str, values: DataFrame) -> DataFrame:
    """Keep rows whose ``col`` is in ``values.value`` (semi join)."""
    return df.join(values.select(F.col("value").alias(col)).distinct(), col, "left_semi")


def exclude_filter(df: DataFrame, col: str, values: DataFrame) -> DataFrame:
    """Drop rows whose ``col`` is in ``values.value`` (anti join)."""
    return df.join(values.select(F.col("value").alias(col)).distinct(), col, "left_anti")


def update_cell_by_key(df: DataFrame, key_col: str, data_col: str, updates: DataFrame,
                       row_id: str) -> DataFrame:
    """For each (key, data) update, set ``data_col`` on the first row
    (lowest ``row_id``) whose ``key_col`` equals the key; other rows unchanged."""
    firsts = (df.join(updates.select(F.col("key").alias(key_col)).distinct(), key_col, "left_semi")
              .groupBy(key_col).agg(F.min(row_id).alias(row_id)))
    one = updates.groupBy(F.col("key").alias(key_col)).agg(F.max("data").alias("_new"))  # one value per key
    targets = firsts.join(one, key_col)
    out = df.join(targets, [key_col, row_id], "left")
    return out.select(*[F.coalesce(F.col("_new"), F.col(c)).alias(c) if c == data_col else F.col(c)
                        for c in df.columns])
