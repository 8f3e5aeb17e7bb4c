"""Global ranks and running sums without a single-partition window.

``Window.orderBy(...)`` with no partition key pulls every row into one task.
Over a whole vocabulary that is unbounded, so instead:

1. ``repartitionByRange`` on the order key: P balanced, ordered ranges;
2. tag each row with its range id and checkpoint (reliable, in the session's
   checkpoint folder) so the ids survive recomputation after executor loss;
3. per-range totals (P rows) → exclusive prefix over ranges (P rows, tiny);
4. a window *partitioned by range id* gives the local running values, and the
   range offsets (broadcast, bounded by P) are added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


#: rows of one range of :func:`running_totals`, about
RANGE_ROWS = 1_000_000


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: the lineage is cut, and a join on it reads a
    plain table.  Adaptive execution can then split the partition of a hot key on the other
    side, which it does not if this side is an aggregate just above its own shuffle."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_bounded(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (reads at most max_rows+1)."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only after checking the row count; beyond the bound the
    plain DataFrame is returned and the planner/AQE chooses a shuffle join."""
    return F.broadcast(df) if is_bounded(df, max_rows) else df


def running_totals(df: DataFrame, order: Sequence[Column], sums: Mapping[str, str] | None = None,
                   rank_col: str | None = "rank", partitions: int | None = None) -> DataFrame:
    """Add a 1-based ``rank_col`` and, for each ``out: src`` in ``sums``, the running
    sum of ``src`` in the global ``order`` (which must be a total order)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sums = dict(sums or {})
    # the range sampler and the shuffle both read the input: persist it so it
    # is computed once, then cut the lineage with a reliable checkpoint
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if partitions is None:  # as many ranges as keep each at RANGE_ROWS rows about
            partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-src.count() // RANGE_ROWS))
        ranged = (src.repartitionByRange(partitions, *order)
                  .withColumn("_rng", F.spark_partition_id())
                  .checkpoint(eager=True))
    finally:
        src.unpersist()
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.sum(src).alias(f"_s_{out}") for out, src in sums.items()]
    totals = ranged.groupBy("_rng").agg(*aggs)
    prior = Window.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_rng",
        F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_off_n"),
        *[F.coalesce(F.sum(f"_s_{out}").over(prior), F.lit(0)).alias(f"_off_{out}") for out in sums])
    local = Window.partitionBy("_rng").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "_rng")
    if rank_col:
        out = out.withColumn(rank_col, F.row_number().over(Window.partitionBy("_rng").orderBy(*order))
                             + F.col("_off_n"))
    for o, src in sums.items():
        out = out.withColumn(o, F.sum(src).over(local) + F.col(f"_off_{o}"))
    return out.drop("_rng", "_off_n", *[f"_off_{o}" for o in sums])
