"""Sharding (operator 6): two-pass external shuffle into shards.

* Law ``key``: a record's shard is the one with the largest seeded hash of
  (doc_id, shard number).  Document id and shard count decide, and one more shard
  takes rows only into itself.
* Pass 1 scatters the records of a shard over buckets by a seeded hash; there are as
  many buckets as make each fit into a task's memory, which follows from the bytes of
  the table.  The hash also takes in the row's place in the scan, so a shard's equal
  rows spread over its buckets too.
* Pass 2 puts one bucket at a time in memory, in a fixed order, Fisher-Yates shuffles it with
  a generator seeded by (seed, shard, bucket) and writes it as a file of its shard's
  folder.
* Slots follow from the files as written: the rows of the earlier buckets of the
  shard, plus the place in the bucket.

Defined cases: a null text is kept as null (size 16, CRC of no bytes); rows with a
null id share one shard; repeated rows are written as often as they occur; an empty
table gives empty results; other columns are written along, except those with the
name of a column added here.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlytics.llm.common import documents
from textlytics.session import ensure_checkpoint_dir

SHARDS = 40
SEED = 20_24
#: bytes of text that a bucket has about (a task holds one bucket)
BUCKET_BYTES = 48 << 20
#: bytes that a record counts besides its text
ROW_BYTES = 16
ADDED = ("shard", "bucket", "place", "grown_shard", "size", "text_crc32")


def shard_of(key: Column, n_shards: int, seed: int = SEED) -> Column:
    """The shard number with the largest seeded hash of (key, number)."""
    best = F.greatest(*[F.struct(F.xxhash64(key, F.lit(seed), F.lit(s)).alias("h"), F.lit(s).alias("s"))
                        for s in range(n_shards)]) if n_shards > 1 else F.struct(F.lit(0).alias("s"))
    return best["s"]


def shuffle_to_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, seed: int = SEED,
                      bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write ``docs`` in shuffled order to ``path``/shard=.. and return what was written,
    with (shard, slot) and per row size, text_crc32 and grown_shard."""
    spark = docs.sparkSession
    docs = docs.drop(*ADDED, "slot")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    shard = shard_of(F.col("doc_id"), n_shards, seed)
    # a shard that a frequent id (or null) makes large has more buckets, not larger ones
    sizes = {r["shard"]: r["bytes"] for r in docs.groupBy(shard.alias("shard")).agg(F.sum(size).alias("bytes")).collect()}  # n_shards rows
    buckets = [max(1, math.ceil(sizes.get(s, 0) / bucket_bytes)) for s in range(n_shards)]
    before = np.concatenate([[0], np.cumsum(buckets)])  # buckets of the shards before
    of_shard = lambda x: F.get(F.array(*[F.lit(int(v)) for v in x]), F.col("shard"))
    rows = (docs.withColumn("shard", shard)
            .withColumn("grown_shard", shard_of(F.col("doc_id"), n_shards + 1, seed))
            .withColumn("size", size)
            .withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
            .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.monotonically_increasing_id()),
                                         of_shard(buckets)).cast("int"))
            .withColumn("place", F.lit(0).cast("long")))
    order = ["shard", "bucket", "doc_id", "text_crc32"]
    dealt = (rows.repartitionById(int(before[-1]), (of_shard(before[:-1]) + F.col("bucket")).cast("int"))
             .sortWithinPartitions(*order))

    def fisher_yates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            deal = np.random.Generator(np.random.PCG64([seed, *of]))
            table = table.take(pa.array(deal.permutation(table.num_rows)))
            at = table.schema.get_field_index("place")
            table = table.set_column(at, table.schema.field(at), pa.array(np.arange(table.num_rows)))
            yield from table.to_batches(max_chunksize=4096)

        for batch in batches:
            shards, numbers = batch.column("shard").to_numpy(), batch.column("bucket").to_numpy()
            ids = before[shards] + numbers
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                key = int(shards[a]), int(numbers[a])
                if of is not None and key != of:
                    yield from out()
                    held.clear()
                of = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from out()

    shuffled = dealt.mapInArrow(fisher_yates, T.StructType([T.StructField(f.name, f.dataType) for f in dealt.schema]))
    shuffled.write.partitionBy("shard").parquet(path)
    schema = T.StructType([f for f in shuffled.schema if f.name != "shard"] + [shuffled.schema["shard"]])
    files = spark.read.schema(schema).parquet(path)
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (files.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
             .withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n"))
    return (files.join(first, ["shard", "bucket"])
            .withColumn("slot", F.col("first") + F.col("place")).drop("first", "place", "bucket"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the key law."""
    path = f"{ensure_checkpoint_dir(spark)}/llm/shards-{uuid.uuid4().hex}"
    got = shuffle_to_shards(documents(spark, sf_dir), path)
    return got.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
