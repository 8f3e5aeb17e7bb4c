"""Co-occurrence over the whole vocabulary (M2): frequent pairs of terms, counted exactly.

A pair that ``min_count`` documents have in common consists of terms that each have as many, so
rarer terms leave first.  Of the other terms every document holds n²/2 pairs, most of which are still
rare.  They are dropped before the shuffle, by hashed pair counts:

1. every task adds its pairs into a table of ``2**bits`` counters, whatever the data's size;
   tables are added up counter by counter, in blocks;
2. only pairs whose counter reaches ``min_count`` can be frequent.  One bit per counter travels to the
   tasks, which count the pairs that pass; Spark adds those counts up, after partial sums;
3. pairs that only shared a counter fall short of ``min_count`` then and go.

Counters never lose a pair; when the data outgrows them they let more pairs through.

Terms count as numbers in term order; the pairs of one number are spread over all documents, and each
task sums them before they are shuffled, so a term of a third of the corpus is no hot key.  A document
of more than ``BLOCK`` terms is cut into blocks of first terms, each a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import cut, running_totals
from .stats import doc_freqs

#: first terms of the pairs of one row
BLOCK = 2048
#: counters of a table, as a power of two (four bytes each), and of a block of it that is shuffled
BITS = 22
SHARD_BITS = 14
#: pairs that a task looks at, or holds uncounted, at a time
STEP = 1 << 21

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _term_lists(post: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(ids, lo, hi): the numbers of a document's terms in order, and which of them are the first ones
    of this row's pairs."""
    docs = (post.select("doc_id", "term").join(dictionary.select("term", "id"), "term")
            .groupBy("doc_id").agg(F.sort_array(F.collect_list("id")).alias("ids")))  # the terms of one document
    blocks = F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / BLOCK)).cast("array<int>")
    rows = docs.where(F.size("ids") > 1).select("doc_id", "ids", F.explode(blocks).alias("block"))
    # the work is in the pairs, not in the bytes: as many tasks as the session has shuffle partitions, blocks of a document apart
    rows = rows.repartition(int(post.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "block")
    return rows.select("ids", (F.col("block") * BLOCK).alias("lo"), F.least((F.col("block") + 1) * BLOCK, F.size("ids")).alias("hi"))


def _pairs(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The pairs of rows of :func:`_term_lists` as first << 32 | second, some at a time."""
    lists = batch.column("ids")
    ends, ids = np.asarray(lists.offsets), lists.values.to_numpy().astype(np.uint64)
    held, size = [], 0
    for k, (lo, hi) in enumerate(zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist())):
        row = ids[ends[k]:ends[k + 1]]
        n, at = len(row), lo
        while at < hi:
            step = max(1, min(hi - at, STEP // max(1, n - at)))
            first = np.arange(at, at + step)
            count = n - 1 - first
            second = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first + 1, count)
            held.append((np.repeat(row[at:at + step], count) << np.uint64(32)) | row[second])
            size += len(second)
            at += step
            if size >= STEP:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _slot(pairs: np.ndarray, bits: int) -> np.ndarray:
    h = pairs * _ODD
    h ^= h >> np.uint64(32)
    return ((h * _ODD) >> np.uint64(64 - bits)).astype(np.int64)


def _passing(lists: DataFrame, min_count: int, bits: int) -> np.ndarray:
    """One bit for each counter: whether its pairs together reach ``min_count``."""
    shard = min(bits, SHARD_BITS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for pairs in _pairs(batch):
                table += np.bincount(_slot(pairs, bits), minlength=1 << bits).astype(np.int32)
                np.minimum(table, min_count, out=table)  # more is not needed, and counters never overflow
        parts = table.reshape(-1, 1 << shard)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["shard", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("shard").to_pylist(), batch.column("counts")):
                part = np.frombuffer(raw.as_buffer(), np.int32)
                sums[i] = np.minimum(sums[i] + part, min_count) if i in sums else part
        bit = [np.packbits(s >= min_count).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(bit, pa.binary())], names=["shard", "bits"])

    tables = lists.mapInArrow(add, "shard long, counts binary")
    spread = max(1, min(1 << (bits - shard), 64))
    found = tables.repartition(spread, "shard").mapInArrow(merge, "shard long, bits binary").collect()  # 2**bits bits in all
    out = np.zeros((1 << (bits - shard), (1 << shard) // 8), np.uint8)
    for r in found:
        out[r["shard"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def frequent_pairs(post: DataFrame, min_count: int, bits: int = BITS) -> DataFrame:
    """M2: (term_a, term_b, n_docs) for all terms term_a <= term_b (in term order) that at least ``min_count``
    documents have in common; with itself a term has its document frequency."""
    if min_count < 1:
        raise ValueError("min_count must be at least 1")
    frequent = doc_freqs(post).where(F.col("df") >= min_count)
    dictionary = cut(running_totals(frequent, [F.asc("term")], rank_col="id").select("term", F.col("id").cast("int").alias("id"), "df"))
    lists = cut(_term_lists(post, dictionary))
    known = post.sparkSession.sparkContext.broadcast(_passing(lists, min_count, bits))  # fixed size: 2**bits / 8 bytes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing = known.value
        held, size = [], 0

        def out() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((pair >> np.uint64(32)).astype(np.int32)),
                                               pa.array((pair & np.uint64(0xFFFFFFFF)).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

        for batch in batches:
            for pairs in _pairs(batch):
                slot = _slot(pairs, bits)
                kept = pairs[(passing[slot >> 3] >> (7 - (slot & 7))) & 1 == 1]
                held.append(kept)
                size += len(kept)
                if size >= 4 * STEP:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    counts = (lists.mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n_docs"))
              .where(F.col("n_docs") >= min_count))
    names = dictionary.select("term", "id")
    pairs = (counts.join(names.select(F.col("id").alias("a"), F.col("term").alias("term_a")), "a")
             .join(names.select(F.col("id").alias("b"), F.col("term").alias("term_b")), "b").select("term_a", "term_b", "n_docs"))
    return pairs.unionByName(dictionary.select(F.col("term").alias("term_a"), F.col("term").alias("term_b"), F.col("df").alias("n_docs")))
