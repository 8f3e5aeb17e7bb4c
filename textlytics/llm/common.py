"""Shared helpers of the training-data operators.

* written tables in the shared folder (lineage cuts that survive lost executors),
* chunked access to the UTF-8 bytes of a text column inside ``mapInArrow``,
* vectorised word boundaries and word hashes over such a chunk,
* fixed-size bitmaps that thin out the probe side of a join.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlytics.session import ensure_checkpoint_dir, fixed_splits

U64 = np.uint64
#: bytes of text that one vectorised step looks at (a single longer text is one step)
CHUNK_BYTES = 1 << 20
#: multiplier of the prefix hash; odd, so that it has an inverse modulo 2**64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


#: rows of whole texts that go to a Python worker at once (Spark's 10,000 suit short rows)
BATCH_ROWS = 1000
#: and their bytes (a single longer row is one batch)
BATCH_BYTES = 8 << 20


def long_rows(spark: SparkSession) -> SparkSession:
    """The session, set to hand texts to Python in small batches and to number rows alike in every job."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return fixed_splits(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_rows(spark).read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage: what reads the result never recomputes ``df``, also when
    executors are lost, and sees one fixed set of rows."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    if tables := _passing():
        tables[-1].append([None, path])
    df.write.parquet(path)
    # what the step shuffled goes from the disks when the driver drops its handles
    spark.sparkContext._jvm.System.gc()
    got = spark.read.schema(df.schema).parquet(path)
    if tables:
        tables[-1][-1][0] = got
    return got


_local = threading.local()


def _passing() -> list[list[list]]:
    """For each open ``passing`` of this thread its tables and their paths."""
    if not hasattr(_local, "passing"):
        _local.passing = []
    return _local.passing


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are ``written`` inside go from the shared folder at the end, besides those that are given to
    the function that this yields; an outer ``passing`` has them then.  What is lazy must not read the others."""
    tables: list[list] = []
    held: list[list] = []

    def keep(df: DataFrame) -> DataFrame:
        held.extend(x for x in tables if x[0] is df)
        return df

    scopes = _passing()
    scopes.append(tables)
    try:
        yield keep
    finally:
        scopes.pop()
        kept = {path for _, path in held}
        for _, path in tables:
            if path not in kept:
                _delete(spark, path)
        if scopes:
            scopes[-1].extend(held)


def drop(*tables: DataFrame) -> None:
    """Take tables that were ``written`` in an open ``passing`` from the shared folder at once."""
    for scope in _passing():
        for k in reversed(range(len(scope))):
            if any(scope[k][0] is df for df in tables):
                df, path = scope.pop(k)
                _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a unique long column row; rows of files have the same number whenever
    they are read in this session, with any number of cores (write other tables first)."""
    fixed_splits(docs.sparkSession)
    return docs.withColumn("row", F.monotonically_increasing_id())


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, lower: bool = False
                ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive rows with about ``limit`` bytes of text; null is empty.

    With ``lower`` the bytes are those of the text in lower case (of any alphabet)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        col = pc.utf8_lower(col) if lower else col
        n = len(col)
        offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
        raw = col.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        start = 0
        while start < n:
            end = max(start + 1, int(np.searchsorted(offs, offs[start] + limit, "right")) - 1)
            part = offs[start:end + 1]
            yield batch.slice(start, end - start), data[part[0]:part[-1]], part - part[0]
            start = end


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix, element by element."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    i = (np.arange(n, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
    return mix(i + U64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1))


BYTE_CODE = seeded(256, 7)
#: lower-case A-Z, leave every other byte
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: space and \t \n \v \f \r, the ASCII white space
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def _pows(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        for key, base in (("p", _BASE), ("q", _BASE_INV)):
            x = np.full(size, base, U64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    p, q = _powers["p"][:n], _powers["q"][:n]
    if len(_powers["p"]) > 4 * CHUNK_BYTES:  # a very long text: do not keep its tables
        _powers.clear()
    return p, q


class PrefixHash:
    """Hashes of any byte ranges of one chunk, from one running sum (wrapping modulo 2**64)."""

    def __init__(self, data: np.ndarray, code: np.ndarray = BYTE_CODE):
        p, self.inv = _pows(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(code[data] * p[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inv[start]
        return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true positions that do not cross a row: (start, end, row)."""
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = offs[(offs > 0) & (offs < len(inside))]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[edge] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = True
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """White-space separated words of a chunk: (hash, row, start, end)."""
    if lower:
        data = LOWER[data]
    start, end, row = runs(~SPACE[data], offs)
    return PrefixHash(data).of(start, end), row, start, end


def shingle_hashes(h: np.ndarray, row: np.ndarray, n: int, rows: int
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words and their rows, in order.

    A row with 1 to n-1 words has one shingle: all its words."""
    mult = seeded(n, 11) | U64(1)
    if len(h) >= n:
        m = len(h) - n + 1
        s = np.zeros(m, U64)
        for j in range(n):
            s += h[j:j + m] * mult[j]
        whole = row[:m] == row[n - 1:]
        s, srow = mix(s[whole]), row[:m][whole]
    else:
        s, srow = np.zeros(0, U64), np.zeros(0, np.int64)
    count = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(row, short)
        extra = np.zeros(len(short), U64)
        for j in range(n - 1):
            has = count[short] > j
            extra[has] += h[first[has] + j] * mult[j]
        s = np.concatenate([s, mix(extra + U64(1))])
        srow = np.concatenate([srow, short])
        order = np.argsort(srow, kind="stable")
        s, srow = s[order], srow[order]
    return s, srow


def bitmap(df: DataFrame, key: str, bits: int = 23) -> np.ndarray:
    """A bitmap of 2**bits slots with the low bits of a long column set.

    Its size does not depend on ``df``: one row for every 64 slots comes to the
    driver at most.  With more keys it only lets more rows pass."""
    slot = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    rows = (df.where(F.col(key).isNotNull())
            .groupBy(F.shiftright(slot, 6).alias("w"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast({key} & 63 AS int))")).alias("m")))
    got = rows.toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[got.column("w").to_numpy()] = got.column("m").to_numpy()
    return words


def passes(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes have their slot set in a bitmap."""
    slot = h.astype(np.int64) & (len(words) * 64 - 1)
    return (words[slot >> 6] >> (slot & 63)) & 1 == 1
