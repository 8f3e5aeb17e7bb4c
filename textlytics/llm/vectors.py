"""Shared reading of embedding vectors for the operators on them (11 and 13).

A component x counts as the integer floor(1024 * x), x taken as a double.  Integers beyond
``BOUND`` in size are held at it: squared distances of 64 components stay within a long,
so every distance and every sum of up to 2**35 vectors is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: what a component is multiplied with
SCALE = 1024.0
#: largest size of a scaled component
BOUND = (1 << 27) - 1


def scaled(column: pa.Array | pa.ChunkedArray, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors) of a list column: rows whose list is not null, has ``dims`` components
    (None: that of the first such row that is not empty) and holds no null, NaN or infinity."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n, none = len(column), np.zeros(0, np.int64)
    if not n:
        return none, np.zeros((0, dims or 0), np.int64)
    ends = np.asarray(column.offsets)
    values = column.values
    x = values.cast(pa.float64(), safe=False).fill_null(np.nan).to_numpy(zero_copy_only=False)
    length = np.diff(ends)
    there = np.ones(n, bool) if not column.null_count else ~np.asarray(column.is_null())
    if dims is None:
        some = np.flatnonzero(there & (length > 0))
        dims = int(length[some[0]]) if len(some) else 0
    rows = np.flatnonzero(there & (length == dims)) if dims else none
    if not len(rows):
        return none, np.zeros((0, dims), np.int64)
    part = x[ends[rows][:, None] + np.arange(dims)]
    whole = np.isfinite(part).all(1)
    return rows[whole], np.clip(np.floor(part[whole] * SCALE), -BOUND, BOUND).astype(np.int64)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, *carry: str) -> DataFrame:
    """(id, carried columns, v array<int>) of the kept vectors; one pass, no shuffle."""
    rows = vectors.select(id_col, *carry, F.col(vector_col).alias("_v"))
    keep = [id_col, *carry]
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("v", T.ArrayType(T.IntegerType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, v = scaled(batch.column("_v"), dims)
            if len(at):
                whole = batch.select(keep).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*whole.columns, int_lists(v)], names=[*keep, "v"])

    return rows.mapInArrow(read, schema)


def int_lists(v: np.ndarray) -> pa.Array:
    """A matrix as an Arrow column of integer lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]),
                                    pa.array(v.astype(np.int32).ravel()))


def matrix(column: pa.Array) -> np.ndarray:
    """The other way: lists of one length as a matrix."""
    if not len(column):
        return np.zeros((0, 0), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def floor_means(old: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """floor(total / count) for each row; rows that nothing was assigned to stay."""
    used = count > 0
    new = old.copy()
    new[used] = total[used] // count[used][:, None]  # numpy's // goes down
    return new
