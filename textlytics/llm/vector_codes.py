"""Vector code compression (operator 11): product quantisation with a trie over distinct parts.

A vector is cut into equal consecutive parts; each part position has a codebook, whose entry
nearest to the part (squared Euclidean distance, ties to the lower number) is the part's code.

The distinct parts of a position, in lexicographic order, are the leaves of a trie whose edges are
component values.  It is walked depth first: a node holds the accumulated squared distances of its
prefix to all entries, its children add one component to them, and so parts that begin alike share
that work.  Edges without branches are taken in one step.  A leaf takes the argmin over the entries
and adds its part, weighted with the number of vectors that have it, to that entry's sum.

In Spark the parts are counted once (by part, with partial sums before the shuffle, so a part of a
third of all vectors is one row), sorted within their partition and written.  Each round is one
pass over that table; tasks give sums for each entry, which Spark adds up.  The codes of
the vectors come from the same walk over the distinct parts of a batch, without a shuffle.  What the
driver and the tasks hold are the codebooks.

Defined cases: rows whose vector is null or holds a null, NaN or infinity are left out, and so
are those that have not the length of the vector with the smallest id (null ids last; a length of
which ``parts`` is a divisor); the first entries are those of the smallest distinct ids, of rows with equal
ids that with the smallest components; repeated rows count each and get a row each; with fewer ids
than entries the codebooks have as many entries as ids; null labels are one label; an empty table gives no
rows; columns other than id, vector and label are not read.  Components beyond 2**17 in size are
held there (see ``vectors``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlytics.llm.common import written
from textlytics.llm.vectors import floor_means, int_lists, integer_vectors, matrix

PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: children that one step of a walk looks at
STEP = 1024


def walk(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) nearest to each of the distinct ``parts``, which are in
    lexicographic order, among the rows of ``book``."""
    n, width = parts.shape
    entry, dist = np.zeros(n, np.int64), np.zeros(n, np.int64)
    largest = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    # products of the rest of a part in doubles, as long as those are exact
    kind = np.float64 if 4 * width * largest * largest < 1 << 53 else np.int64
    square = book * book
    rest = np.zeros((width + 1, len(book)), np.int64)  # squares from each component on
    rest[:width] = square[:, ::-1].cumsum(1)[:, ::-1].T
    columns = np.ascontiguousarray(book.T).astype(kind)
    stack = [(0, 0, n, np.zeros(len(book), np.int64))] if n else []
    while stack:
        depth, lo, hi, so_far = stack.pop()
        if hi - lo > 1:  # an edge without branches: what the first and the last leaf share
            differ = np.flatnonzero(parts[lo, depth:] != parts[hi - 1, depth:])
            shared = depth + int(differ[0])
            if shared > depth:
                gap = parts[lo, depth:shared] - book[:, depth:shared]
                so_far, depth = so_far + (gap * gap).sum(1), shared
            value = parts[lo:hi, depth]
            start = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1, [hi - lo]]) + lo
            if len(start) - 1 > STEP:  # the later children wait
                stack.append((depth, int(start[STEP]), hi, so_far))
                start = start[:STEP + 1]
            gap = parts[start[:-1], depth][:, None] - book[:, depth]
            below = so_far + gap * gap
        else:
            start, below, depth = np.array([lo, hi]), so_far[None], depth - 1
        single = np.flatnonzero(np.diff(start) == 1)
        if len(single):
            leaf, at = start[single], depth + 1
            tail = parts[leaf, at:]
            total = below[single] + rest[at] + (tail * tail).sum(1)[:, None]
            if at < width:
                total -= (2 * (tail.astype(kind) @ columns[at:])).astype(np.int64)
            entry[leaf] = total.argmin(1)
            dist[leaf] = total[np.arange(len(leaf)), entry[leaf]]
        many = np.flatnonzero(np.diff(start) > 1)
        stack.extend((depth + 1, int(start[i]), int(start[i + 1]), below[i]) for i in many[::-1])
    return entry, dist


def distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows in lexicographic order, which of them each row is, how often it is there)."""
    order = np.lexsort(parts.T[::-1])
    ordered = parts[order]
    new = np.ones(len(parts), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(1)
    number = np.empty(len(parts), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], number, np.bincount(number, minlength=int(new.sum()))


def length_of_vectors(vectors: DataFrame, parts: int, id_col: str, vector_col: str) -> int:
    """The length of the vector with the smallest id among those that can be kept; 0: there is none."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    size = F.size(v)
    good = vectors.where(v.isNotNull() & (size > 0) & (size % parts == 0) & finite)
    key = F.struct(F.col(id_col).isNull(), F.col(id_col), size)
    return good.agg(F.min_by(size, key).alias("n")).first().n or 0


def part_table(kept: DataFrame, parts: int) -> DataFrame:
    """(pos, part, n): how many of the vectors have each part at each position; in
    lexicographic order within the partitions."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"))
                v = v.reshape(len(v), parts, -1)
                for pos in range(parts):
                    rows, _, n = distinct(v[:, pos])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), pos, np.int32)), int_lists(rows), pa.array(n)],
                                                     names=["pos", "part", "n"])

    return (kept.select("v").mapInArrow(cut, "pos int, part array<int>, n long").groupBy("pos", "part").agg(F.sum("n").alias("n"))
            .sortWithinPartitions("pos", "part"))


def first_entries(kept: DataFrame, entries: int, id_col: str) -> np.ndarray:
    """The vectors of the smallest ids: (entries, length)."""
    ids = kept.select(id_col).distinct().orderBy(F.asc_nulls_last(id_col)).limit(entries).collect()
    if not ids:
        return np.zeros((0, 0), np.int64)
    known = [r[0] for r in ids if r[0] is not None]
    wanted = F.col(id_col).isin(known) if known else F.lit(False)
    if len(known) < len(ids):
        wanted = wanted | F.col(id_col).isNull()
    rows = kept.where(wanted).groupBy(id_col).agg(F.min("v").alias("v")).orderBy(F.asc_nulls_last(id_col)).collect()
    return np.array([r.v for r in rows], np.int64)


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id") -> np.ndarray:
    """The codebooks after ``rounds`` rounds: (parts, entries, length / parts)."""
    first = first_entries(kept, entries, id_col)
    books = first.reshape(len(first), parts, -1).transpose(1, 0, 2) if len(first) else np.zeros((parts, 0, 0), np.int64)
    if not len(first):
        return books
    counted = written(part_table(kept, parts), "parts")
    for _ in range(rounds):
        books = np.stack([floor_means(b, c, t) for b, c, t in zip(books, *_totals(counted, books))])
    return books


def _totals(counted: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and component sums of the parts nearest to each entry of each codebook."""
    n_parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_parts, entries, width + 1), np.int64)
        for batch in batches:
            pos, n = batch.column("pos").to_numpy(), batch.column("n").to_numpy()
            part = matrix(batch.column("part"))
            for p in np.unique(pos):
                # AQE may have put sorted runs after each other: in order again, if they are not
                rows = np.flatnonzero(pos == p)
                rows = rows[np.lexsort(part[rows].T[::-1])]
                nearest, _ = walk(part[rows], books[p])
                weight = n[rows][:, None]
                np.add.at(total[p], nearest, np.concatenate([weight, weight * part[rows]], axis=1))
        p, e, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, e, cell, total[p, e, cell])], names=["p", "e", "cell", "s"])

    sums = counted.mapInArrow(add, "p long, e long, cell long, s long").groupBy("p", "e", "cell").agg(F.sum("s").alias("s")).toArrow()
    table = np.zeros((n_parts, entries, width + 1), np.int64)
    at = [sums.column(c).to_numpy() for c in ("p", "e", "cell", "s")]
    table[at[0], at[1], at[2]] = at[3]
    return table[:, :, 0], table[:, :, 1:]


def encode(kept: DataFrame, books: np.ndarray, id_col: str, *carry: str) -> DataFrame:
    """(id, carried columns, code, error) of every kept vector; one pass, no shuffle."""
    keep = [id_col, *carry]
    schema = T.StructType([*(kept.schema[c] for c in keep), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    n_parts, entries, _ = books.shape
    hexes = np.array([f"{i:02x}" for i in range(entries)], object)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("v"))
            v = v.reshape(len(v), n_parts, -1)
            code, error = np.full(len(v), "", object), np.zeros(len(v), np.int64)
            for p in range(n_parts):
                rows, which, _ = distinct(v[:, p])
                entry, dist = walk(rows, books[p])
                code = code + hexes[entry[which]]
                error += dist[which]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(code, pa.string()), pa.array(error)],
                                             names=schema.names)

    return kept.mapInArrow(find, schema)


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id",
               vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Every kept vector's code and error, the error summed over its label, and the digest of the codebooks."""
    kept = integer_vectors(vectors, id_col, vector_col, length_of_vectors(vectors, parts, id_col, vector_col), label_col)
    books = fit(kept, parts, entries, rounds, id_col)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    found = written(encode(kept, books, id_col, label_col), "codes")
    # as its own table, so that the planner sees its size: broadcast where small, else a join whose hot label is split
    sums = written(found.groupBy(F.col(label_col).alias("_label")).agg(F.sum("error").alias("label_error")), "code-errors")
    return (found.join(sums, F.col(label_col).eqNullSafe(F.col("_label")))
            .select(id_col, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every vector of the embeddings: 4 parts, 256 entries, 4 rounds."""
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same rows in DuckDB, for a table whose vectors have one length."""
    dist = "list_sum(list_transform(list_zip(p.part, c.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"

    def nearest(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (SELECT pos, part, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT p.pos, p.part, c.e, {dist} AS d FROM counted p JOIN c{n} c ON c.pos = p.pos) GROUP BY pos, part)"""

    def means(n: int) -> str:
        return f"""s{n} AS MATERIALIZED (SELECT pos, e, i, sum(x * n)::BIGINT AS s, sum(n)::BIGINT AS n FROM (
  SELECT a.pos, a.e, p.n, unnest(a.part) AS x, unnest(range(1, len(a.part) + 1)) AS i
  FROM a{n} a JOIN counted p ON p.pos = a.pos AND p.part = a.part) GROUP BY pos, e, i),
c{n + 1} AS MATERIALIZED (SELECT c.pos, c.e, coalesce(m.part, c.part) AS part FROM c{n} c LEFT JOIN (
  SELECT pos, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS part FROM s{n} GROUP BY pos, e) m ON m.pos = c.pos AND m.e = c.e)"""

    steps = ",\n".join([x for n in range(rounds) for x in (nearest(n), means(n))] + [nearest(rounds)])
    return f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS MATERIALIZED (SELECT r, vec_id, label, pos, v[pos * len(v) // {parts} + 1:(pos + 1) * len(v) // {parts}] AS part
  FROM kept, range({parts}) t(pos)),
counted AS MATERIALIZED (SELECT pos, part, count(*) AS n FROM parts GROUP BY pos, part),
firsts AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}),
c0 AS MATERIALIZED (SELECT p.pos, f.e, p.part FROM parts p JOIN firsts f ON f.r = p.r),
{steps},
coded AS MATERIALIZED (SELECT p.r, any_value(p.vec_id) AS vec_id, any_value(p.label) AS label,
  string_agg(lower(printf('%02x', a.e)), '' ORDER BY p.pos) AS code, sum(a.d)::BIGINT AS error
  FROM parts p JOIN a{rounds} a ON a.pos = p.pos AND a.part = p.part GROUP BY p.r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, e)) FROM c{rounds}) AS codebooks_sha256
FROM coded"""
