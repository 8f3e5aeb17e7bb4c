"""Centroid clustering (operator 13): k-means whose nearest centroids are found by the
threshold algorithm.

For every dimension the centroids are sorted by their value there.  For a vector each of these
lists is walked outward from the vector's own value, so the centroids of a dimension come in the
order of their distance in it.  A centroid that a walk meets for the first time gets its exact
squared distance.  The squared frontier distances of all dimensions add up to a bound: a centroid
that no walk has met is at least that far away.  The walk of a vector ends when the bound strictly
exceeds its best exact distance; then no centroid is missing that could be nearer, or as near
with a smaller number.

The vectors of a batch walk in step; those that are done drop out.  Each round is one pass over
the table: tasks add up their vectors by centroid, and k rows of sums for each task are
aggregated by Spark.  What the driver and the tasks hold are the k centroids.

Defined cases: rows whose vector is null, has another number of components, or holds a null, NaN
or infinity are left out; repeated rows count each; a null id is kept, and is the last choice for a
first centroid; rows that tie for a first centroid (equal ids) are taken by their components; with fewer than k vectors
there are as many centroids as vectors; an empty table gives no rows; columns other than the id
and the vector are not read.  Components beyond 2**17 in size are held there (see ``vectors``).
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
from textlytics.llm.vectors import floor_means, integer_vectors, scaled

DIMS = 64
CLUSTERS = 8
ROUNDS = 10
SEED = 3
#: vectors that walk in step
STEP = 2048


class Lists:
    """The centroids, and for each dimension their numbers in the order of their value."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        self.k, self.d = centroids.shape
        self.number = np.argsort(centroids, axis=0, kind="stable").T.copy()
        value = np.take_along_axis(centroids.T, self.number, 1)
        far = np.full((self.d, 1), np.iinfo(np.int64).max)
        #: the lists' values between two ends that no walk passes
        self.value = np.concatenate([-far, value, far], axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each vector; ties go to the smaller number."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        who = np.full(len(x), self.k)
        for at in range(0, len(x), STEP):
            self._walk(x[at:at + STEP], best[at:at + STEP], who[at:at + STEP])
        return who, best

    def _walk(self, x: np.ndarray, best: np.ndarray, who: np.ndarray) -> None:
        dim = np.arange(self.d)
        # the next place of each list below and above the vector's value (places count the low end)
        above = np.stack([np.searchsorted(self.value[j, 1:-1], x[:, j]) for j in dim], axis=1) + 1
        below = above - 1
        met = np.zeros((len(x), self.k), bool)
        active = np.arange(len(x))
        for _ in range(self.k):  # a list has k entries
            v, lo, hi = x[active], below[active], above[active]
            up = self.value[dim, hi]
            down = self.value[dim, lo]
            rise = hi <= self.k
            to_up = np.where(rise, up - np.where(rise, v, up), np.iinfo(np.int64).max)
            fall = lo > 0
            to_down = np.where(fall, v - np.where(fall, down, v), np.iinfo(np.int64).max)
            upward = to_up < to_down
            place = np.where(upward, hi, lo)
            frontier = np.where(upward, to_up, to_down)
            above[active] = hi + upward
            below[active] = lo - ~upward
            # exact distances of the centroids that are met for the first time
            fresh = np.zeros((len(active), self.k), bool)
            fresh[np.arange(len(active))[:, None], self.number[dim, place - 1]] = True
            fresh &= ~met[active]
            i, c = np.nonzero(fresh)
            if len(i):
                gap = v[i] - self.c[c]
                dist = np.einsum("ij,ij->i", gap, gap)
                met[active[i], c] = True
                order = np.lexsort((c, dist, i))  # the nearest of each vector first, then the smaller number
                first = order[np.r_[True, i[order][1:] != i[order][:-1]]]
                row, d, n = active[i[first]], dist[first], c[first]
                better = (d < best[row]) | ((d == best[row]) & (n < who[row]))
                best[row[better]], who[row[better]] = d[better], n[better]
            bound = np.einsum("ij,ij->i", frontier, frontier)
            active = active[bound <= best[active]]
            if not len(active):
                return


def first_centroids(kept: DataFrame, k: int, seed: int, id_col: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:id``, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    rows = kept.select(order.alias("_h"), "v").orderBy(F.asc_nulls_last("_h"), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def _totals(vectors: DataFrame, centroids: np.ndarray, vector_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Count and component sums of the vectors nearest to each centroid: k * (1 + dims) numbers."""
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, total, count = Lists(centroids), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            _, x = scaled(batch.column(0), dims)
            who, _ = lists.nearest(x)
            np.add.at(total, who, x)
            count += np.bincount(who, minlength=k)
        used = np.flatnonzero(count)
        cells = np.concatenate([count[used][:, None], total[used]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, dims + 1)), pa.array(np.tile(np.arange(dims + 1), len(used))),
                                          pa.array(cells.ravel())], names=["cluster", "cell", "s"])

    sums = (vectors.select(vector_col).mapInArrow(add, "cluster long, cell long, s long")
            .groupBy("cluster", "cell").agg(F.sum("s").alias("s")).collect())
    table = np.zeros((k, dims + 1), np.int64)
    for r in sums:
        table[r.cluster, r.cell] = r.s
    return table[:, 0], table[:, 1:]


def fit(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS,
        id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """The centroids after ``rounds`` rounds, as integers (fewer than k rows if there are fewer vectors)."""
    centroids = first_centroids(integer_vectors(vectors, id_col, vector_col, dims), k, seed, id_col)
    for _ in range(rounds if len(centroids) else 0):
        centroids = floor_means(centroids, *_totals(vectors, centroids, vector_col))
    return centroids.reshape(-1, dims)


def assign(vectors: DataFrame, centroids: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance) of every kept vector; one pass, no shuffle."""
    rows = vectors.select(id_col, F.col(vector_col).alias("_v"))
    dims = centroids.shape[1]
    schema = T.StructType([rows.schema[id_col], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        for batch in batches:
            at, x = scaled(batch.column("_v"), dims)
            if len(at) and lists.k:
                who, dist = lists.nearest(x)
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(at)), pa.array(who.astype(np.int32)),
                                                  pa.array(dist)], names=schema.names)

    return rows.mapInArrow(find, schema)


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS,
              id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Every kept vector with its cluster, its distance, the sums of distances over its cluster
    and over all, and the digest of its centroid."""
    centroids = fit(vectors, k, rounds, seed, dims, id_col, vector_col)
    found = written(assign(vectors, centroids, id_col, vector_col), "clusters")
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by_cluster = [F.struct(F.lit(sums.get(i, 0)).cast("long").alias("s"), F.lit(digests[i]).alias("h")) for i in range(len(centroids))]
    one = F.array(*by_cluster) if by_cluster else F.array().cast("array<struct<s:long,h:string>>")
    mine = F.get(one, F.col("cluster"))
    return found.select(id_col, "cluster", "distance", mine.getField("s").alias("cluster_inertia"),
                        F.lit(sum(sums.values())).cast("long").alias("inertia"), mine.getField("h").alias("centroid_sha256"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of the embeddings in one of 8 clusters, after 10 rounds."""
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle_sql(k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> str:
    """The same rows in DuckDB: one pair of steps for each round."""
    dist = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"

    def nearest(n: int) -> str:
        return f"""a{n} AS (SELECT vec_id, v, c, d FROM (
  SELECT v.vec_id, v.v, c.c, {dist} AS d, row_number() OVER (PARTITION BY v.r ORDER BY {dist}, c.c) AS o
  FROM kept v CROSS JOIN c{n} c) WHERE o = 1)"""

    def means(n: int) -> str:
        return f"""s{n} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (
  SELECT c, unnest(v) AS x, unnest(range(1, {dims + 1})) AS i FROM a{n}) GROUP BY c, i),
m{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{n} GROUP BY c),
c{n + 1} AS (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m ON m.c = c.c)"""

    steps = [x for n in range(rounds) for x in (nearest(n), means(n))]
    text = ",\n".join(steps + [nearest(rounds)])
    return f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v, row_number() OVER () AS r
  FROM embeddings WHERE len(embedding) = {dims}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS (SELECT (row_number() OVER (ORDER BY h NULLS LAST, v) - 1)::INTEGER AS c, v FROM (
  SELECT sha256('{seed}:' || vec_id::VARCHAR) AS h, v FROM kept) ORDER BY h NULLS LAST, v LIMIT {k}),
{text.replace(" AS (SELECT", " AS MATERIALIZED (SELECT")}
SELECT a.vec_id, a.c AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""
