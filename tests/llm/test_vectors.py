"""Vector codes and clusters: against brute force and against their DuckDB SQL."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from textlytics.llm import clustering, vector_codes
from textlytics.llm.catalog import ORACLE, QUERIES
from tools.check_oracle import canon

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("cluster", T.StringType())])


def awkward(dims, n=60, seed=3):
    """Rows with nulls, NaN, infinity, other lengths, copies, ties, repeated and null ids and null labels."""
    r = np.random.default_rng(seed)
    rows = [(int(i * 7 % 53), [float(x) for x in r.integers(-3, 4, dims) / 1024 + 0.0001], int(r.integers(0, 3))) for i in range(n)]
    rows += [(1, rows[0][1], None), (2, rows[0][1], None), (2, rows[0][1], None), (None, rows[5][1], 1), (None, rows[6][1], 1)]
    rows += [(100, None, 0), (101, [], 0), (102, [None] + [0.0] * (dims - 1), 0), (103, [math.nan] * dims, 1), (104, [math.inf] * dims, 1),
             (105, [0.0] * (dims + 1), 2), (106, [1e30] + [-1e30] * (dims - 1), 2)]
    return rows


def table(spark, tmp_path, rows, parts=4):
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def kept(rows, dims):
    """(id, integers, label) in a fixed order, as the docstrings say."""
    limit = (1 << 27) - 1
    return [(i, [max(-limit, min(limit, math.floor(1024 * float(np.float32(x))))) for x in v], lab) for i, v, lab in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]


def nearest(x, entries):
    d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in entries]
    return d.index(min(d)), min(d)


def moved(entries, members):
    return [[sum(c) // len(members[i]) for c in zip(*members[i])] if members[i] else e for i, e in enumerate(entries)]


@pytest.mark.parametrize("k, dims, rounds", [(5, 6, 3), (100, 6, 2), (3, 1, 4)])
def test_clusters_match_brute_force(spark, tmp_path, k, dims, rounds):
    rows = awkward(dims)
    got = clustering.clustered(table(spark, tmp_path, rows), k, rounds, 3, dims).collect()
    use = kept(rows, dims)
    first = sorted(use, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [r[1] for r in first[:k]]
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in use:
            members[nearest(v, centroids)[0]].append(v)
        centroids = moved(centroids, members)
    found = [(i, *nearest(v, centroids)) for i, v, _ in use]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    want = Counter((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
                   for i, c, d in found)
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("parts, entries, rounds", [(2, 4, 3), (4, 256, 2), (1, 1, 1)])
def test_codes_match_brute_force(spark, tmp_path, parts, entries, rounds):
    dims, rows = 8, awkward(8)
    got = vector_codes.compressed(table(spark, tmp_path, rows), parts, entries, rounds).collect()
    use = kept(rows, dims)
    width = dims // parts
    smallest = {}
    for i, v, _ in use:
        smallest[i] = min(v, smallest.get(i, v))
    ids = sorted(smallest, key=lambda i: (i is None, i))[:entries]
    books = [[smallest[i][p * width:(p + 1) * width] for i in ids] for p in range(parts)]
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in use]
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for x in cut:
                members[nearest(x[p], books[p])[0]].append(x[p])
            books[p] = moved(books[p], members)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded, by_label = [], Counter()
    for (i, _, lab), x in zip(use, cut):
        best = [nearest(x[p], books[p]) for p in range(parts)]
        error = sum(d for _, d in best)
        coded.append((i, "".join(f"{e:02x}" for e, _ in best), error, lab))
        by_label[lab] += error
    assert Counter(map(tuple, got)) == Counter((i, c, e, by_label[lab], digest) for i, c, e, lab in coded)


def test_walks_equal_the_full_search():
    r = np.random.default_rng(5)
    for n, k, dims, size in ((2000, 256, 16, 400), (2000, 9, 3, 4), (300, 2, 5, 1 << 26), (3000, 60, 2, 2000)):
        book, x = r.integers(-size, size, (k, dims)), r.integers(-size, size, (n, dims))
        d = ((x[:, None] - book) ** 2).sum(2)
        who, dist = clustering.Lists(book).nearest(x)
        assert (who == d.argmin(1)).all() and (dist == d.min(1)).all()
        rows, which, count = vector_codes.distinct(x)
        assert (rows[which] == x).all() and count.sum() == n and (np.lexsort(rows.T[::-1]) == np.arange(len(rows))).all()
        entry, dist = vector_codes.walk(rows, book)
        assert (entry[which] == d.argmin(1)).all() and (dist[which] == d.min(1)).all()


def test_empty_tables(spark, tmp_path):
    e = table(spark, tmp_path, [(1, None, 0)])
    assert clustering.clustered(e).collect() == [] and vector_codes.compressed(e).collect() == []
    e = e.limit(0)
    assert clustering.clustered(e).collect() == [] and vector_codes.compressed(e).collect() == []


@pytest.mark.parametrize("key", ["op11_vector_codes", "op13_centroid_clustering"])
def test_queries_match_their_sql(spark, key):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    got, want = canon(QUERIES[key](spark, SF).toPandas()), canon(con.sql(ORACLE[key]).df())
    assert got == want and len(got[1]) > 0
