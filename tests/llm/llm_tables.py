"""Small tables with the awkward cases: null columns, empty and long texts, ties, repeated rows,
and extra columns whose names clash with what the operators add."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("row", T.StringType()), T.StructField("node", T.StringType()), T.StructField("kept", T.StringType()),
    T.StructField("size", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(seed, n, vocabulary=4000):
    r = random.Random(seed)
    return " ".join("w" + "".join(r.choice("abcdefghij") for _ in range(1 + r.randrange(vocabulary) % 6)) for _ in range(n))


def stored(spark, tmp_path, texts, name="documents", extra=(), schema=SCHEMA):
    """A written table of (number, text) rows, then of ``extra`` rows (id, text)."""
    rows = [(i, t) for i, t in enumerate(texts)] + list(extra)
    path = str(tmp_path / f"{name}.parquet")
    spark.createDataFrame([(i, t, "en", "x", None, "k", "s", None if t is None else len(t)) for i, t in rows], schema
                          ).repartition(3).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def empty(spark, tmp_path):
    return stored(spark, tmp_path, [], "empty")
