"""Row numbers and results stay the same when the number of cores changes between jobs, as when an executor is lost."""

from collections import Counter

import pytest
from llm_tables import SCHEMA, words
from pyspark.sql import functions as F

from textlytics.llm import common, line_dedup, suffix_dedup
from textlytics.llm.common import numbered

CORES = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture()
def many_files(spark, tmp_path):
    """A table of 30 files of different sizes."""
    shared = words(5, 60)
    rows = [(i, words(i, 20 + i) + (" " + shared if i % 3 == 0 else "") + "\n" + words(7, 20), "en", "x", None, "k", "s", 1) for i in range(240)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(30, F.col("doc_id")).write.parquet(path)
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.unset("spark.sql.files.minPartitionNum")
    yield spark.read.schema(SCHEMA).parquet(path)
    spark.conf.unset(CORES)
    spark.conf.set("spark.sql.files.minPartitionNum", before) if before else spark.conf.unset("spark.sql.files.minPartitionNum")


def test_row_numbers(spark, many_files):
    spark.conf.set(CORES, "16")
    rows = numbered(many_files.select("doc_id", "text"))
    want = {r["row"]: r.doc_id for r in rows.collect()}
    spark.conf.set(CORES, "3")
    assert {r["row"]: r.doc_id for r in rows.select("row", "doc_id", F.length("text")).collect()} == want and len(want) == 240


@pytest.mark.parametrize("found", [suffix_dedup.repeated_spans, line_dedup.repeats], ids=["strings", "lines"])
def test_results(spark, many_files, monkeypatch, found):
    """Every table that an operator writes on its way changes the number of cores."""
    def run(cores):
        cores, kept = iter(cores), common.written
        def written(df, name):
            spark.conf.set(CORES, str(next(cores)))
            return kept(df, name)
        for module in (suffix_dedup, line_dedup):
            monkeypatch.setattr(module, "written", written)
        rows = numbered(many_files.select("doc_id", "text"))
        try:
            return Counter(tuple(x for k, x in r.asDict().items() if k != "row") for r in rows.select("row", "doc_id").join(found(rows), "row").collect())
        finally:
            for module in (suffix_dedup, line_dedup):
                monkeypatch.setattr(module, "written", kept)

    steady = run([16] * 99)
    assert steady and run([16, 3, 11, 2, 7] * 20) == steady
