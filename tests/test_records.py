"""Quoted line breaks in splits: the same rows as the reader that takes a file whole."""

import os

import pytest
from pyspark.sql import functions as F

from textlytics.sources import files as fl
from textlytics.sources import records as rc

CELLS = ["plain", 'say "hi"', "two\nlines", "", None, 'q"\n"\n,x', " spaced ", "a,b", "\n\n\n", '""', "é😀\r\nz", "x" * 300, '",\n"', "last\n"]
READ = {"header": "true", "escape": '"', "quote": '"', "inferSchema": "false", "mode": "PERMISSIVE", "sep": ","}


@pytest.fixture()
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def rows(df):
    return sorted(df.collect(), key=str)


def test_same_rows_as_the_whole_file(spark, tmp_path, small_splits):
    path = str(tmp_path / "sheet")
    table = [(i, CELLS[i % len(CELLS)], CELLS[(i * 5 + 3) % len(CELLS)]) for i in range(120)]
    df = spark.createDataFrame(table, "id long, text string, more string").repartition(2)
    fl.write_delimited(df, path)
    want = spark.read.options(**READ).option("multiLine", True).csv(path)
    got = fl.read_delimited_records(spark, path, multi_line=True)
    assert got.columns == want.columns and rows(got) == rows(want) and got.count() == 120
    lines = rc.numbered_lines(spark, path)
    assert lines.select("file", "block").distinct().count() > 20  # one file is read by many tasks
    assert {r.id: r.text for r in got.collect()} == {str(i): t or None for i, t, _ in table}


@pytest.mark.parametrize("text", ['a,b\n1,2\n3,"x\ny"\n', 'a,b\r\n1,2\r\n3,"x\r\ny"\r\n', 'a,b\n1\n\n1,2,3\n"",\n', "a,b\n", '"a\nb",c\n1,2', 'a;b\n1;"2\n"'])
def test_written_by_hand(spark, tmp_path, small_splits, text):
    path = str(tmp_path / "hand.csv")
    with open(path, "w", newline="") as f:
        f.write(text)
    sep = ";" if ";" in text else ","
    want = spark.read.options(**{**READ, "sep": sep}).option("multiLine", True).csv(path)
    got = fl.read_delimited_records(spark, path, sep, multi_line=True)
    # in a file whose lines end in \\r\\n that reader also changes the line breaks inside of cells; here they stay
    same = got.select([F.replace(c, F.lit("\r\n"), F.lit("\n")).alias(c) for c in got.columns])
    assert got.columns == want.columns and rows(same) == rows(want)


def test_text_is_not_shuffled(spark, tmp_path, small_splits):
    """Lines are put together where they are read; only parts of records that splits cut are joined by a shuffle."""
    path = str(tmp_path / "sheet")
    long = "\n".join("x" * 50 + '"' * (i % 3) for i in range(40))  # goes over many splits
    table = [(i, long if i % 25 == 3 else "a\nb") for i in range(60)]
    fl.write_delimited(spark.createDataFrame(table, "id long, `text\nwith a long name of many letters` string").coalesce(1), path)
    got = fl.read_delimited_records(spark, path, multi_line=True)
    assert {tuple(r) for r in got.collect()} == {(str(i), t) for i, t in table} and got.count() == 60
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan
    lines = rc.numbered_lines(spark, path).count()
    assert rc.numbered_lines(spark, path).select("file", "block").distinct().count() > 20 and lines > 60 * 2


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "empty")
    fl.write_delimited(spark.range(0).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b")), path)
    assert os.path.isdir(path) and fl.read_delimited_records(spark, path, multi_line=True).collect() == []
