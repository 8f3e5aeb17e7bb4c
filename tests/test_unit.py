"""Unit analogs of the original tests, plus analyser and I/O round trips."""

from pyspark.sql import functions as F

from conftest import docs_df
from textlytics.functions import columns as fc
from textlytics.operators.index import analyzed_docs, term_positions
from textlytics.session import scratch_path
from textlytics.sources import files as fl
from textlytics.sources import tables as tb


def test_include_exclude_filter(spark):
    base = spark.createDataFrame([(v,) for v in ["oak", "elm", "ash", "fir"]], "v string")
    lst = spark.createDataFrame([("elm",), ("fir",)], "value string")
    assert sorted(r.v for r in tb.include_filter(base, "v", lst).collect()) == ["elm", "fir"]
    assert sorted(r.v for r in tb.exclude_filter(base, "v", lst).collect()) == ["ash", "oak"]


def test_sheet_round_trip(spark):
    path = scratch_path(spark, "t-sheet")
    sheet = spark.createDataFrame([("p", "q", "r"), ("s", "t", "u")], "a string, b string, c string")
    fl.write_delimited(sheet, path)
    back = fl.read_delimited_records(spark, path)
    assert sorted(r.a for r in back.collect()) == ["p", "s"]
    assert back.columns == ["a", "b", "c"]


def test_csv_keeps_whitespace_quotes_and_newlines(spark):
    path = scratch_path(spark, "t-csv")
    rows = [(1, '  lead and "quoted", comma\nnext line  '), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    fl.write_delimited(df, path)
    back = {int(r.id): r.text for r in fl.read_delimited_records(spark, path, multi_line=True).collect()}
    assert back[1] == rows[0][1] and back[2] is None


def test_analyzer_rules(spark):
    d = docs_df(spark, ["The user's e-mail: Bob@example.com at 12:30, and 2.0 versions", None])
    terms = {r.doc_id: r.terms for r in analyzed_docs(d).collect()}
    assert terms[0] == ["user's", "e", "mail", "bob", "example.com", "12:30", "2.0", "versions"]
    assert terms[1] == []


def test_positions_keep_stop_word_gaps(spark):
    d = docs_df(spark, ["the cat and the hat"])
    got = [(r.pos, r.term) for r in term_positions(d).orderBy("pos").collect()]
    assert got == [(1, "cat"), (4, "hat")]


def test_dates_round_trip_and_bad_text(spark):
    df = spark.createDataFrame([("03-15-1996",), ("1996/03/15",), (None,)], "s string")
    got = [r.d for r in df.select(fc.parse_date("s").alias("d")).collect()]
    assert str(got[0]) == "1996-03-15" and got[1] is None and got[2] is None
    back = df.select(fc.format_date(fc.parse_date("s")).alias("t")).collect()[0].t
    assert back == "03-15-1996"


def test_first_row_and_update_by_key(spark):
    df = spark.createDataFrame([(3, "k1", "x"), (1, "k1", "y"), (2, "k2", "z")], "rid long, key string, val string")
    keys = spark.createDataFrame([("k1",), ("nope",)], "key string")
    got = {r.key: r.row_id for r in tb.first_row_matching(df, "key", keys, "rid").collect()}
    assert got == {"k1": 1, "nope": -1}
    upd = spark.createDataFrame([("k1", "NEW")], "key string, data string")
    out = {r.rid: r.val for r in tb.update_cell_by_key(df, "key", "val", upd, "rid").collect()}
    assert out == {1: "NEW", 2: "z", 3: "x"}


def test_key_value_lists_long_and_arrays(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "z")], "k string, v string")
    lists = tb.key_value_lists(df, "k", "v")
    arrays = {r.key: r["values"] for r in tb.key_value_arrays(lists).collect()}
    assert arrays == {"a": ["x", "x", "y"], "b": ["z"]}


def test_normalise_cells(spark):
    df = spark.createDataFrame([(1, True, 2.5, None)], "i int, b boolean, d double, s string")
    df = df.withColumn("dt", F.to_date(F.lit("1996-03-15")))
    r = fc.normalise_cells(df).collect()[0]
    assert (r.i, r.b, r.d, r.s, r.dt) == ("1", "true", "2.5", "", "03-15-1996")


def test_saved_index_of_two_fields(spark):
    from textlytics.operators import search as se
    from textlytics.operators.index import append_documents, index_documents, load_index, postings, save_index
    rows = [(0, "red apple pie", "blue"), (1, "green apple", None), (2, "blue sky", "red"), (3, "red sky at night", "")]
    d = spark.createDataFrame(rows, "doc_id long, text string, note string")
    path = scratch_path(spark, "t-index")
    save_index(index_documents(d.where("doc_id < 2")), path)
    append_documents(path, d.where("doc_id >= 2"))
    text, note = load_index(spark, path, "text"), load_index(spark, path, "note")
    plan = text.where(F.col("term").isin("apple"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,apple)" in plan.split("PushedFilters")[1] and "field" in plan.split("PartitionFilters")[1]
    assert sorted(map(tuple, text.collect())) == sorted(map(tuple, postings(d).collect()))
    for index, column in ((text, "text"), (note, "note")):
        a = se.search_keyword(postings(d, text_col=column), d, "red apple", 10).collect()
        assert a and [tuple(r) for r in a] == [tuple(r) for r in se.search_keyword(index, d, "red apple", 10).collect()]
    table = se.search_results_table(text, d, "Apple", 10, fields=("note", "text")).collect()
    assert {(r.doc_id, r.note, r.text, r.matched) for r in table} == {(0, "blue", "red apple pie", 2), (1, None, "green apple", 2)}
    best = se.best_doc_for_term(text, d, spark.createDataFrame([("APPLE",), ("none",)], "term string")).collect()
    assert [(r.term, r.doc_id) for r in best] == [("APPLE", 1)]


def test_short_rows_splits_and_keyword_column(spark, tmp_path):
    lines = ["a,b,c", "1,2", "3", "4,5,6,7"] + [f"{i},x{i},y" for i in range(20000)]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = fl.read_delimited_records(spark, str(tmp_path / "t.csv"))
        assert df.rdd.getNumPartitions() > 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert {tuple(r) for r in df.limit(3).collect()} == {("1", "2", None), ("3", None, None), ("4", "5", "6")}
    (tmp_path / "k.csv").write_text("One,First Word\nTwo\nThree,SECOND\n")
    assert [r.keyword for r in fl.read_keywords(spark, str(tmp_path / "k.csv"), column=1).collect()] == ["first word", "second"]


def test_stream_timeout_raises(spark, tmp_path):
    import pytest
    from textlytics.streaming.terms import run_term_doc_freq
    d = docs_df(spark, [f"word{i} common" for i in range(60)])
    d.repartition(30).write.parquet(str(tmp_path / "in"))
    with pytest.raises(TimeoutError):
        run_term_doc_freq(spark, str(tmp_path / "in"), d.schema, str(tmp_path / "out"), max_files_per_trigger=1, timeout_s=1)
    got = run_term_doc_freq(spark, str(tmp_path / "in"), d.schema, str(tmp_path / "out2"))
    assert {r.term: r.df for r in got.collect()}["common"] == 60


def test_chomp_removes_one_line_break(spark):
    from textlytics.operators import search as se
    from textlytics.operators.index import postings
    d = docs_df(spark, ["alpha\n\n", "alpha\r\n", "alpha beta"])
    terms = spark.createDataFrame([("alpha",)], "term string")
    got = {r.doc_id: r.text for r in se.search_in_id_order(postings(d), d, terms, 10).collect()}
    assert got == {0: "alpha\n", 1: "alpha", 2: "alpha beta"}
