"""What keeps postings from being made, shuffled or written more often than needed; the rows are those of the plainer forms."""

import pytest
from pyspark.sql import functions as F

from conftest import docs_df
from textlytics.operators import classify as nb
from textlytics.operators import index as ix
from textlytics.operators import similar as sm
from textlytics.operators import stats as st
from textlytics.operators import term_table as tt
from textlytics.operators.reports import set_doc_freqs
from textlytics.plans import catalog

TEXTS = [" ".join(f"w{(i * j) % 17}" for j in range(i % 9)) for i in range(60)] + [None, "", "w1 w1 tion from que", "from the w3"]


def rows(df):
    return sorted(df.collect(), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def docs(spark):
    """Ids that repeat and null ids, too."""
    more = spark.createDataFrame([(3, "w3 w3 again w5"), (3, "w5"), (None, "w1 from"), (None, "w2 que")], "doc_id long, text string")
    return docs_df(spark, TEXTS).unionByName(more).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))


@pytest.fixture()
def sf(docs, tmp_path):
    docs.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_index_is_written_in_one_pass(spark, docs, tmp_path, monkeypatch):
    """No range partitioning, which runs its input twice; each file still has a range of terms of its own."""
    def no(*_):
        raise AssertionError("the input of a range partitioning runs twice")

    monkeypatch.setattr(ix, "RANGE_POSTINGS", 20)
    monkeypatch.setattr(ix, "SAMPLE_DOCS", 30)
    want = rows(ix.index_documents(docs))
    path = str(tmp_path / "index")
    monkeypatch.setattr(ix, "save_index", no)
    ix.write_index(docs.where("doc_id < 20 OR doc_id IS NULL"), path)
    ix.append_documents(path, docs.where("doc_id >= 20"))
    assert rows(ix.load_index(spark, path)) == want
    whole = str(tmp_path / "whole")
    ix.write_index(docs, whole)
    files = (ix.load_index(spark, whole).groupBy("field", F.input_file_name().alias("f")).agg(F.min("term").alias("lo"), F.max("term").alias("hi"))
             .orderBy("field", "lo").collect())
    assert len(files) > 3 and all(a.field != b.field or a.hi < b.lo for a, b in zip(files, files[1:]))
    ix.write_index(docs.limit(0), str(tmp_path / "none"))


def test_term_table_is_written_once(spark, sf, monkeypatch):
    def no(df):
        raise AssertionError("postings are written before the table")

    want = rows(st.doc_freqs(ix.postings(spark.read.parquet(f"{sf}/documents.parquet"))))
    monkeypatch.setattr(tt, "cut", no)
    table, n = catalog._term_table(spark, sf)
    assert n == len(TEXTS) + 4 and rows(tt.table_doc_freqs(table)) == want
    monkeypatch.setattr(tt, "BUCKET_ROWS", 1)
    assert tt.enough_buckets(docs_df(spark, ["x y z " * 100])) == 300


def test_listed_cooccurrence_in_the_row(spark, docs):
    terms = spark.createDataFrame([(i, t) for i, t in enumerate(["w3", "from", "que", "absent"])], "pos long, term string")
    post = ix.postings(docs)
    a, b = (post.select("doc_id", F.col("term").alias(f"term_{x}")) for x in "ab")
    want = rows(a.join(b, "doc_id").where(F.col("term_a").isin("w3", "from", "que")).groupBy("term_a", "term_b").agg(F.count("*").alias("n_docs")))
    got = sm.term_cooccurrence_listed_of_sets(ix.document_sets(docs), terms)
    assert rows(got) == want == rows(sm.term_cooccurrence_listed(post, terms)) and want
    single = sm.term_cooccurrence_listed_of_sets(ix.document_sets(docs_df(spark, TEXTS)), terms)
    assert "Join" not in plan(single)  # documents are not joined with themselves


def test_long_list_of_cooccurrence(spark, docs, monkeypatch):
    terms = spark.createDataFrame([("w3",), ("from",), ("que",)], "term string")
    want = rows(sm.term_cooccurrence_listed(ix.postings(docs), terms))
    monkeypatch.setattr(sm, "LISTED", 1)
    assert rows(sm.term_cooccurrence_listed_of_sets(ix.document_sets(docs), terms)) == want


def test_cooccurrence_reads_listed_terms_only(spark, sf):
    """The plan filters terms by the list before they are exploded."""
    got = catalog.q_term_cooccurrence(spark, sf)
    want = sm.term_cooccurrence(ix.postings(spark.read.parquet(f"{sf}/documents.parquet")), catalog.fx.term_list(spark, catalog.M1_TERMS))
    assert rows(got) == rows(want) and "exists(" in plan(got)


def test_leading_terms_from_sets(spark, docs):
    for cutoff in (0.1, 0.9, 2.0):
        assert rows(st.leading_terms(set_doc_freqs(ix.document_sets(docs)), cutoff)) == rows(st.top_terms_cutoff(ix.postings(docs), cutoff))


def test_l1_without_a_window(spark, docs):
    def weights(df, *more):
        return df.select("doc_id", "term", F.col("tf").cast("double").alias("weight"), *more)

    want = rows(st.l1_normalize(weights(ix.postings(docs))))
    assert rows(st.l1_normalize(weights(ix.postings(docs, norm=True), "l1"), "l1")) == want
    single = st.l1_normalize(weights(ix.postings(docs_df(spark, TEXTS), norm=True), "l1"), "l1")
    assert "Window" not in plan(single) and "Sort " not in plan(single)


def test_frequent_terms_are_scored_where_they_are_read(spark, docs):
    post = ix.postings(docs)
    labels = docs.where("doc_id % 3 <> 0").select("doc_id", F.concat(F.lit("c"), F.col("doc_id") % 11).alias("category"))  # two blocks of classes
    model = nb.nb_train(post, labels)
    got = {sent: nb.nb_classify(post, docs, model, sent=sent) for sent in (1, 6, nb.SENT_TERMS)}
    all_sent = {(r.doc_id, r.predicted, round(r.score, 6)) for r in got[nb.SENT_TERMS].collect()}
    assert len(all_sent) >= len(TEXTS) and "SortMergeJoin [term" not in plan(got[nb.SENT_TERMS])
    for sent in (1, 6):
        assert {(r.doc_id, r.predicted, round(r.score, 6)) for r in got[sent].collect()} == all_sent
    assert got[6].count() == docs.count()
