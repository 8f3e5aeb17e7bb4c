"""The postings laid out by term: same results, and no shuffle of postings by term."""

import pytest

from conftest import docs_df
from textlytics.operators import stats as st
from textlytics.operators import term_table as tt
from textlytics.operators.index import postings


@pytest.mark.parametrize("part_rows", [1000, 7])
def test_table_by_term(spark, tmp_path, part_rows):
    """With one part, and with parts for a term that every document has."""
    docs = docs_df(spark, [f"every t{i % 13} t{i % 7} t{i}" for i in range(80)] + ["", None])
    post, path = postings(docs), str(tmp_path / "it's a table")
    n = docs.count()
    for table in (tt.save_term_table(post, n, path, 6, part_rows), tt.open_term_table(spark.newSession(), path)):
        assert table.select("part").distinct().count() == max(1, -(-n // part_rows))
        assert sorted(tt.table_doc_freqs(table).collect()) == sorted(st.doc_freqs(post).collect())
        assert sorted(tt.table_df_tf_listing(table).collect()) == sorted(st.df_tf_listing(post).collect())
        assert {(r.doc_id, r.term): round(r.weight, 9) for r in tt.table_tfidf_weights(table, n).collect()} == {
            (r.doc_id, r.term): round(r.weight, 9) for r in st.tfidf_weights(post, docs).collect()}


def test_plans_do_not_shuffle_postings(spark, tmp_path):
    docs = docs_df(spark, [f"every t{i % 13} t{i}" for i in range(50)])
    table = tt.save_term_table(postings(docs), 50, str(tmp_path / "t"), 4)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    counts = plan(tt.part_counts(table))
    assert "Exchange" not in counts and "Bucketed: true" in counts
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = plan(tt.table_df_tf_listing(table))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    # one exchange, and it stands over the written frequencies, not over the scan of the table
    assert joined.count("Exchange") == 1 and "Bucketed: true" in joined
    assert "FileScan" not in joined[joined.index("Exchange"):].split("Scan ExistingRDD")[0]
