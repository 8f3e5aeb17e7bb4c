"""Streams: deltas of document frequencies, killed batches, and long keyword lists."""

import os
from collections import Counter

from conftest import docs_df
from pyspark.sql import functions as F

from textlytics.operators import matching as mt
from textlytics.streaming import terms as stm

SCHEMA = "doc_id long, text string"


def put(spark, path, number, texts):
    spark.createDataFrame([(number * 100 + i, t) for i, t in enumerate(texts)], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def result(df):
    return {r.term: r.df for r in df.collect()}


def test_batches_write_what_they_change(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    batches = [["alpha beta", "alpha"], ["beta gamma"], ["delta", None, ""], ["alpha delta eps", "eps"], ["beta"], ["zeta"], ["alpha"]]
    want = Counter()
    for n, texts in enumerate(batches):
        put(spark, src, n, texts)
        got = result(stm.run_term_doc_freq(spark, src, SCHEMA, out, compact_every=2))
        want.update(t for x in texts for t in set((x or "").split()))
        assert got == want
        delta = spark.read.parquet(f"{out}/result/epoch={n}")
        assert {r.term for r in delta.collect()} == {t for x in texts for t in (x or "").split()}
        # a batch that was killed while it wrote: its folder has rows but was not committed
        torn = f"{out}/result/epoch={n + 1}"
        spark.createDataFrame([("alpha", 10**6), ("torn", 1)], "term string, df long").write.parquet(torn)
        os.remove(f"{torn}/_SUCCESS")
        assert result(stm.read_term_doc_freq(spark, out)) == want
    kept = sorted(os.listdir(f"{out}/result"))
    assert "base=5" in kept and "base=3" in kept and "base=1" not in kept and "epoch=3" not in kept and "epoch=4" in kept


def test_nothing_yet(spark, tmp_path):
    assert stm.read_term_doc_freq(spark, str(tmp_path / "none")).collect() == []


def test_long_list_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "tickets")
    texts = [f"policy{i * 37} status é😀{i}" for i in range(40)] + [None, ""]
    put(spark, src, 0, texts)
    kw = spark.range(1500).selectExpr("id AS kw_idx", "concat('policy', id) AS keyword").union(
        spark.createDataFrame([(2000, "é😀3"), (2001, "é😀3"), (2002, "st"), (2003, "")], "kw_idx long, keyword string"))
    got = stm.run_keyword_tagging(spark, src, SCHEMA, kw, str(tmp_path / "out"))
    keywords = [r.keyword for r in kw.collect() if r.keyword]
    want = Counter((i, k) for i, t in enumerate(texts) for k in keywords if t and k in t)
    assert Counter((r.id, r.keyword) for r in got.collect()) == want


def test_signatures_tell_keywords_with_one_beginning_apart(spark):
    kw = spark.range(2000).select(F.concat(F.lit("payment policy "), F.lpad(F.col("id").cast("string"), 4, "0")).alias("keyword"))
    texts = docs_df(spark, ["payment policy " + str(i) for i in range(1000, 1020)]).select(F.col("text").alias("_lower"))
    found = mt.signatures(kw, texts)
    assert found.count() == 2000 and found.groupBy("gram").count().agg(F.max("count")).first()[0] < 60


def test_long_list_shuffles_no_text_for_its_matches(spark, monkeypatch):
    """The same rows, whether the signatures are sent to the texts or, as for a longer list, meet the numbers of texts only."""
    kw = spark.createDataFrame([(f"word{i % 700:03d}",) for i in range(900)], "keyword string")
    texts = ["word001 word002", "xword699 word0", "", None, "word001 word002"]
    tickets = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts)] + [(None, "word010")], "id long, title string")
    want = Counter((i, k.keyword) for i, t in [(r.id, r.title) for r in tickets.collect()] for k in kw.collect() if t and k.keyword in t)
    monkeypatch.setattr(mt, "GRAM", 7)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = mt.keyword_matches(tickets, kw, "id")
        plan = sent._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(mt, "SENT_KEYWORDS", 5)
        met = mt.keyword_matches(tickets, kw, "id")
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        for got in (sent, met):
            assert Counter(map(tuple, got.collect())) == want and len(want) == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
