"""Listed terms without analysing every text, and coverage in two phases."""

from collections import Counter

from pyspark.sql import functions as F

from conftest import docs_df
from textlytics.operators import reports as rp
from textlytics.operators import search as se
from textlytics.operators.index import listed_postings, postings

TEXTS = ["Alpha beta ALPHA", "alphabet soup", "", None, "İstanbul don't", "the the", "beta.gamma 3.14", "é😀x zz " * 50, "gamma", "delta " + "x" * 300]
LIST = ["alpha", "beta", "istanbul", "i̇stanbul", "don't", "the", "3.14", "beta.gamma", "é", "x", "absent", None, "alpha"]


def test_listed_postings_are_those_of_all_postings(spark):
    d = docs_df(spark, TEXTS)
    terms = spark.createDataFrame([(t,) for t in LIST], "term string")
    want = sorted(map(tuple, postings(d).where(F.col("term").isin([t for t in LIST if t])).collect()))
    for listed in (500, 3):  # also a list that is longer than what travels in the row
        assert sorted(map(tuple, listed_postings(d, terms, listed=listed).collect())) == want and want
    assert listed_postings(d, terms.limit(0)).collect() == []


def test_only_texts_with_a_listed_term_are_analysed(spark, tmp_path):
    """The filter stands below the analyser, and searches give the same rows."""
    path = str(tmp_path / "d.parquet")
    docs_df(spark, [f"word{i} common" + (" needle" if i % 10 == 0 else "") for i in range(200)]).repartition(16).write.parquet(path)
    d = spark.read.parquet(path)
    kw = se.single(spark, "Needle")
    post = listed_postings(d, se.keyword_terms(kw))
    plan = post._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_extract_all") < plan.index("Filter exists(")
    assert sorted(map(tuple, se.batch_search(post, d, kw).collect())) == sorted(map(tuple, se.batch_search(postings(d), d, kw).collect()))


def test_coverage_does_not_depend_on_the_leading_terms(spark):
    docs = [[f"t{(i * j) % 23}" for j in range(i % 6)] for i in range(60)] + [[]]
    d = docs_df(spark, [" ".join(x) for x in docs])
    sets = rp.term_sets(postings(d)).cache()
    dfs = rp.set_doc_freqs(sets).cache()
    df = Counter(t for x in docs for t in set(x))
    want = Counter(min(x, key=lambda t: (-df[t], t)) for x in docs if x)
    for top in (256, 2, 0):
        assert {r.term: r.n_new for r in rp.first_covers(sets, dfs, top).collect()} == want


def test_postings_are_made_in_the_row_and_repeated_ids_count_together(spark, monkeypatch):
    from textlytics.operators import index as ix
    rows = [(1, "red apple red"), (2, "green"), (1, "apple pie"), (None, "null id"), (None, "null null"), (3, None), (4, "the"), (5, "zz aa zz zz")]
    once = spark.createDataFrame([r for r in rows if r[0] not in (1, None)], "doc_id long, text string")
    assert "Aggregate" not in postings(once)._jdf.queryExecution().optimizedPlan().toString()
    d = spark.createDataFrame(rows, "doc_id long, text string")
    tf, length, terms = {}, {}, {}
    for i, t in rows:
        words = [w for w in (t or "").split() if w != "the"]
        for w in words:
            tf[i, w] = tf.get((i, w), 0) + 1
            length[i, w] = max(length.get((i, w), 0), len(words))
            terms[i, w] = max(terms.get((i, w), 0), len(set(words)))
    want = {(*k, n, length[k], terms[k]) for k, n in tf.items()}
    for most in (200_000, 1):
        monkeypatch.setattr(ix, "REPEATED_IDS", most)
        got = [tuple(r) for r in postings(d).collect()]
        assert set(got) == want and len(got) == len(want)
        got = [(r.doc_id, r.term, r.tf, r.doc_len, r.doc_terms) for r in ix.index_documents(d).collect()]
        assert set(got) == want and len(got) == len(want)
