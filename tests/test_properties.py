"""Properties checked against plain-Python brute force on small random corpora."""

import math
from collections import Counter

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from conftest import docs_df
from textlytics.operators import classify as nb
from textlytics.operators import matching as mt
from textlytics.operators import reports as rp
from textlytics.operators import similar as sm
from textlytics.operators import stats as st
from textlytics.operators.index import postings
from textlytics.operators.ordering import running_totals

VOCAB = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
corpora = hs.lists(hs.lists(hs.sampled_from(VOCAB), min_size=0, max_size=8), min_size=2, max_size=12)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck),
                    phases=[Phase.explicit, Phase.reuse, Phase.generate])


def _sets(docs):
    return [set(d) for d in docs]


@SETTINGS
@given(corpora)
def test_coverage_equals_greedy_loop(spark, docs):
    d = docs_df(spark, [" ".join(x) for x in docs])
    got = {r.term: (r.n_new, r.covered, r.covered_share) for r in rp.term_distribution(postings(d), d).collect()}
    sets = _sets(docs)
    df = Counter(t for s in sets for t in s)
    order = sorted(df, key=lambda t: (-df[t], t))
    covered, total = set(), 0
    for t in order:
        new = {i for i, s in enumerate(sets) if t in s} - covered
        covered |= new
        total += len(new)
        assert got[t][0] == len(new) and got[t][1] == total
        assert math.isclose(got[t][2], total / len(docs))
    assert total == sum(1 for s in sets if s)


@SETTINGS
@given(corpora)
def test_cosine_and_cooccurrence_brute_force(spark, docs):
    d = docs_df(spark, [" ".join(x) for x in docs])
    post = postings(d)
    sets = _sets(docs)
    for least in (0.01, 0.5, 0.8, 1.0):
        cos = {(r.doc_a, r.doc_b): r.cosine for r in sm.pairwise_cosine(post, least).collect()}
        want = {}
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                ov = len(sets[i] & sets[j])
                if ov and round(ov / math.sqrt(len(sets[i]) * len(sets[j])), 9) >= least:
                    want[(i, j)] = ov / math.sqrt(len(sets[i]) * len(sets[j]))
        assert set(cos) == set(want)
        assert all(math.isclose(cos[k], v, abs_tol=1e-8) for k, v in want.items())
    listed = VOCAB[:4]
    terms = spark.createDataFrame(list(enumerate(listed)), "pos long, term string")
    pairs = {(r.term_a, r.term_b): r.n_docs for r in sm.term_cooccurrence_listed(post, terms).collect()}
    want2 = Counter((a, b) for s in sets for a in s for b in s)
    assert pairs == {k: v for k, v in want2.items() if k[0] in listed}
    cells = {(r.term_a, r.term_b): r.n_docs for r in sm.term_cooccurrence(post, terms).collect()}
    assert cells == {(a, b): want2.get((a, b), 0) for i, a in enumerate(listed) for b in listed[i:]}
    chosen = spark.createDataFrame([(0, 1), (1, 0), (2, 99)], "pos long, doc_id long")
    got = {(r.doc_a, r.doc_b): r.value for r in sm.cosine_matrix(post, chosen).collect()}
    ov = len(sets[0] & sets[1])
    assert set(got) == {(1, 0), (1, 99), (0, 99)} and got[(1, 99)] == 0
    assert math.isclose(got[(1, 0)], ov / math.sqrt(len(sets[0]) * len(sets[1])) if ov else 0.0)


@SETTINGS
@given(corpora)
def test_running_totals_equals_python(spark, docs):
    d = docs_df(spark, [" ".join(x) for x in docs])
    dfs = st.doc_freqs(postings(d)).withColumn("w", F.length("term"))
    got = running_totals(dfs, [F.desc("df"), F.asc("term")], {"cum": "w"}, partitions=3).collect()
    rows = sorted(((r.df, r.term, r.w, r["rank"], r.cum) for r in got), key=lambda x: (-x[0], x[1]))
    cum = 0
    for i, (_, term, w, rank, c) in enumerate(rows, 1):
        cum += w
        assert rank == i and c == cum


@SETTINGS
@given(corpora, hs.lists(hs.sampled_from(["x", "y"]), min_size=12, max_size=12))
def test_naive_bayes_sparse_equals_naive(spark, docs, labels):
    texts = [" ".join(x) for x in docs]
    d = spark.createDataFrame([(i, t, labels[i]) for i, t in enumerate(texts)], "doc_id long, text string, category string")
    post = postings(d)
    pred = {r.doc_id: (r.predicted, r.score) for r in nb.nb_classify(post, d, nb.nb_train(post, d)).collect()}
    # naive form, straight from the formula
    n_docs_terms = [len(set(x)) for x in docs]
    with_terms = sum(1 for n in n_docs_terms if n)
    u = sum(n_docs_terms) / with_terms if with_terms else 0.0
    classes = sorted(set(labels[:len(docs)]))
    D = len(docs)
    for i, toks in enumerate(docs):
        best = None
        for c in classes:
            dc = sum(1 for j in range(D) if labels[j] == c)
            s = math.log(dc) - math.log(D)
            den = math.log(u * dc + D)
            for t in toks:
                hits = sum(1 for j in range(D) if labels[j] == c and t in docs[j])
                s += math.log(hits + 1) - den
            if best is None or s > best[1] + 1e-9:
                best = (c, s)
        assert pred[i][0] == best[0]
        assert math.isclose(pred[i][1], best[1], rel_tol=1e-9, abs_tol=1e-9)


def test_detail_report_rows_do_not_depend_on_the_list_length(spark, monkeypatch):
    titles = ["Payment Policy broken", "transcript status wrong", "nothing", "policy policy", None, "", "é😀x zz"]
    t = spark.createDataFrame([*enumerate(titles), (0, titles[0])], "id long, title string")  # a repeated id
    kws = ["policy", "payment policy", "status", "policy", "zzz", "zz", "z", "😀x", "", "é"]
    kw = spark.createDataFrame(list(enumerate(kws)), "kw_idx long, keyword string")
    want = sorted((i, x, k) for i, x in [*enumerate(titles), (0, titles[0])] for k in kws if k and x and k in x.lower())
    for in_row in (500, 0):
        got = mt.keyword_matches(t, kw, "id", "title", in_row=in_row).select("id", "title", "keyword").collect()
        assert sorted(map(tuple, got)) == want
    many = spark.range(1001).selectExpr("id AS kw_idx", "concat('policy', if(id < 7, '', string(id))) AS keyword")
    assert rp.keyword_detail_report(t, many).count() == 7 * 3
    assert rp.keyword_detail_report(t, many.limit(0)).count() == 0


def test_long_term_list(spark):
    d = docs_df(spark, ["alpha beta", "beta"])
    terms = spark.range(1001).selectExpr("id AS pos", "if(id = 0, 'alpha', if(id = 1, 'beta', concat('t', id))) AS term")
    cells = sm.term_cooccurrence(postings(d), terms).where("n_docs > 0").collect()
    assert {(r.term_a, r.term_b): r.n_docs for r in cells} == {("alpha", "alpha"): 1, ("alpha", "beta"): 1, ("beta", "beta"): 2}


def test_top_terms_cutoff_keeps_one_of_tied_terms(spark):
    post = postings(docs_df(spark, ["alpha beta", "alpha beta", "alpha beta gamma", "gamma"]))
    for cutoff, want in ((1.0, ["alpha"]), (2.0, ["alpha"]), (0.5, ["alpha", "beta", "gamma"]), (0.7, ["alpha", "beta"])):
        assert [r.term for r in st.top_terms_cutoff(post, cutoff).collect()] == want


def test_summary_report_each_keyword_df_one(spark):
    texts = ["alpha one", "beta two", "gamma three", "delta four", "eps five", "zeta six", "none here"]
    d = docs_df(spark, texts)
    kw = spark.createDataFrame(list(enumerate(["alpha", "beta", "gamma", "delta", "eps", "zeta", "two words"])),
                               "kw_idx long, keyword string")
    rows = rp.keyword_summary_report(postings(d), d, kw).collect()
    assert len(rows) == 6 and all(r.n_reports == 1 and r.n_new_covered == 1 for r in rows)
    assert math.isclose(max(r.pct_total_covered for r in rows), 6 / 7)
