"""Goldens transcribed from the original tool's stored outputs."""

import math

from pyspark.sql import functions as F

from conftest import docs_df
from textlytics.operators import classify as nb
from textlytics.operators import search as se
from textlytics.operators import similar as sm
from textlytics.operators import stats as st
from textlytics.operators.index import postings

# The scores of 11 hits in a corpus of 967 documents, by the number of terms
# of each hit (3, 5, 6 .. give the length norms).  The titles are made up.
SEARCH_GOLDEN = [
    ("permissions alpha beta", 2.694646),
    ("gamma permissions delta epsilon", 2.694646),
    ("zeta eta permissions theta", 2.694646),
    ("iota kappa lambda mu permissions", 2.3578153),
    ("nu xi omicron pi rho permissions", 2.0209844),
    ("sigma tau upsilon phi chi psi permissions", 2.0209844),
    ("omega north south east west permissions", 2.0209844),
    ("red green blue white black grey permissions", 2.0209844),
    ("one two three four five six permissions", 2.0209844),
    ("spring summer autumn winter dawn noon dusk night permissions", 1.6841537),
    ("oak elm ash pine yew fir beech permissions", 1.6841537),
]

# The top 20 terms with their document frequencies, in reported order.
TOP_TERMS_GOLDEN = [
    ("user", 96), ("error", 68), ("when", 66), ("report", 59), ("issue", 52), ("re", 52),
    ("course", 49), ("exam", 49), ("learning", 49), ("program", 42), ("ref", 42), ("impl", 39),
    ("enrollment", 37), ("from", 35), ("session", 33), ("module", 32), ("records", 32), ("tcc", 32),
    ("ekp", 30), ("page", 30),
]

# The reported cosines (3 decimals) between the first 20 documents, with the
# distinct-term counts and overlaps that explain them.
COSINE_TERMS = {0: 8, 4: 9, 5: 7, 7: 8, 9: 6, 11: 6, 17: 8, 18: 5, 19: 10}
COSINE_OVERLAP = {(0, 18): 1, (0, 19): 3, (4, 7): 1, (4, 9): 1, (4, 17): 1, (5, 19): 1,
                  (9, 19): 1, (11, 17): 1, (11, 19): 1, (18, 19): 1}
COSINE_GOLDEN = {(0, 18): 0.158, (0, 19): 0.335, (4, 7): 0.118, (4, 9): 0.136, (4, 17): 0.118,
                 (5, 19): 0.120, (9, 19): 0.129, (11, 17): 0.144, (11, 19): 0.129, (18, 19): 0.141}

# A confusion matrix over 9 categories (rows actual, columns predicted).
NB_CATEGORIES = [f"category{i}" for i in range(9)]
NB_MATRIX = [
    [4, 0, 0, 0, 0, 0, 0, 0, 1],
    [0, 7, 0, 0, 0, 0, 0, 0, 0],
    [0, 0, 0, 0, 0, 0, 0, 0, 0],
    [0, 0, 0, 5, 0, 0, 0, 0, 0],
    [0, 0, 0, 0, 5, 0, 0, 0, 0],
    [0, 0, 0, 0, 0, 5, 0, 0, 0],
    [0, 0, 0, 0, 0, 0, 5, 0, 0],
    [0, 0, 0, 0, 0, 0, 0, 5, 0],
    [0, 0, 0, 0, 0, 0, 0, 0, 5],
]


def test_search_scores_match_golden(spark):
    titles = [t for t, _ in SEARCH_GOLDEN] + [f"filler ticket number {i}" for i in range(967 - 11)]
    d = docs_df(spark, titles)
    res = se.search_keyword(postings(d), d, "permissions", 100).orderBy("rank").collect()
    assert len(res) == 11
    for r, (_, score) in zip(res, SEARCH_GOLDEN):
        assert abs(r["score"] - score) < 2e-6
    assert [r["doc_id"] for r in res] == list(range(11))


def test_search_results_table_counts_hits(spark):
    titles = [t for t, _ in SEARCH_GOLDEN] + ["nothing here"] * 10
    d = docs_df(spark, titles)
    rows = se.search_results_table(postings(d), d, "permissions", 5).collect()
    assert len(rows) == 5 and {r["matched"] for r in rows} == {5}
    assert sorted(r["rank"] for r in rows) == [0, 1, 2, 3, 4]


def _nested_corpus(spark):
    """Document i holds every golden term whose df exceeds i: df(term) = golden df."""
    texts = [" ".join(t for t, df in TOP_TERMS_GOLDEN if df > i) for i in range(96)]
    return docs_df(spark, texts)


def test_top_terms_tie_order(spark):
    d = _nested_corpus(spark)
    got = [(r["term"], r["df"]) for r in st.top_terms(postings(d), 0.1, 20).orderBy("rank").collect()]
    assert got == TOP_TERMS_GOLDEN


def test_cooccurrence_diagonal_and_bounds(spark):
    d = _nested_corpus(spark)
    terms = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TOP_TERMS_GOLDEN)], "pos long, term string")
    cells = sm.term_cooccurrence(postings(d), terms).collect()
    assert len(cells) == 20 * 21 // 2
    dfs = dict(TOP_TERMS_GOLDEN)
    for c in cells:
        if c["pos_a"] == c["pos_b"]:
            assert c["n_docs"] == dfs[c["term_a"]]
        assert c["n_docs"] <= min(dfs[c["term_a"]], dfs[c["term_b"]])


def test_cosine_matches_golden(spark):
    words = {i: [] for i in range(20)}
    for (i, j), o in COSINE_OVERLAP.items():
        for k in range(o):
            words[i].append(f"s{i}x{j}x{k}")
            words[j].append(f"s{i}x{j}x{k}")
    for i in range(20):
        want = COSINE_TERMS.get(i, 3)
        words[i] += [f"u{i}x{k}" for k in range(want - len(words[i]))]
    d = docs_df(spark, [" ".join(words[i]) for i in range(20)])
    got = {(r["doc_a"], r["doc_b"]): r["cosine"] for r in sm.pairwise_cosine(postings(d), 0.01).collect()}
    assert set(got) == set(COSINE_GOLDEN)
    for k, v in COSINE_GOLDEN.items():
        assert f"{got[k]:.3f}" == f"{v:.3f}"


def test_accuracy_from_golden_matrix(spark):
    rows = [(a, p, NB_MATRIX[i][j]) for i, a in enumerate(NB_CATEGORIES) for j, p in enumerate(NB_CATEGORIES)]
    cm = spark.createDataFrame(rows, "actual string, predicted string, n long")
    r = nb.accuracy_error(cm).collect()[0]
    assert r["total"] == 42 and r["correct"] == 41
    assert math.isclose(r["accuracy"], 41 / 42) and math.isclose(r["error_rate"], 1 / 42)


def test_accuracy_empty_is_null(spark):
    cm = spark.createDataFrame([("a", "a", 0)], "actual string, predicted string, n long")
    r = nb.accuracy_error(cm).collect()[0]
    assert r["accuracy"] is None and r["error_rate"] is None


def test_length_norm_values(spark):
    from textlytics.functions.text import length_norm
    df = spark.range(1, 13).select(length_norm(F.col("id")).alias("n"))
    got = [r["n"] for r in df.orderBy(F.desc("n")).collect()]
    assert got == [1.0, .625, .5, .5, .4375, .375, .375, .3125, .3125, .3125, .25, .25]
