"""Naive Bayes with more classes than a block of class vectors holds."""

import math
from collections import Counter, defaultdict

from textlytics.operators import classify as nb
from textlytics.operators.index import postings


def test_many_classes(spark):
    n, k = 300, 60
    texts = [" ".join(f"t{(i * i + j * 7) % 41}" for j in range(i % 6)) for i in range(n)]
    labels = [None if i % 11 == 0 else f"c{i % k:03d}" for i in range(n)]
    d = spark.createDataFrame(list(zip(range(n), texts, labels)), "doc_id long, text string, category string")
    post = postings(d)
    model = nb.nb_train(post, d.where("category IS NOT NULL"))
    vectors = model.vectors.collect()
    assert max(r.block for r in vectors) == (k - 1) // nb.BLOCK
    terms = defaultdict(set)
    for t, c in zip(texts, labels):
        for x in t.split():
            if c:
                terms[x].add(int(c[1:]) // nb.BLOCK)
    assert Counter(r.term for r in vectors) == {t: len(b) for t, b in terms.items() if b}
    got = {r.doc_id: r for r in nb.nb_classify(post, d, model).collect()}
    size, hits = Counter(c for c in labels if c), Counter((x, c) for t, c in zip(texts, labels) if c for x in set(t.split()))
    total, u = sum(size.values()), sum(len(set(t.split())) for t in texts) / sum(1 for t in texts if t)
    for i, t in enumerate(texts):
        score = {c: math.log(size[c]) - math.log(total) + sum(math.log(hits[x, c] + 1) - math.log(u * size[c] + total) for x in t.split())
                 for c in size}
        best = max(score.values())
        assert math.isclose(got[i].score, best, rel_tol=1e-9) and math.isclose(score[got[i].predicted], best, rel_tol=1e-9)
