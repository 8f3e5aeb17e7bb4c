"""Operators that compare texts: lines, near copies, benchmark passages, repeated strings, groups."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tables import empty, stored, words
from pyspark.sql import functions as F

from textlytics.llm import decontamination, edits, groups, line_dedup, near_dedup, suffix_dedup
from textlytics.llm.common import PrefixHash, bitmap, numbered, passes, passing, shingle_hashes, word_hashes, written


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def changed(text, seed, n, of=" "):
    r = random.Random(seed)
    w = text.split(of)
    for i in r.sample(range(len(w)), n):
        w[i] = f"zz{seed}x{i}"
    return of.join(w)


# ---------------------------------------------------------------- helpers


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té中", max_size=12), min_size=1, max_size=6))
def test_word_hashes_are_those_of_words(texts):
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    h, row, start, end = word_hashes(np.frombuffer(b"".join(raw), np.uint8), offs, lower=False)
    want = [(i, w) for i, x in enumerate(raw) for w in x.split()]
    assert [i for i, _ in want] == row.tolist() and [b"".join(raw)[a:b] for a, b in zip(start, end)] == [w for _, w in want]
    seen = {}
    for (_, w), x in zip(want, h):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    s, srow = shingle_hashes(h, row, 3, len(raw))
    count = Counter(i for i, _ in want)
    assert Counter(srow.tolist()) == Counter({i: max(1, n - 2) for i, n in count.items()})


def test_bitmap_lets_all_members_pass(spark):
    keys = spark.range(500).select(F.xxhash64("id").alias("k"))
    h = np.array([r.k for r in keys.collect()])
    words_ = bitmap(keys, "k", 12)
    assert passes(words_, h).all() and passes(words_, h.view(np.uint64)).all()
    assert not bitmap(keys.limit(0), "k", 12).any()


def test_components_match_union_find(spark):
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000, 1000 + i) for i in range(1, 60)]
    links += [(2000 + i, 2001 + i) for i in range(40)]
    got = {x.node: x.root for x in groups.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == roots(nodes, links)
    assert groups.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_connected_loses_no_link_of_a_large_bucket(spark):
    """Links that no centre sees: consecutive numbers, all in one bucket."""
    n = 90
    members = spark.createDataFrame([(1, i, 0) for i in range(n)] + [(2, n + 5, 0)], "bucket long, node long, sketch long")
    step = lambda pairs: pairs.where("b - a = 1 and b <> 40")
    want = {i: 0 if i < 40 else 40 for i in range(n)}
    for bound in (None, lambda nodes: nodes.selectExpr("node", "10 AS size", "0 AS own", "0L AS w0_")):
        got = {x.node: x.root for x in groups.connected(members, 0, step, bound, 0.5, 0).collect()}
        assert got == want


# ---------------------------------------------------------------- lines


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abé ", max_size=18), st.text(alphabet="abé ", max_size=18), st.sampled_from([0.3, 0.6, 0.8, 0.9]))
def test_edit_similarity(a, b, similarity):
    most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    assert line_dedup.edit_similar(a, b, similarity) == (distance(a, b) <= most)


def test_lines_match_brute_force(spark, tmp_path):
    long_line = words(1, 60)
    base = [words(100 + i, 25) for i in range(40)]
    texts = []
    for i in range(60):
        lines = [base[i % 40], changed(base[(i * 7) % 40], i, 1), "short line", "", long_line if i % 3 else changed(long_line, i, 1)]
        texts.append("\n".join(lines[: 2 + i % 4]))
    texts += ["", "\n\n", base[0].upper() + "\n" + base[0].replace(" ", "  "), words(9, 3000)]
    docs = stored(spark, tmp_path, texts, extra=[(2, texts[2]), (2, texts[2]), (None, texts[5]), (None, None), (88, None)])
    got = line_dedup.deduplicated(docs, drop_emptied=False)
    assert got.columns == docs.columns
    rows = numbered(docs).collect()
    occ = sorted(((r.doc_id is not None, r.doc_id, r.row, j), line_dedup.normalise(x)) for r in numbered(docs.select("doc_id", "text")).collect()
                 for j, x in enumerate((r.text or "").split("\n")) if line_dedup.normalise(x).split())
    lines = list(dict.fromkeys(x for _, x in occ))
    links = [(i, j) for i in range(len(lines)) for j in range(i)
             if line_dedup.edit_similar(lines[i], lines[j], line_dedup.SIMILARITY)]
    root, number = roots(range(len(lines)), links), {x: i for i, x in enumerate(lines)}
    seen, drop = set(), defaultdict(set)
    for (_, _, r, j), x in occ:
        k = root[number[x]]
        if k in seen:
            drop[r].add(j)
        seen.add(k)
    assert links and sum(map(len, drop.values())) > 40
    want = Counter()
    for r in numbered(docs.select("doc_id", "text")).collect():
        kept = None if r.text is None else "\n".join(x for j, x in enumerate(r.text.split("\n")) if j not in drop[r.row])
        want[r.doc_id, kept] += 1
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert len(rows) == sum(want.values())
    fewer = line_dedup.deduplicated(docs).collect()
    assert all(r.text is None or r.text.split() or r.text in ("", "\n\n") for r in fewer)


def removed_by_edit_similarity(rows):
    """(row, line) of the lines that repeat others by edit similarity alone, from all pairs."""
    occ = sorted(((r.doc_id is not None, r.doc_id, r.row, j), line_dedup.normalise(x)) for r in rows
                 for j, x in enumerate((r.text or "").split("\n")) if line_dedup.normalise(x).split())
    lines = list(dict.fromkeys(x for _, x in occ))
    links = [(i, j) for i in range(len(lines)) for j in range(i) if line_dedup.edit_similar(lines[i], lines[j], line_dedup.SIMILARITY)]
    root, number, seen, gone = roots(range(len(lines)), links), {x: i for i, x in enumerate(lines)}, set(), set()
    for (*_, r, j), x in occ:
        if root[number[x]] in seen:
            gone.add((r, j))
        seen.add(root[number[x]])
    return gone


def test_lines_match_edit_similarity_alone(spark, tmp_path):
    texts = []
    for i in range(40):
        line = words(100 + i, 10 + 4 * i)
        texts += [line, changed(line, i, 1) + "\n" + words(900 + i, 30), line[:20] + line[20 + len(line) // 12:]]
    rows = numbered(stored(spark, tmp_path, texts).select("doc_id", "text"))
    want = removed_by_edit_similarity(rows.collect())
    assert len(want) > 70 and {(r.row, r.line) for r in line_dedup.repeats(rows).collect()} == want


def test_short_lines_take_part():
    texts = ["Yes", "yes\n\n - \nno", "短い行は単語が一つしかない行です", "短い行は単語が一つしかない行です\n-- 7"]
    got = list(line_dedup._lines(texts))
    assert [(i, j) for i, j, _ in got] == [(0, 0), (1, 0), (1, 3), (2, 0), (3, 0), (3, 1)]
    bands, _ = line_dedup.fingerprints([x for *_, x in got])
    assert (bands[0] == bands[1]).all() and (bands[3] == bands[4]).all()


def test_other_figures_are_other_lines(spark, tmp_path):
    texts = ["12 34 56 78", "98 76 54 32", "- 3 + 4 ..", "+ 3 - 4 ..", "12  34 56 78\nyes\n98 76 54 32", "Yes\n- 3 + 4 .."]
    rows = numbered(stored(spark, tmp_path, texts).select("doc_id", "text"))
    at = {r.row: r.doc_id for r in rows.collect()}
    got = {(at[r.row], r.line) for r in line_dedup.repeats(rows).collect()}
    assert got == {(4, 0), (4, 2), (5, 0), (5, 1)}


def test_fingerprints_meet_with_the_stated_chance():
    r = random.Random(8)
    lines, others = [words(i, 6 + i % 90) for i in range(400)], []
    for x in lines:  # the hardest case: a tenth of the characters substituted, anywhere
        y = list(x)
        for k in r.sample(range(len(y)), len(y) // 10):
            y[k] = "#"
        others.append("".join(y))
    (a, s), (b, t) = line_dedup.fingerprints(lines), line_dedup.fingerprints(others)
    assert np.mean((a == b).any(1) & (np.bitwise_count(s ^ t) <= line_dedup.MAX_BITS)) > 0.88
    one = line_dedup.fingerprints(lines[5:6])
    assert (one[0] == a[5]).all() and one[1] == s[5]


def test_lines_of_a_common_vocabulary_are_no_candidates(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    parts = ["".join(r.choice("abcdefghij") for _ in range(2 + k % 3)) for k in range(24)]
    lines = [" ".join("".join(r.choice(parts) for _ in range(1 + r.randrange(4))) for _ in range(30)) for _ in range(1200)]
    near = [x[:40] + "#" + x[41:] for x in lines[:30]]
    rows = numbered(stored(spark, tmp_path, ["\n".join(lines[i:i + 40]) for i in range(0, 1200, 40)] + near).select("doc_id", "text"))
    asked, verifier = [], line_dedup._verifier

    def counted(*args):
        verify = verifier(*args)

        def run(pairs):
            asked.append(pairs.count())
            return verify(pairs)
        return run

    monkeypatch.setattr(line_dedup, "_verifier", counted)
    assert line_dedup.repeats(rows).count() == 30 and 30 <= sum(asked) < 120


def test_candidates_of_buckets_cut_by_steps(monkeypatch):
    import pyarrow as pa
    from pyspark.sql import types as T

    class Sorted:
        schema = T.StructType([T.StructField(c, T.LongType()) for c in line_dedup._MEMBER])

        def mapInArrow(self, run, schema):
            return run

    r = random.Random(4)
    counts = [1, 2, 3, line_dedup.FEW, line_dedup.FEW + 1, 60, 1, 5, 40, 2]
    bucket = np.repeat(np.arange(len(counts)), counts)
    node = np.array(r.sample(range(1000), len(bucket)))
    table = {c: np.zeros(len(bucket), np.int64) for c in line_dedup._MEMBER} | {"bucket": bucket, "node": node, "size": np.full(len(bucket), 50)}
    want = {tuple(sorted((int(node[i]), int(node[j])))) for i in range(len(node)) for j in range(i)
            if bucket[i] == bucket[j] and counts[bucket[i]] <= line_dedup.FEW}
    large = {(int(b), int(n)) for b, n in zip(bucket, node) if counts[b] > line_dedup.FEW}
    for rows, step in ((7, 20), (1, 1), (200, 1000), (3, 18)):
        monkeypatch.setattr(line_dedup, "PASS_ROWS", step)
        batches = pa.Table.from_pydict(table).to_batches(max_chunksize=rows)
        got = [x for b in line_dedup._candidates(Sorted(), 0.9)(iter(batches)) for x in b.to_pylist()]
        assert sorted((x["node"], x["other"]) for x in got if x["other"] is not None) == sorted(want)
        assert sorted((x["bucket"], x["node"]) for x in got if x["other"] is None) == sorted(large)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abé\U0001F600 ", max_size=80), st.integers(0, 9**9)), min_size=1, max_size=12), st.sampled_from([0.5, 0.8, 0.9, 1.0]))
def test_edit_distances_of_many_pairs(texts, least):
    a, b = [], []
    for x, seed in texts:
        r, y = random.Random(seed), list(x)
        for _ in range(r.randrange(9)):
            y.insert(r.randrange(len(y) + 1), r.choice("abz")) if r.random() < 0.5 else y and y.pop(r.randrange(len(y)))
        a.append(x)
        b.append("".join(y))
    want = [distance(x, y) <= int((1 - least) * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b)]
    assert [line_dedup.edit_similar(x, y, least) for x, y in zip(a, b)] == want
    assert edits.similar(a, b, least, line_dedup.edit_similar).tolist() == want
    assert edits.similar(a * 60, b * 60, least, line_dedup.edit_similar).tolist() == want * 60
    able = [i for i in range(len(a)) if abs(len(a[i]) - len(b[i])) <= (1 - least) * max(len(a[i]), len(b[i])) + 1e-9]
    if able:
        most = np.array([int((1 - least) * max(len(a[i]), len(b[i])) + 1e-9) for i in able])
        assert edits._within([a[i] for i in able], [b[i] for i in able], most).tolist() == [want[i] for i in able]


def test_edit_distance_of_long_lines():
    a = words(3, 700)
    for n, far in ((1, False), (5, False), (400, True)):
        b = changed(a, n, n)
        assert line_dedup.edit_similar(a, b, 0.9) == edits._within([a], [b], np.array([int(0.1 * max(len(a), len(b)))]))[0] == (not far)


def test_lines_leave_no_table_and_few_texts_on_disk(spark, tmp_path, monkeypatch):
    """Tables on the way go, and texts are shuffled for a few pairs at a time, with the same lines removed."""
    import glob

    texts = ["\n".join([words(i % 30, 20 + i % 30), changed(words(i % 30, 20 + i % 30), i, 1)]) for i in range(90)]
    rows = numbered(stored(spark, tmp_path, texts).select("doc_id", "text"))
    home = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    asked = []
    for most in (1 << 18, 20):
        monkeypatch.setattr(line_dedup, "VERIFIED", most)
        before = set(glob.glob(f"{home}/llm/*"))
        with passing(spark) as keep:
            got = keep(written(line_dedup.repeats(rows), "repeats"))
        left = set(glob.glob(f"{home}/llm/*")) - before
        asked.append(sorted(map(tuple, got.collect())))
        assert len(left) == 1 and next(iter(left)).rpartition("/")[2].startswith("repeats-")
    assert asked[0] == asked[1] and len(asked[0]) > 60


def test_components_on_the_driver_and_not(spark, monkeypatch):
    r = random.Random(8)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(110)] + [(300 + i, 301 + i) for i in range(30)]
    df = spark.createDataFrame(links, "a long, b long")
    few = sorted(map(tuple, groups.components(df).collect()))
    monkeypatch.setattr(groups, "FEW_LINKS", 0)
    assert few == sorted(map(tuple, groups.components(df).collect()))


def test_packed_members_are_those_of_buckets():
    import pyarrow as pa

    r = np.random.default_rng(2)
    x = np.zeros(500, line_dedup._RECORD)
    x["bucket"], x["node"] = r.integers(0, 200, 500), r.permutation(500)
    part = (x["bucket"] % 7).astype(np.int32)
    cut = [(p, x[k::3][part[k::3] == p].tobytes()) for p in range(7) for k in range(3)]
    batches = [pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.int32()), pa.array([m for _, m in some], pa.binary())], names=["part", "members"])
               for some in (cut[:5], cut[5:6], cut[6:])]
    got = [(m["bucket"], m["node"]) for b in line_dedup._unpacked(iter(batches)) for m in b.to_pylist()]
    count = Counter(x["bucket"].tolist())
    assert sorted(got) == sorted((b, n) for b, n in zip(x["bucket"].tolist(), x["node"].tolist()) if count[b] > 1)
    assert [b for p in range(7) for b in sorted(b for b, _ in got if b % 7 == p)] == [b for b, _ in got]


def test_lines_empty_table(spark, tmp_path):
    assert line_dedup.deduplicated(empty(spark, tmp_path)).collect() == []


# ---------------------------------------------------------------- near copies


def multiset(text):
    w = (text or "").encode().lower().split()
    return Counter(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_signature_estimates_weighted_jaccard():
    r = np.random.default_rng(4)
    weights = {k: (int(r.integers(1, 40)), int(r.integers(1, 40))) for k in range(30)}
    weights |= {100: (5, 0), 101: (0, 17), 102: (300, 200)}
    exact = sum(min(x) for x in weights.values()) / sum(max(x) for x in weights.values())
    equal = []
    for trial in range(40):
        ids = near_dedup.mix((np.array(list(weights)) + 1000 * trial).astype(np.uint64))
        lists = [[(i, w[side]) for i, w in zip(ids, weights.values()) if w[side]] for side in (0, 1)]
        shingle = np.concatenate([[i for i, _ in x] for x in lists]).astype(np.uint64)
        weight = np.concatenate([[w for _, w in x] for x in lists])
        row = np.repeat([0, 1], [len(x) for x in lists])
        sig = near_dedup.signatures(shingle, weight, row, 3)
        equal.append(np.mean(sig[0] == sig[1]))
        assert not sig[2].any() and sig[:2].all()
    assert abs(np.mean(equal) - exact) < 0.03


def test_near_groups_match_brute_force(spark, tmp_path):
    base = [words(i, 60 + 10 * i) for i in range(12)]
    texts = list(base)
    for i, t in enumerate(base):
        texts += [changed(t, 50 + i, 1), changed(t, 80 + i, 2), t.upper()]
    # copies that resemble their original more than each other, in one large group
    original = words(77, 150)
    texts += [original] + [changed(original, 1000 + k, 1 + k % 4) for k in range(90)]
    texts += ["a b", "a  b", "A b", "", " \n", "a b c", "one two three four five six " * 300, words(5, 4000)]
    docs = stored(spark, tmp_path, texts, extra=[(3, base[3]), (3, base[3]), (None, base[4]), (500, None), (None, None)])
    got = near_dedup.near_groups(docs).collect()
    assert len(got) == docs.count()
    plain = sorted({(r.doc_id is not None, r.doc_id, r.text) for r in docs.collect()}, key=str)
    sets = [multiset(t) for *_, t in plain]
    links = [(i, j) for i in range(len(plain)) for j in range(i) if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8]
    root = roots(range(len(plain)), links)
    members = defaultdict(list)
    for i, k in root.items():
        members[k].append(plain[i])
    want, sizes = {}, Counter()
    for r in docs.collect():
        k = root[plain.index((r.doc_id is not None, r.doc_id, r.text))]
        sizes[k] += 1
    for i, (_, key, text) in enumerate(plain):
        ids = [x for _, x, _ in members[root[i]]]
        want[key, len(list(sets[i].elements())), None if None in ids else min(ids), sizes[root[i]] if sets[i] else 1] = True
    assert {(r.doc_id, r.n_shingles, r.class_id, r.class_size) for r in got} == set(want)

    one = near_dedup.representatives(docs)
    assert one.columns == docs.columns
    wordy = {root[i] for i in range(len(plain)) if sets[i]}
    kept = Counter(root[plain.index((r.doc_id is not None, r.doc_id, r.text))] for r in one.collect() if multiset(r.text))
    assert kept == Counter(wordy)


def test_wide_sketch_of_short_texts():
    """At a similarity of 0.8 the wide sketch differs as documented, however few the elements."""
    r = np.random.default_rng(6)
    for common, one, other in ((4, 1, 0), (8, 1, 1), (16, 2, 2), (80, 10, 10)):
        apart = []
        for _ in range(200):
            u = near_dedup.mix(r.integers(0, 1 << 62, common + one + other).astype(np.uint64))
            a, b = near_dedup.wide_bits(u[:common + one]), near_dedup.wide_bits(np.delete(u, range(common, common + one)))
            apart.append(np.count_nonzero(a != b))
        assert abs(np.mean(apart) - 204.8) < 5 and np.std(apart) < 17 and max(apart) <= near_dedup.WIDE_LIMIT


def test_sketch_loses_next_to_no_near_copy():
    """Bits of the sketch of a pair of similarity 0.8 differ with probability 0.1 each."""
    lost = sum(math.comb(64, k) * 0.1**k * 0.9 ** (64 - k) for k in range(near_dedup.SKETCH_BITS + 1, 65))
    assert lost < 1e-7


def test_short_near_copies_in_a_large_bucket(spark, tmp_path):
    """Pairs of 9 shingles that share 8, in one bucket of over 64 members without a common centre."""
    texts = []
    for i in range(40):
        line = words(4000 + i, 13)
        texts += [line, line.rsplit(" ", 1)[0] + f" zz{i}"]
    docs = numbered(stored(spark, tmp_path, texts).select("doc_id", "text"))
    sets = near_dedup._Multisets(docs)
    members = docs.selectExpr("1L AS bucket", "row AS node", "0L AS sketch")
    placed = groups.connected(members, 0, near_dedup._verifier(sets, 0.8), sets.bound, 0.8, near_dedup.WIDE_LIMIT)
    at = {r.row: r.doc_id for r in docs.collect()}
    found = defaultdict(set)
    for x in placed.collect():
        found[x.root].add(at[x.node])
    assert sorted(map(sorted, found.values())) == [[2 * i, 2 * i + 1] for i in range(40)]


def test_near_groups_empty_table(spark, tmp_path):
    assert near_dedup.near_groups(empty(spark, tmp_path)).collect() == []


# ---------------------------------------------------------------- benchmark passages


def brute_contaminated(text, item):
    def split(t):
        return "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in (t or "").lower()).split()

    x, y = split(text), split(item)
    best = 0
    if not y:
        return False
    if len(y) < 5:
        return any(split(line) == y for line in (text or "").split("\n"))
    if len(y) < 8:
        return any(x[i:i + len(y)] == y for i in range(len(x)))
    for d in range(-len(y), len(x)):
        pairs = [x[d + q] == y[q] for q in range(len(y)) if 0 <= d + q < len(x)]
        seeded = any(all(pairs[s + k] for k, c in enumerate(m) if c == "1") for m in decontamination.MASKS
                     for s in range(len(pairs) - len(m) + 1))
        if seeded:
            best = max([best] + [j - i for i in range(len(pairs)) for j in range(i + 1, len(pairs) + 1)
                                 if 5 * sum(pairs[i:j]) >= 4 * (j - i)])
    return best >= min(decontamination.MIN_WORDS, len(y))


def test_contamination_matches_brute_force(spark, tmp_path):
    items = [words(900 + i, n) for i, n in enumerate((30, 20, 14, 9, 5, 45))] + ["", None, words(900, 30), "éa üb çd " * 6]
    items += ["yes", "Two words.", "just four short words", "two words"]
    texts = []
    for i, item in enumerate(items[:6]):
        n = len(item.split())
        for k in range(6):
            passage = changed(item, k, min(n, k * n // 15)).replace(" ", ",  ") if k else item.upper()
            texts.append(words(i * 10 + k, 20 * k) + " " + passage + ".\n" + words(300 + i * 10 + k, 15))
    texts += [" ".join(items[0].split()[:12]), " ".join(items[0].split()[:13]), "ÉA ÜB ÇD " * 6, "", words(7, 2500) + " " + items[1]]
    texts += ["Yes!", "no\n - YES - \nno", "yes and no", "two words", "two words more", "x\n\njust  four, short words\n", "just four short", "words two words"]
    docs = stored(spark, tmp_path, texts, extra=[(4, texts[4]), (4, texts[4]), (None, items[1]), (700, None)])
    table = spark.createDataFrame(list(enumerate(items)) + [(0, items[0])], "item_id long, text string")
    got = decontamination.contaminated(numbered(docs.select("doc_id", "text")), table).collect()
    rows = numbered(docs.select("doc_id", "text")).collect()
    want = Counter((r.row, i) for r in rows for i, t in [*enumerate(items), (0, items[0])] if brute_contaminated(r.text, t))
    assert len(want) > 25 and Counter((r.row, r.item_id) for r in got) == want
    clean = decontamination.decontaminated(docs, table)
    bad = {r for r, _ in want}
    assert clean.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((r.doc_id, r.text) for r in rows if r.row not in bad)


def test_contamination_empty_tables(spark, tmp_path):
    none = empty(spark, tmp_path)
    items = spark.createDataFrame([(1, words(1, 20))], "item_id long, text string")
    assert decontamination.decontaminated(none, items).collect() == []
    docs = stored(spark, tmp_path, [words(1, 20)])
    assert decontamination.decontaminated(docs, items.limit(0)).count() == 1


# ---------------------------------------------------------------- repeated strings


def brute_removed(rows, length):
    seen, out = set(), Counter()
    for r in rows:
        x = (r.text or "").encode()
        mark = bytearray(len(x))
        for i in range(len(x) - length + 1):
            s = x[i:i + length]
            if s in seen:
                mark[i:i + length] = b"\1" * length
            seen.add(s)
        left = bytes(b for b, m in zip(x, mark) if not m)
        out[r.doc_id, len(x), sum(mark), len([1 for q in bytes(mark).split(b"\0") if q]), hashlib.sha256(left).hexdigest()] += 1
    return out


def test_repeated_strings_match_brute_force(spark, tmp_path):
    passage = words(1, 80)
    texts = [words(i, 30) + passage[i:200 + 3 * i] + words(500 + i, 30) for i in range(40)]
    texts += [passage[:100], passage[:99], passage[1:101], "be " * 200, "a" * 350, "be " * 120 + "é" * 90, "", "é" * 49, "é" * 50,
              texts[3], texts[3][:-1], texts[3][1:], changed(texts[5], 1, 2), words(3, 2000), words(3, 2000)[40:9000]]
    docs = stored(spark, tmp_path, texts, extra=[(7, texts[7]), (7, words(70, 60)), (None, texts[8]), (None, None), (300, texts[0])])
    rows = numbered(docs.select("doc_id", "text"))
    got = suffix_dedup.without_spans(rows, suffix_dedup.repeated_spans(rows)).collect()
    order = sorted(rows.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.row))
    want = brute_removed(order, suffix_dedup.LENGTH)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_repeated_strings_empty_table(spark, tmp_path):
    rows = numbered(empty(spark, tmp_path).select("doc_id", "text"))
    assert suffix_dedup.without_spans(rows, suffix_dedup.repeated_spans(rows)).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=60), min_size=1, max_size=4))
def test_segments_hold_every_string_once(texts):
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    seg = suffix_dedup.Segments(data, offs, 20, 6)
    at = [s for a, b in zip(seg.first, seg.last) for s in range(a, b + 1)]
    assert at == [offs[i] + k for i, x in enumerate(raw) for k in range(len(x) - 19)]
    anchor = {}
    for a, b, p in zip(seg.first, seg.last, seg.at):
        assert b <= p <= a + 20 - 6
        for s in range(a, b + 1):  # equal strings have equal anchors at one offset
            assert anchor.setdefault(bytes(data[s:s + 20]), p - s) == p - s
    if len(seg.first):
        assert (seg.body() == PrefixHash(data).of(seg.first, seg.last + 20)).all()
