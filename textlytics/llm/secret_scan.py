"""Secret scans (operator 2): base patterns and character Markov models, in DataFrame functions only.

Base spans are leftmost non-overlapping matches of each kind (``assign``, ``access``, ``hex``);
matches that are too short are dropped.  Places are code points, end exclusive.

The method adds spans of kind ``random``.  Two first-order Markov models of characters are
trained from labelled samples: random strings, and ordinary identifiers.  A run of
``RUN_CHARS`` characters of keys is scored by its mean log-likelihood ratio for each transition
and is a span if that exceeds ``THRESHOLD`` and it meets no base span.

The samples come from the ``SAMPLE_ROWS`` texts with the smallest seeded hashes:

* random: the values that base patterns found in them, and for each text strings of
  hexadecimal, base64 and upper-case base32-like characters drawn by a hash function,
* ordinary: whole runs of letters, ``_`` and ``-`` of 8 or more in the texts without base spans.

The counts are one row for each pair of characters at most; their ratio goes to all tasks.

One row for each row of the table.  Defined cases: a null or empty text has no span;
repeated rows each get the same row; a null id is kept; an empty table gives no rows (the
model then has the random strings of no text: every ratio is 0 and nothing is added);
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlytics.llm.common import documents

# The kinds, their patterns, the group that counts and its least length.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # runs of 24 or more only: a shorter run is a match that is dropped
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
PATTERNS = {kind: pattern for kind, pattern, _, _ in KINDS}
RANDOM = "random"

RUN_CHARS = r"[A-Za-z0-9+/_=-]{20,}"
SAMPLE_ROWS = 3000
THRESHOLD = 0.3
SMOOTHING = 0.5
#: transitions that a character's share of all transitions counts as
PRIOR = 10.0
SEED = 40
_ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z_-]{7,}(?![A-Za-z0-9+/_=-])"
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: str, pattern: str, group: int, least: int, kind: int, keep: str = "true") -> str:
    """SQL for the spans of one kind: the pieces between the matches give their places.

    ``keep`` is a condition on the matched string, x.`1`."""
    quoted = "r'" + pattern.replace("'", "\\x27") + "'"
    moved = "a.at + length(x.`0`)"
    span = f"named_struct('start', {moved}, 'kind', {kind}, 'end', {moved} + length(x.`1`))"
    return f"""if({text} rlike {quoted},
        aggregate(
            arrays_zip(split({text}, {quoted}, -1), regexp_extract_all({text}, {quoted}, 0),
                       regexp_extract_all({text}, {quoted}, {group})),
            named_struct('at', 0, 'out', cast(array() AS {_SPAN})),
            (a, x) -> named_struct(
                'at', {moved} + length(coalesce(x.`1`, '')),
                'out', if(length(x.`2`) >= {least} AND {keep}, concat(a.out, array({span})), a.out)),
            a -> a.out),
        cast(array() AS {_SPAN}))"""


def base_spans(text: str = "text") -> Column:
    """All base spans of a text column that is never null, by start and kind."""
    every = [_spans(text, PATTERNS[kind], group, least, k) for k, (kind, _, group, least) in enumerate(KINDS)]
    return F.expr(f"array_sort(concat({', '.join(every)}))")


def samples(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """(label, value): labelled strings of a bounded number of texts; label 1 is random."""
    marked = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text", F.lit(seed)))
    last = marked.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    few = marked.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.first("text").alias("text"))
    found, clean = [], F.col("text")
    for kind, _, group, least in KINDS:
        values = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(group))
        found.append(F.filter(values, lambda v, n=least: F.length(v) >= n))
        clean = F.regexp_replace(clean, PATTERNS[kind], " ")
    digest = [F.sha2(F.concat(F.col("h").cast("string"), F.lit(f":{seed}:{i}")), 256) for i in range(3)]
    drawn = F.array(F.substring(digest[0], 1, 40), F.base64(F.unhex(digest[1])),
                    F.translate(F.upper(F.substring(F.base64(F.unhex(digest[2])), 1, 32)), "+/=", "234"))
    ordinary = F.regexp_extract_all(clean, F.lit(_ORDINARY), F.lit(0))
    each = F.concat(F.transform(F.concat(*found, drawn), lambda v: F.struct(F.lit(1).alias("label"), v.alias("value"))),
                    F.transform(ordinary, lambda v: F.struct(F.lit(0).alias("label"), v.alias("value"))))
    return few.select(F.explode(each).alias("s")).select("s.*")


def train(labelled: DataFrame, smoothing: float = SMOOTHING) -> list[float]:
    """Log-likelihood ratio of each transition, random to ordinary, at 128 * first + second.

    At most one count for each label and pair of ASCII characters comes to the driver."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1),
                                 lambda i: F.substring(F.col("value"), i, F.lit(2)))).alias("pair")
    rows = labelled.where(F.length("value") > 1).select("label", pair).groupBy("label", "pair").count().collect()
    count = [Counter(), Counter()]
    for r in rows:
        count[r["label"]][r["pair"]] += r["count"]
    chars = sorted({c for n in count for p in n for c in p})
    ratio = [0.0] * (128 * 128)
    if not count[0] or not count[1]:
        return ratio
    total, second = [Counter(), Counter()], [Counter(), Counter()]
    for label, n in enumerate(count):
        for p, k in n.items():
            total[label][p[0]] += k
            second[label][p[1]] += k
    # how often a character follows any other stands in for transitions that are rare
    share = [{c: (second[k][c] + smoothing) / (sum(second[k].values()) + smoothing * len(chars)) for c in chars} for k in (0, 1)]
    for a in chars:
        for b in chars:
            log = [math.log((count[k][a + b] + PRIOR * share[k][b]) / (total[k][a] + PRIOR)) for k in (0, 1)]
            if ord(a) < 128 and ord(b) < 128:
                ratio[128 * ord(a) + ord(b)] = round(log[1] - log[0], 4)
    return ratio


def score_sql(value: str, table: str = "ratio") -> str:
    """SQL for the mean log-likelihood ratio of a string's transitions."""
    return f"""aggregate(split({value}, ''), named_struct('c', -1, 's', 0D),
        (b, c) -> named_struct('c', ascii(c), 's', b.s + if(b.c < 0, 0D, coalesce(get({table}, 128 * b.c + ascii(c)), 0D))),
        b -> b.s / greatest(length({value}) - 1, 1))"""


def scan(docs: DataFrame, ratio: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the numbers of spans by kind, base_sha256 and spans; see the module."""
    table = f"cast(split('{','.join(map(str, ratio))}', ',') AS array<double>)"
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("base", base_spans())
    keep = f"{score_sql('x.`1`', table)} > {threshold}D"
    rows = rows.withColumn("runs", F.expr(_spans("text", RUN_CHARS, 0, 1, len(KINDS), keep)))
    more = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    names = F.array(*[F.lit(kind) for kind, *_ in KINDS], F.lit(RANDOM))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda spans, k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return rows.withColumn("more", more).select(
        "doc_id", *[n("base", k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(KINDS)],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "more"))).alias("spans"), F.size("more").cast("long").alias("n_random"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return scan(docs, train(samples(docs)))
