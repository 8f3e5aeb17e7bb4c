"""Quality rules (operator 4): a short-circuit cascade of heuristic filters.

A rule is a predicate on a text that rejects it.  On a bounded sample of the documents
(``SAMPLE_ROWS`` rows with the smallest hashes of their id) each rule's cost (seconds
a text) and selectivity (share of rejected texts) are measured; the rules then run in
the order of rejection per cost, and a text that one rule rejects meets no later one.
The order changes the time that the cascade takes and the rule that is named, never
the verdict: a text is kept if no rule rejects it.

The five base measures of a text are part of the result, so they are computed for
every text and rules on them cost little; rules with measures of their own run inside
the cascade only.

Words are ``[^\\x20\\x09-\\x0D]+``.  Defined cases: a null or empty text has no words and
fails the base rules; repeated rows each get the same row; a null id is kept; an empty
table gives no rows (its sample is empty; the rules keep their listed order); columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlytics.llm.common import documents

#: rows on which the rules' cost and selectivity are measured
SAMPLE_ROWS = 500
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
_NO_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128))


class Measures:
    """The words of a text and its base measures."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode("utf-8", "surrogatepass")
        self.words = self.raw.split()
        self.n_words = len(self.words)
        self.word_chars = sum(map(len, self.words))
        if len(self.raw) != len(self.text):
            self.word_chars -= len(self.raw) - len(self.text)
        self.n_symbols = len(self.raw.translate(None, _NO_SYMBOL))
        self.lines = [x for x in self.raw.split(b"\n") if x and not x.isspace()]
        self.n_dup_lines = len(self.lines) - len(set(self.lines))
        self.n_repeat_words = self._repeats()
        self.base_failed = (self.n_words < MIN_WORDS
                            or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)

    def _repeats(self) -> int:
        """Words in 5-word windows that the text has twice or more."""
        w = self.words
        windows = list(zip(*(w[i:] for i in range(WINDOW))))
        if len(set(windows)) == len(windows):
            return 0
        count, covered, end = Counter(windows), 0, 0
        for i, x in enumerate(windows):
            if count[x] > 1:
                covered += i + WINDOW - max(end, i)
                end = i + WINDOW
        return covered


# Rules: true rejects.  Bounds lie far from running text of any alphabet.

def too_short_or_repeated(m: Measures) -> bool:
    return m.base_failed


def symbol_words(m: Measures) -> bool:
    """A symbol for every four words or more."""
    return 4 * m.n_symbols >= m.n_words


def duplicate_lines(m: Measures) -> bool:
    """Over half of five lines or more repeat an earlier one."""
    return len(m.lines) >= 5 and 2 * m.n_dup_lines > len(m.lines)


def stuttered_words(m: Measures) -> bool:
    """Over 30 % of the words equal the word before."""
    return 10 * sum(map(bytes.__eq__, m.words, m.words[1:])) > 3 * m.n_words


def word_length(m: Measures) -> bool:
    """Words of under 2 or over 40 characters on average."""
    return not 2 * m.n_words <= m.word_chars <= 40 * m.n_words


def upper_case(m: Measures) -> bool:
    """Half of all ASCII letters are capitals."""
    upper = len(m.raw.translate(None, _UPPER))
    return 4 * upper > 2 * len(m.raw.translate(None, _LETTERS)) > 0


def few_letters(m: Measures) -> bool:
    """Under two fifths of the words' bytes are letters or beyond ASCII."""
    return 5 * len(m.raw.translate(None, _LETTERS)) < 2 * sum(map(len, m.words))


def same_word(m: Measures) -> bool:
    """One word is over a third of a text of 20 words or more."""
    return m.n_words >= 20 and 3 * Counter(m.words).most_common(1)[0][1] > m.n_words


_ENDS = re.compile(rb"(?:\.\.\.|\xe2\x80\xa6)\s*$")
_BULLET = re.compile(rb"\s*(?:[-*]|\xe2\x80\xa2)\s")


def bullet_lines(m: Measures) -> bool:
    return 10 * sum(bool(_BULLET.match(x)) for x in m.lines) > 9 * len(m.lines)


def ellipsis_lines(m: Measures) -> bool:
    return 10 * sum(bool(_ENDS.search(x)) for x in m.lines) > 3 * len(m.lines)


RULES: tuple[Callable[[Measures], bool], ...] = (
    too_short_or_repeated, symbol_words, duplicate_lines, word_length, upper_case, few_letters,
    same_word, stuttered_words, bullet_lines, ellipsis_lines)


def plan(texts: list[str], rules: tuple = RULES) -> list[dict]:
    """Cost, selectivity and rank of each rule on sampled texts, in the order to run them."""
    made = [Measures(t) for t in texts]
    found = []
    for rule in rules:
        began = time.perf_counter()
        rejected = sum(rule(m) for m in made)
        cost = (time.perf_counter() - began) / max(1, len(made))
        found.append({"rule": rule.__name__, "cost": cost, "selectivity": rejected / max(1, len(made))})
    found.sort(key=lambda x: -x["selectivity"] / max(x["cost"], 1e-9))  # stable: ties stay as listed
    return found


def sample_plan(docs: DataFrame, rules: tuple = RULES, sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """``plan`` on a bounded sample, measured in one task."""
    schema = "rule string, cost double, selectivity double, place int"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for b in batches for t in b.column("text").to_pylist()]
        rows = [x | {"place": i} for i, x in enumerate(plan(texts, rules))]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("rule", pa.string()), ("cost", pa.float64()),
                                                          ("selectivity", pa.float64()), ("place", pa.int32())]))

    few = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).distinct()
    sample = (docs.select("doc_id", "text").join(F.broadcast(few), "doc_id", "left_semi")  # sample_rows ids at most
              .orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample_rows).select("text"))
    return [r.asDict() for r in sorted(sample.coalesce(1).mapInArrow(measure, schema).collect(), key=lambda r: r["place"])]


def apply_rules(docs: DataFrame, rules: tuple = RULES, order: list[dict] | None = None) -> DataFrame:
    """Base measures, kept, and the first rule of the cascade that rejected (else null)."""
    order = sample_plan(docs, rules) if order is None else order
    by_name = {r.__name__: r for r in rules}
    cascade = [by_name[x["rule"]] for x in order] or list(rules)
    rows = docs.select("doc_id", "text")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in counts),
                           T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
                           T.StructField("rejected_by", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in [*counts, "base_failed", "kept", "rejected_by"]}
            for text in batch.column("text"):
                m = Measures(text.as_py())
                by = next((r.__name__ for r in cascade if r(m)), None)
                for c in counts:
                    cols[c].append(getattr(m, c))
                cols["base_failed"].append(m.base_failed)
                cols["kept"].append(by is None)
                cols["rejected_by"].append(by)
            arrays = [batch.column("doc_id")]
            arrays += [pa.array(v, pa.int64() if c in counts else pa.string() if c == "rejected_by" else pa.bool_())
                       for c, v in cols.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document."""
    return apply_rules(documents(spark, sf_dir)).drop("rejected_by")
