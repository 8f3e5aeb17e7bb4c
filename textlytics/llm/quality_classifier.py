"""Quality classifier (operator 5): ordinal cumulative-link regression on graded ratings.

A text's grade is 0 (toxic, whatever its form), 1 (low quality) or 2 (good); ``grades``
makes them from the table of labels.  The model has one weight for each hashed feature,
shared by all grades, and ordered thresholds:

    P(grade <= k | text) = sigmoid(threshold_k - sum of the weights of the text's features)

From it come the expected grade and the tail probability P(grade >= ``SELECT_GRADE``);
a document is kept when the latter is at least ``SELECT_PROBABILITY``.

Features of a text, each present or not: its words (runs of ASCII letters, digits and
bytes beyond ASCII, in lower case), the first 4 and 5 bytes of longer words (stems that
inflected forms share), its runs of other characters, and three shares cut into tenths (words equal to the word before, capitals among ASCII letters, and runs of
other characters for each word).  All are hashed into 2**``HASH_BITS`` slots.

Fitting takes a bounded sample: for each grade the ``FIT_ROWS`` labelled documents with
the smallest hashes of their id.  Executors hash them; the driver gets the slots only
and minimises the penalised negative log-likelihood.  A slot gets a weight only if
``MIN_DOCS`` fitted documents or more have it and its share differs between the grades
below and above some threshold by ``MIN_Z`` standard errors (words that say nothing about
the grade would only fit noise).  Equal feature lists of a grade are fitted once.  Scoring is one pass over all
documents; the weights that are not zero are sent to every task.

Defined cases: a null or empty text has only its share features; a label with a null
column or an id without document is not fitted; with labels of fewer than two grades
no model can be fitted: every document gets the highest grade with certainty and is kept;
repeated rows each get the same row; an empty table gives no rows; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlytics.llm.common import (LOWER, SPACE, U64, PrefixHash, documents, mix, runs, text_chunks)

HASH_BITS = 22
STEMS = (4, 5)
#: fitted documents of each grade at most
FIT_ROWS = 4000
MIN_DOCS = 8
MIN_Z = 6.0
GRADES = 3
SELECT_GRADE = 2
SELECT_PROBABILITY = 0.2
#: strength of the penalty on squared weights, and steps of the optimiser
RIDGE = 1e-4
STEPS = 300

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_ALNUM[128:] = True
_OTHER = ~_ALNUM & ~SPACE
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature slots of each text of a chunk: (slots, offsets by row)."""
    rows = len(offs) - 1
    low = LOWER[data]
    h = PrefixHash(low)
    start, end, row = runs(_ALNUM[data], offs)
    words = h.of(start, end)
    ostart, oend, orow = runs(_OTHER[data], offs)
    others = h.of(ostart, oend) ^ U64(0x5851F42D4C957F2D)
    stems = [(h.of(start[longer], start[longer] + k) ^ U64(0x14057B7EF767814F), row[longer])
             for k in STEMS for longer in [np.flatnonzero(end - start > k)]]

    n_words = np.bincount(row, minlength=rows)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    by_row = lambda at: np.bincount(np.searchsorted(offs, at, "right") - 1, minlength=rows)
    capitals = by_row(np.flatnonzero(_CAPITAL[data]))
    letters = by_row(np.flatnonzero((low >= 97) & (low <= 122)))
    tenth = lambda a, b: np.minimum(10 * a // np.maximum(b, 1), 20)
    shares = [tenth(np.bincount(row[same], minlength=rows), n_words), tenth(capitals, letters),
              tenth(np.bincount(orow, minlength=rows), n_words)]
    each = np.arange(rows)
    extra = [mix((s + 100 * (k + 1)).astype(U64) * U64(0x9E3779B97F4A7C15)) for k, s in enumerate(shares)]

    slot = np.concatenate([words, others, *(x for x, _ in stems), *extra]) >> U64(64 - HASH_BITS)
    key = np.concatenate([row, orow, *(x for _, x in stems), *([each] * len(extra))]).astype(U64) << U64(HASH_BITS) | slot
    key = np.sort(key)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    cut = np.searchsorted(key, np.arange(rows + 1).astype(U64) << U64(HASH_BITS))
    return (key & U64((1 << HASH_BITS) - 1)).astype(np.int32), cut


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labelled documents: one row for an id, the lowest grade if several."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return (labels.where("doc_id is not null and quality is not null and toxic is not null")
            .groupBy("doc_id").agg(F.min(grade).alias("grade")))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    """Slots with a weight, their weights, and ascending thresholds (one fewer than grades)."""

    slots: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def table(self) -> np.ndarray:
        """The weight of every slot."""
        out = np.zeros(1 << HASH_BITS, np.float32)
        out[self.slots] = self.weights
        return out

    def score(self, table: np.ndarray, slots: np.ndarray, cut: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(table[slots], dtype=np.float64)])
        return sums[cut[1:]] - sums[cut[:-1]]

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. (columns)."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def telling(grade: np.ndarray, slots: np.ndarray, cut: np.ndarray, n_grades: int,
            min_docs: int, min_z: float) -> np.ndarray:
    """Which (consecutively numbered) slots differ between lower and higher grades."""
    size, of = int(slots.max(initial=-1)) + 1, np.repeat(grade, np.diff(cut))
    has = np.stack([np.bincount(slots[of == k], minlength=size) for k in range(n_grades)]).astype(float)
    n = np.bincount(grade, minlength=n_grades).astype(float)
    z = np.zeros(size)
    for k in range(1, n_grades):
        a, b, na, nb = has[:k].sum(0), has[k:].sum(0), n[:k].sum(), n[k:].sum()
        if na and nb:
            p = (a + b + 1) / (na + nb + 2)
            z = np.maximum(z, np.abs(a / na - b / nb) / np.sqrt(p * (1 - p) * (1 / na + 1 / nb)))
    return (has.sum(0) >= min_docs) & (z >= min_z)


def fit(grade: np.ndarray, slots: np.ndarray, cut: np.ndarray, n_grades: int = GRADES,
        steps: int = STEPS, ridge: float = RIDGE, min_docs: int = MIN_DOCS, min_z: float = MIN_Z
        ) -> OrdinalModel:
    """Penalised maximum likelihood by full-batch Adam; each grade weighs the same in all.

    Thresholds are a first value and positive gaps, so they stay in order."""
    n = len(grade)
    row = np.repeat(np.arange(n), np.diff(cut))
    seen, col = np.unique(slots, return_inverse=True)
    kept = telling(grade, col, cut, n_grades, min_docs, min_z)
    used, keep = seen[kept], kept[col]
    row, col = row[keep], (np.cumsum(kept) - 1)[col[keep]]
    count = np.bincount(grade, minlength=n_grades)
    rate = 1.0 / (np.maximum(count, 1)[grade] * max(1, np.count_nonzero(count)))
    x = np.zeros(len(used) + n_grades - 1)  # weights, first threshold, logs of the gaps
    m, v = np.zeros_like(x), np.zeros_like(x)
    k = len(used)
    for step in range(1, steps + 1):
        gaps = np.exp(np.clip(x[k + 1:], -5, 5))
        theta = np.concatenate([[x[k]], x[k] + np.cumsum(gaps)])
        s = np.bincount(row, x[:k][col], minlength=n)
        upper = np.where(grade < n_grades - 1, _sigmoid(theta[np.minimum(grade, n_grades - 2)] - s), 1.0)
        lower = np.where(grade > 0, _sigmoid(theta[np.maximum(grade - 1, 0)] - s), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p * rate, lower * (1 - lower) / p * rate
        gs = du - dl                               # of the negative log-likelihood, by score
        gt = np.zeros(n_grades - 1)                # ... by threshold
        np.add.at(gt, np.minimum(grade, n_grades - 2), -du * (grade < n_grades - 1))
        np.add.at(gt, np.maximum(grade - 1, 0), dl * (grade > 0))
        g = np.zeros_like(x)
        g[:k] = np.bincount(col, gs[row], minlength=k) + ridge * x[:k]
        g[k] = gt.sum()
        g[k + 1:] = np.cumsum(gt[::-1])[::-1][1:] * gaps
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        x -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
    gaps = np.exp(np.clip(x[k + 1:], -5, 5))
    return OrdinalModel(used, x[:k].astype(np.float32), np.concatenate([[x[k]], x[k] + np.cumsum(gaps)]))


def train(docs: DataFrame, graded: DataFrame, fit_rows: int = FIT_ROWS, n_grades: int = GRADES) -> OrdinalModel | None:
    """Fit on at most ``fit_rows`` documents of each grade; None if fewer than two grades occur."""
    picks = [graded.where(F.col("grade") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
             for k in range(n_grades)]
    chosen = picks[0]
    for p in picks[1:]:
        chosen = chosen.unionByName(p)
    rows = (docs.where("doc_id is not null").select("doc_id", "text")
            .join(F.broadcast(chosen), "doc_id")  # n_grades * fit_rows ids and grades at most
            .groupBy("doc_id", "grade").agg(F.min("text").alias("text"))  # one row for an id
            .select("grade", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in text_chunks(batches):
            slots, cut = features(data, offs)
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(slots))
            yield pa.RecordBatch.from_arrays([batch.column("grade"), lists], names=["grade", "slots"])

    got = rows.mapInArrow(run, "grade int, slots array<int>").toArrow().combine_chunks()
    grade = got.column("grade").to_numpy().astype(np.int64)
    if len(np.unique(grade)) < 2:
        return None
    slots = np.concatenate([c.values.to_numpy()[c.offsets[0].as_py():c.offsets[-1].as_py()]
                            for c in got.column("slots").chunks])
    cut = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(c.offsets.to_numpy())
                                                         for c in got.column("slots").chunks]))])
    lists = sorted({(int(g), slots[a:b].tobytes()) for g, a, b in zip(grade, cut, cut[1:])})  # not the tasks' order
    grade, slots = np.array([g for g, _ in lists]), [np.frombuffer(x, np.int32) for _, x in lists]
    return fit(grade, np.concatenate(slots), np.concatenate([[0], np.cumsum([len(x) for x in slots])]), n_grades)


def grade_documents(docs: DataFrame, model: OrdinalModel | None, n_grades: int = GRADES,
                    select_grade: int = SELECT_GRADE, probability: float = SELECT_PROBABILITY,
                    with_text: bool = True) -> DataFrame:
    """(all columns of ``docs``, expected_grade, tail_probability, kept); a column of
    ``docs`` with the name of an added one is replaced.  Without ``with_text`` the text
    is read but not returned."""
    rows = docs.drop("expected_grade", "tail_probability", "kept")
    carried = [f for f in rows.schema if with_text or f.name != "text"]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in carried]
                          + [T.StructField("expected_grade", T.DoubleType()),
                             T.StructField("tail_probability", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    names = schema.names
    if model is None:
        return (rows.select(*[f.name for f in carried]).withColumn("expected_grade", F.lit(float(n_grades - 1)))
                .withColumn("tail_probability", F.lit(1.0)).withColumn("kept", F.lit(True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch, data, offs in text_chunks(batches):
            tails = model.tails(model.score(table, *features(data, offs)))
            tail = tails[:, select_grade - 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in carried), pa.array(np.round(tails.sum(1), 6)), pa.array(np.round(tail, 6)),
                 pa.array(tail >= probability)], names=names)

    return rows.mapInArrow(run, schema)


def kept_documents(docs: DataFrame, graded: DataFrame) -> DataFrame:
    """``docs``, with its columns, without the documents that a model fitted on it rejects."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("text"))
    model = train(docs.select("doc_id", "text"), graded)
    return (grade_documents(inner, model, with_text=False).where("kept")
            .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)]))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and verdict of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return grade_documents(docs, model, with_text=False)
