"""Benchmark decontamination (operator 9): spaced-seed hashing.

Words are runs of ASCII letters, digits and characters beyond ASCII, in lower case.

* A seed is a window of words of which a fixed mask looks at some positions only, so a
  substituted word at an ignored position does no harm.  All windows of the benchmark
  items and of the documents are hashed under each of ``MASKS``.
* A bitmap of fixed size thins out the documents' windows; those that pass are joined
  with the items' on the hash.  A hit is (document, item, diagonal): the word number in
  the document less that in the item.
* Around the hits the words are aligned along the diagonal.  The longest stretch in which
  ``SIMILARITY`` of the words or more are equal must have ``MIN_WORDS`` words or
  more (of a shorter item, all its words).

Short items are held to more, since running text has some of their words by chance.  Of an item of
under ``FUZZY`` words all words must be equal, in a row.  An item of under ``LINE`` words has no window; it
counts where a whole line of a document has just its words: such lines are hashed as a whole, and those
hashes go the same way as the windows'.

One row for each contaminated pair: doc_id, item_id, n_words (of the stretch), n_equal,
first_word and end_word (in the document, from 0, end exclusive; cut to equal words).

Defined cases: null and empty texts have no words, and items without words contaminate
nothing; repeated rows of either
table give a row each; a null id is kept; an empty table gives no rows; columns other than
the ids and texts are not read (by ``decontaminated``: kept).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlytics.llm.common import (U64, PrefixHash, bitmap, documents, mix, numbered, passes, runs, seeded,
                                   text_chunks, written)

MASKS = ("11111", "111101", "110111", "1110011", "1101101")
MIN_WORDS = 13
#: words from which an item may differ in some, and from which it is found inside of a line
FUZZY = 8
LINE = min(map(len, MASKS))
SIMILARITY = 0.8
BITMAP_BITS = 24

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start) of the words of a chunk in lower case."""
    start, end, row = runs(_WORD[data], offs)
    return PrefixHash(data).of(start, end), row, start


def whole_hashes(h: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The hash of all words of each short line or item: ``count`` words, under ``LINE``, from ``first`` on."""
    mult = seeded(LINE, 90) | U64(1)
    s = count.astype(U64) * U64(0x9E3779B97F4A7C15)
    for j in range(LINE - 1):
        has = count > j
        s[has] += h[first[has] + j] * mult[j]
    return mix(s)


def line_seeds(data: np.ndarray, offs: np.ndarray, h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of the lines of one to ``LINE`` - 1 words."""
    begin = np.union1d(offs[:-1], np.flatnonzero(data == 10) + 1)
    line = np.searchsorted(begin, start, "right") - 1
    first = np.flatnonzero(np.diff(line, prepend=-1))
    count = np.diff(np.append(first, len(line)))
    short = count < LINE
    return whole_hashes(h, first[short], count[short]), first[short]


def seeds(h: np.ndarray, row: np.ndarray, masks: tuple[str, ...] = MASKS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask (hash, index of the first word) of the windows within one row."""
    for k, mask in enumerate(masks):
        n = len(h) - len(mask) + 1
        if n <= 0:
            continue
        mult = seeded(len(mask), 100 + k) | U64(1)
        s = np.zeros(n, U64)
        for j, c in enumerate(mask):
            if c == "1":
                s += h[j:j + n] * mult[j]
        at = np.flatnonzero(row[:n] == row[len(mask) - 1:])
        yield mix(s[at]), at


def longest_stretch(equal: np.ndarray, similarity: float) -> tuple[int, int]:
    """The longest [start, end) of which at least this share is true; the first of several."""
    part = round(similarity * 100)
    p = np.concatenate([[0], np.cumsum(np.where(equal, 100 - part, -part))])
    low = np.minimum.accumulate(p)         # of the starts up to here
    high = np.maximum.accumulate(p[::-1])[::-1]   # of the ends from here on
    best, i = (0, 0), 0
    for j in range(len(p)):
        while i < j and low[i] > high[j]:
            i += 1
        if low[i] <= high[j] and j - i > best[1] - best[0]:
            best = (i, j)
    return best


def _item_words(items: DataFrame) -> DataFrame:
    """(item, item_id, words binary) of the items with words."""
    rows = numbered(items.select("item_id", "text")).withColumnRenamed("row", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in text_chunks(batches, lower=True):
            h, row, _ = words(data, offs)
            cut = np.searchsorted(row, np.arange(len(offs)))
            got = [h[a:b].tobytes() if b > a else None for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array(got, pa.binary())],
                                             names=["item", "item_id", "words"])

    schema = T.StructType().add("item", "long").add("item_id", rows.schema["item_id"].dataType).add("words", "binary")
    return rows.mapInArrow(run, schema).where("words is not null")


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY,
                 min_words: int = MIN_WORDS) -> DataFrame:
    """The contaminated pairs with ``row``; docs has a column row (see ``numbered``)."""
    item_words = written(_item_words(items), "items")
    short_items = not item_words.where(F.octet_length("words") < 8 * LINE).isEmpty()

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist()):
                h = np.frombuffer(raw, U64)
                whole = [(whole_hashes(h, np.array([0]), np.array([len(h)])), np.array([0]))] if len(h) < LINE else []
                for s, at in [*seeds(h, np.zeros(len(h), np.int64)), *whole]:
                    yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int64)), pa.array(np.full(len(s), item)),
                                                      pa.array(at.astype(np.int32))], names=["seed", "item", "at"])

    wanted = written(item_words.select("item", "words").mapInArrow(item_seeds, "seed long, item long, at int"), "seeds")
    known = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "seed", BITMAP_BITS))  # of fixed size

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for batch, data, offs in text_chunks(batches, lower=True):
            ids = batch.column("row").to_numpy()
            h, row, start = words(data, offs)
            first = np.searchsorted(row, np.arange(len(offs) - 1))
            for s, at in [*seeds(h, row), *([line_seeds(data, offs, h, start)] if short_items else [])]:
                hit = passes(bits, s)
                s, at = s[hit], at[hit]
                r = row[at]
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int64)), pa.array(ids[r]),
                                                  pa.array((at - first[r]).astype(np.int32))], names=["seed", "row", "pos"])

    found = written(docs.select("row", "text").mapInArrow(doc_seeds, "seed long, row long, pos int"), "windows")
    hits = written(found.join(wanted, "seed").select("row", "item", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()
                   .groupBy("row", "item").agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals")), "hits")
    asked = docs.sparkSession.sparkContext.broadcast(bitmap(hits.select(F.xxhash64("row").alias("mark")), "mark"))

    def doc_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = asked.value
        for batch in batches:
            few = batch.filter(pa.array(passes(bits, batch.column("mark").to_numpy())))
            for part, data, offs in text_chunks([few], lower=True):
                h, row, _ = words(data, offs)
                cut = np.searchsorted(row, np.arange(len(offs)))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([h[a:b].tobytes() for a, b in zip(cut, cut[1:])],
                                                                               pa.binary())], names=["row", "doc_words"])

    texts = docs.select("row", "text", F.xxhash64("row").alias("mark")).mapInArrow(doc_words, "row long, doc_words binary")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "item", "n_words", "n_equal", "first_word", "end_word"]
        for batch in batches:
            out: list[tuple] = []
            for r, item, diagonals, x, y in zip(*(batch.column(c).to_pylist() for c in
                                                  ("row", "item", "diagonals", "doc_words", "words"))):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                best = (0, 0, 0, 0)
                for d in diagonals:
                    a, b = max(0, -d), min(len(y), len(x) - d)
                    equal = x[a + d:b + d] == y[a:b]
                    if len(y) < FUZZY and not (len(equal) == len(y) and equal.all()):
                        continue
                    i, j = longest_stretch(equal, similarity)
                    at = np.flatnonzero(equal[i:j])
                    if len(at):
                        best = max(best, (j - i, len(at), -(a + d + i + int(at[0])), a + d + i + int(at[-1]) + 1))
                if best[0] >= min(min_words, len(y)):
                    out.append((r, item, best[0], best[1], -best[2], best[3]))
            cols = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    pairs = (hits.join(texts, "row").join(item_words.select("item", "words"), "item")
             .select("row", "item", "diagonals", "doc_words", "words")
             .mapInArrow(verify, "row long, item long, n_words long, n_equal long, first_word long, end_word long"))
    return written(pairs.join(item_words.select("item", "item_id"), "item").drop("item"), "contaminated")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs``, with its columns, without the contaminated documents; docs is read from files."""
    names = docs.columns
    rows = numbered(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
                                F.col("text")))
    bad = written(contaminated(rows, items).select("row").distinct(), "bad")
    return (rows.join(bad, "row", "left_anti")
            .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)]))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of benchmark items."""
    docs = numbered(documents(spark, sf_dir).select("doc_id", "text"))
    pairs = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.select("row", "doc_id").join(pairs, "row").select(
        "doc_id", "item_id", "n_words", "n_equal", "first_word", "end_word")
