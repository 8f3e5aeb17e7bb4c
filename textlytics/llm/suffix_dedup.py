"""Suffix-array dedup (operator 7): bytes of 100-byte strings that also start earlier.

A byte is removed if it lies in a ``LENGTH``-byte string of its document that also starts
earlier: in a document with a smaller id, or further left in the same one.  Strings are
judged on the input and never cross documents.

Most strings of a corpus occur once, and neighbouring strings share all but one byte, so
the strings are compared in families, which two hashes stand for (of one polynomial: together 64 bits that tell apart; bytes are not compared):

1. Documents of equal bytes: all but the first lose everything (if ``LENGTH`` bytes long).
2. Segments.  Every string has an anchor: among its ``GRAM``-byte grams the leftmost of those
   with the smallest hash.  Consecutive strings with one anchor are a segment, about 39
   of them.  Equal strings have equal anchors at the same offset, so only segments
   whose anchor occurs twice are looked at.  Of segments with equal bytes all but the
   first are removed.
3. Classes.  If segments of one anchor differ, each is cut by the offset of the anchor into
   classes of ``CLASS`` strings, which share a core of ``LENGTH - CLASS + 1`` bytes.  Of classes with
   equal bytes all but the first are removed.
4. Strings.  If classes of one core differ, their strings are compared one by one.

What is first is decided among the firsts of the step before: every other occurrence
starts later.  Steps 2 to 4 are aggregations and joins on hashes, so a passage that a
third of all documents have is split like any skewed key, and its edges cost rows in
proportion to its occurrences.  The method dealt is external induced sorting; see the
README for why its suffix tuples do not fit and what was measured.

Defined cases: null and empty texts are empty strings; rows with one id are ordered by
their place in the table, so of repeated rows the first keeps its bytes; a null id counts as the
smallest; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlytics.llm.common import (U64, PrefixHash, bitmap, documents, mix, numbered, passes, text_chunks, written)

LENGTH = 100
GRAM = 24
CLASS = 10
BITMAP_BITS = 26
_POSITION = U64((1 << 24) - 1)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every n neighbours."""
    m = len(x)
    blocks = -(-m // n)
    y = np.full(blocks * n, np.iinfo(U64).max, U64)
    y[:m] = x
    y = y.reshape(blocks, n)
    left = np.minimum.accumulate(y, axis=1).reshape(-1)
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:m - n + 1], left[n - 1:m])


class Segments:
    """The segments of a chunk: first and last string (chunk offsets), anchor offset and hash, row."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM):
        self.length = length
        none = np.zeros(0, np.int64)
        self.first = self.last = self.at = self.row = none
        self.anchor = none.astype(U64)
        self.hash = PrefixHash(data)
        if len(data) < length:
            return
        parts = []
        # positions have 24 bits: a longer chunk (one very long text) is looked at in steps
        step = (1 << 24) - length
        for base in range(0, len(data) - length + 1, step):
            p = np.arange(base, min(len(data) - gram + 1, base + step + length - gram))
            h = self.hash.of(p, p + gram)
            least = _least((h & ~_POSITION) | (p - base).astype(U64), length - gram + 1)
            parts.append((least & _POSITION).astype(np.int64) + base)
        at = np.concatenate(parts)
        s = np.arange(len(at))
        row = np.searchsorted(offs, s, "right") - 1
        inside = s + length <= offs[row + 1]
        same = (at[1:] == at[:-1]) & (row[1:] == row[:-1]) & inside[1:] & inside[:-1]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~same
        ends[:-1] &= ~same
        self.first, self.last = np.flatnonzero(starts), np.flatnonzero(ends)
        self.at, self.row = at[self.first], row[self.first]
        self.anchor = self.hash.of(self.at, self.at + gram)

    def body(self) -> np.ndarray:
        """Hashes of all bytes of the segments."""
        return self.hash.of(self.first, self.last + self.length)


def _batch(**columns: object) -> pa.RecordBatch:
    arrays = [v if isinstance(v, pa.Array) else pa.array(v.view(np.int64) if v.dtype == U64 else v) for v in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def _segment_rows(docs: DataFrame, wanted, length: int) -> DataFrame:
    """(anchor, body, doc_id, row, start, n, offset) of the segments whose anchor may be wanted (a bitmap, else all)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in text_chunks(batches):
            seg = Segments(data, offs, length)
            ok = np.ones(len(seg.first), bool) if wanted is None else passes(wanted.value, seg.anchor)
            row = seg.row[ok]
            yield _batch(anchor=seg.anchor[ok], body=seg.body()[ok], doc_id=batch.column("doc_id").take(pa.array(row)),
                         row=batch.column("row").to_numpy()[row], start=seg.first[ok] - offs[row],
                         n=seg.last[ok] - seg.first[ok] + 1, offset=seg.at[ok] - seg.first[ok])

    schema = T.StructType().add("anchor", "long").add("body", "long").add(docs.schema["doc_id"])
    for c in ("row", "start", "n", "offset"):
        schema.add(c, "long")
    return docs.select("doc_id", "row", "text").mapInArrow(run, schema)


def _family(found: DataFrame, key: str, body: str, length: int, *carry: str) -> tuple[DataFrame, DataFrame]:
    """Of rows (key, body, doc_id, row, start, n): the spans of all but the first with equal
    (key, body), and the firsts of those keys that have several bodies."""
    place = F.struct("doc_id", "row", "start", "n", *carry)
    firsts = written(found.groupBy(key, body).agg(F.min(place).alias("p"), F.count("*").alias("copies")), "firsts")
    later = (found.join(firsts.where("copies > 1").select(key, body, F.col("p.row").alias("row0"), F.col("p.start").alias("start0")),
                        [key, body])
             .where((F.col("row") != F.col("row0")) | (F.col("start") != F.col("start0")))
             .select("row", "start", (F.col("start") + F.col("n") + (length - 1)).alias("end")))
    several = written(firsts.groupBy(key).agg(F.count("*").alias("bodies")).where("bodies > 1").select(key), "several")
    return later, firsts.join(several, key).select(key, "p.*")


def _with_texts(docs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, row, text, parts): the documents of ``rows`` with their rows as a list (of one document each)."""
    parts = written(rows.groupBy("row").agg(F.collect_list(F.struct(*columns)).alias("parts")), "parts")
    known = docs.sparkSession.sparkContext.broadcast(bitmap(parts.select(F.xxhash64("row").alias("mark")), "mark"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(known.value, batch.column("mark").to_numpy()))).drop_columns(["mark"])

    rows = docs.select("doc_id", "row", "text")
    few = rows.withColumn("mark", F.xxhash64("row")).mapInArrow(some, rows.schema)
    return few.join(parts, "row")


def _parts(batch: pa.RecordBatch, offs: np.ndarray, *names: str) -> tuple[np.ndarray, ...]:
    """The rows (numbers in the batch) and fields of the lists of a batch."""
    lists = batch.column("parts")
    row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    return (row, *(flat.field(n).to_numpy() for n in names))


def _class_rows(docs: DataFrame, segments: DataFrame, length: int, width: int) -> DataFrame:
    """(core, body, doc_id, row, start, n) of the classes of the segments (row, start, n, offset)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in text_chunks(batches):
            row, start, n, offset = _parts(batch, offs, "start", "n", "offset")
            h = PrefixHash(data)
            first, base = offs[row] + start, offs[row]
            at, last = first + offset, first + n - 1
            for k in range(-(-(length - GRAM + 1) // width)):
                lo, hi = np.maximum(first, at - width * (k + 1) + 1), np.minimum(last, at - width * k)
                ok = lo <= hi
                lo, hi, r = lo[ok], hi[ok], row[ok]
                core = h.of(at[ok] - width * k, at[ok] - width * (k + 1) + 1 + length)
                yield _batch(core=mix(core + U64(k)), body=h.of(lo, hi + length), doc_id=batch.column("doc_id").take(pa.array(r)),
                             row=batch.column("row").to_numpy()[r], start=lo - base[ok], n=hi - lo + 1)

    schema = T.StructType().add("core", "long").add("body", "long").add(docs.schema["doc_id"])
    for c in ("row", "start", "n"):
        schema.add(c, "long")
    return _with_texts(docs, segments, "start", "n", "offset").mapInArrow(run, schema)


def _string_rows(docs: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """(core, body, doc_id, row, start, n = 1) of the strings of the classes (core, row, start, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in text_chunks(batches):
            row, core, start, n = _parts(batch, offs, "core", "start", "n")
            each = np.repeat(np.arange(len(n)), n)
            start = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            r = row[each]
            at = offs[r] + start
            yield _batch(core=core[each], body=PrefixHash(data).of(at, at + length), doc_id=batch.column("doc_id").take(pa.array(r)),
                         row=batch.column("row").to_numpy()[r], start=start, n=np.ones_like(start))

    schema = T.StructType().add("core", "long").add("body", "long").add(docs.schema["doc_id"])
    for c in ("row", "start", "n"):
        schema.add(c, "long")
    return _with_texts(docs, classes, "core", "start", "n").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, start, end) in bytes, overlapping, that cover what is to be removed; ``docs`` has
    doc_id, text and row (see ``common.numbered``)."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    texts = written(docs.select("doc_id", "row", size.alias("n_bytes"), F.xxhash64("text").alias("k1"),
                                F.xxhash64(F.lit(1), "text", F.lit(2)).alias("k2")).where(F.col("n_bytes") >= length), "texts")
    firsts = written(texts.groupBy("k1", "k2", "n_bytes").agg(F.min(F.struct("doc_id", "row"))["row"].alias("first"),
                                                              F.count("*").alias("copies")), "first-texts")
    copies = (texts.join(firsts.where("copies > 1"), ["k1", "k2", "n_bytes"]).where("row <> first")
              .select("row", F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    copies = written(copies, "copies")
    spark = docs.sparkSession
    # copies add no string that does not start earlier; a bitmap of the firsts leaves out most of them
    some = spark.sparkContext.broadcast(bitmap(firsts.select(F.xxhash64("first").alias("mark")), "mark"))

    def first_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(some.value, batch.column("mark").to_numpy()))).drop_columns(["mark"])

    rows = docs.select("doc_id", "row", "text")
    rows = rows.withColumn("mark", F.xxhash64("row")).mapInArrow(first_only, rows.schema)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offs in text_chunks(batches):
            yield _batch(anchor=Segments(data, offs, length).anchor)

    twice = rows.mapInArrow(anchors, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    wanted = spark.sparkContext.broadcast(bitmap(twice, "anchor", BITMAP_BITS))
    segments = written(_segment_rows(rows, wanted, length), "segments")
    later, more = _family(segments, "anchor", "body", length, "offset")
    spans = [copies, written(later, "later")]
    classes = written(_class_rows(docs, more, length, CLASS), "classes")
    later, more = _family(classes, "core", "body", length)
    spans.append(written(later, "later"))
    strings = written(_string_rows(docs, more, length), "strings")
    later, _ = _family(strings, "core", "body", length)
    spans.append(written(later, "later"))
    return spans[0].union(spans[1]).union(spans[2]).union(spans[3])


def without_spans(docs: DataFrame, spans: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, binary) of every row of ``docs``."""
    lists = written(spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("parts")), "spans")
    rows = docs.select("doc_id", "row", "text").join(lists, "row", "left").select("doc_id", "text", "parts")
    schema = T.StructType([docs.schema["doc_id"]]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    schema.add("kept_sha256", "string")
    if with_text:
        schema.add("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema.names[1:]]
            for text, parts in zip(batch.column("text"), batch.column("parts")):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                kept, n_spans, end = [], 0, -1
                at = 0
                if parts.is_valid:
                    flat = parts.values
                    for a, b in zip(flat.field("start").to_pylist(), flat.field("end").to_pylist()):
                        if a > end:  # touching spans are one
                            kept.append(raw[at:a])
                            n_spans += 1
                        end = max(end, b)
                        at = end
                kept.append(raw[at:])
                left = b"".join(kept)
                for col, v in zip(out, (len(raw), len(raw) - len(left), n_spans, hashlib.sha256(left).hexdigest(), left)):
                    col.append(v)
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, kinds))], names=schema.names)

    return rows.mapInArrow(run, schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document without the 100-byte strings that also start earlier."""
    docs = numbered(documents(spark, sf_dir).select("doc_id", "text"))
    return without_spans(docs, repeated_spans(docs), with_text=False)
