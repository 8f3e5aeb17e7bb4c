"""MinHash near-dedup (operator 8): BagMinHash signatures, bands, verified overlap.

A document is the multiset of its five-word shingles (white-space words, A-Z in lower case; one to
four words are one shingle).  Two documents are near copies if the weighted Jaccard
similarity of their multisets, sum of minima over sum of maxima, is 0.8 or more.

* Signature.  A shingle of weight w stands for w unit intervals [0,1) .. [w-1,w).  For
  every shingle a Poisson process of rate one runs over each unit interval, and each
  point has a random register of ``REGISTERS``; a register keeps its earliest point.  Equal
  registers have the probability of the weighted Jaccard similarity (BagMinHash).
  The weight axis is cut into [0,1), [1,2), [2,4), [4,8) ..; a block's first point has the
  rate of its length.  A block splits into halves: one, picked at random, takes the point
  over, the other draws a later one.  Halves beyond the weight are left out, and so are
  blocks whose first point is later than all registers need.
* Bands.  ``BANDS`` bands of registers hash into buckets; a bit of every register makes a
  64-bit sketch, and candidates of one bucket that differ in over ``SKETCH_BITS`` bits
  (a similarity of 0.8 differs in 6.4 bits on average, with deviation 2.4) are passed over.
* Groups.  Documents with equal words are collapsed before, and ``groups.connected`` links the
  candidates whose multisets, compared exactly, overlap enough.

One row per input row: doc_id, class_id (the smallest id of the group), class_size,
n_shingles.  Defined cases: a document without words is alone in its class; repeated rows
are copies of each other; a null id counts as the smallest one and its class_id is null;
an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlytics.llm.common import (U64, bitmap, documents, mix, numbered, passes, seeded, shingle_hashes, text_chunks,
                                   word_hashes, written)
from textlytics.llm.groups import connected

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS = 64
BANDS = 16
SKETCH_BITS = 22
#: bits of the wide sketch in large buckets, and the most in which near copies may differ: a
#: similarity of 0.8 differs in 204.8 bits on average, with deviation 13.6 (binomial), so the bound is
#: probabilistic: 4.5 deviations, some 3 in a million such pairs are lost, fewer of more similar ones
WIDE_BITS = 2048
WIDE_LIMIT = 266
#: pairs of one document that are compared in one task at most, on average
PARTNERS = 256
#: registers that stay empty on average when points up to the first bound are drawn: e**-SLACK
SLACK = 4.0


def _exp(seed: np.ndarray) -> np.ndarray:
    """Exponentially distributed numbers from 64-bit seeds."""
    return -np.log(((mix(seed) >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53))


def _points(seed: np.ndarray, weight: np.ndarray, row: np.ndarray, bound: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(time, identity, row) of all points not later than the row's bound."""
    out = []
    # blocks of the weight axis: start, length, first point
    lo = np.zeros(len(seed), np.int64)
    parts = [(np.arange(len(seed)), lo, np.ones_like(lo))]
    at, size = np.flatnonzero(weight > 1), 1
    while len(at):
        parts.append((at, np.full(len(at), size), np.full(len(at), size)))
        at, size = at[weight[at] > 2 * size], 2 * size
    who, lo, size = (np.concatenate(x) for x in zip(*parts))
    node = mix(seed[who] + (lo + 1).astype(U64) * U64(0x9E3779B97F4A7C15) + size.astype(U64))
    t = _exp(node) / size
    near = t <= bound[row[who]]
    who, lo, size, node, t = who[near], lo[near], size[near], node[near], t[near]
    while True:
        unit = size == 1
        out.append((t[unit], node[unit], row[who[unit]]))
        wide = ~unit
        if not wide.any():
            break
        who, lo, size, node, t = who[wide], lo[wide], size[wide] // 2, node[wide], t[wide]
        right = (mix(node + U64(3)) & U64(1)).astype(bool)
        halves = []
        for side in (0, 1):
            child = mix(node + U64(5 + side))
            later = t + _exp(child + U64(9)) / size
            halves.append((who, lo + side * size, size, child, np.where(right == bool(side), t, later)))
        who, lo, size, node, t = (np.concatenate(x) for x in zip(*halves))
        near = (lo < weight[who]) & (t <= bound[row[who]])
        who, lo, size, node, t = who[near], lo[near], size[near], node[near], t[near]
    # the later points of the unit intervals
    t, node, r = (np.concatenate(x) for x in zip(*out))
    found = []
    while len(t):
        found.append((t, node, r))
        node = mix(node + U64(0xA0761D6478BD642F))
        t = t + _exp(node)
        near = t <= bound[r]
        t, node, r = t[near], node[near], r[near]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (t, node, r)


def signatures(shingle: np.ndarray, weight: np.ndarray, row: np.ndarray, rows: int,
               registers: int = REGISTERS) -> np.ndarray:
    """The identities of each row's earliest points by register; rows without shingles have zeros.

    ``shingle`` are distinct within a row and ``weight`` their integer weights."""
    sig = np.zeros((rows, registers), U64)
    total = np.bincount(row, weight, minlength=rows)
    todo, factor = np.flatnonzero(total > 0), 1.0
    while len(todo):
        bound = np.zeros(rows)
        bound[todo] = factor * registers * (math.log(registers) + SLACK) / total[todo]
        inside = bound[row] > 0
        t, node, r = _points(shingle[inside], weight[inside], row[inside], bound)
        slot = r * registers + (mix(node + U64(7)) % U64(registers)).astype(np.int64)
        order = np.lexsort((t, slot))
        slot, node = slot[order], node[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
        filled = np.bincount(slot[first] // registers, minlength=rows) == registers
        good = first & filled[slot // registers]
        sig.reshape(-1)[slot[good]] = node[good]
        todo, factor = todo[~filled[todo]], 2 * factor
    return sig


def _units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of a chunk sorted within rows: (hash, row, occurrence from 0)."""
    h, row, _, _ = word_hashes(data, offs)
    s, srow = shingle_hashes(h, row, SHINGLE, len(offs) - 1)
    cut = np.searchsorted(srow, np.arange(len(offs)))
    for a, b in zip(cut, cut[1:]):
        s[a:b].sort()
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (srow[1:] != srow[:-1])
    at = np.flatnonzero(new)
    nth = np.arange(len(s)) - np.repeat(at, np.diff(np.append(at, len(s))))
    return s, srow, nth


def _keys(data: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """128-bit keys of the rows' words, the same for texts with the same words in order."""
    raw = data.tobytes()
    return [hashlib.blake2b(b" ".join(raw[a:b].lower().split()), digest_size=16).digest()
            for a, b in zip(offs, offs[1:])]


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, key, n_shingles, bands array<long>, sketch long), a row for each document."""
    mult = seeded(REGISTERS, 21) | U64(1)
    width = REGISTERS // BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in text_chunks(batches):
            rows = len(offs) - 1
            s, srow, nth = _units(data, offs)
            first = np.flatnonzero(nth == 0)
            weight = np.diff(np.append(first, len(s)))
            sig = signatures(s[first], weight, srow[first], rows)
            number = np.arange(BANDS, dtype=U64)
            band = mix((sig * mult).reshape(rows, BANDS, width).sum(2, dtype=U64) + number * U64(0x2545F4914F6CDD1D))
            sketch = ((sig & U64(1)) << np.arange(REGISTERS, dtype=U64)).sum(1, dtype=U64)
            count, keys = np.bincount(srow, minlength=rows), _keys(data, offs)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("row"), pa.array(keys, pa.binary()), pa.array(count),
                pa.ListArray.from_arrays(pa.array(np.arange(0, rows * BANDS + 1, BANDS, dtype=np.int32)),
                                         pa.array(band.reshape(-1).astype(np.int64))),
                pa.array(sketch.astype(np.int64))], names=["doc_id", "row", "key", "n_shingles", "bands", "sketch"])

    rows = docs.select("doc_id", "text", "row")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"]]).add("row", "long").add("key", "binary").add("n_shingles", "long")
                           .add("bands", T.ArrayType(T.LongType())).add("sketch", "long"))


def wide_bits(units: np.ndarray) -> np.ndarray:
    """One bit of each of ``WIDE_BITS`` minimum hashes of a multiset's elements.

    The minimum is mixed before: an odd multiplier keeps the lowest bit of an element."""
    mult = seeded(WIDE_BITS, 31) | U64(1)
    out = np.zeros(WIDE_BITS, np.uint8)
    for at in range(0, WIDE_BITS, 64):
        out[at:at + 64] = mix((units[:, None] * mult[None, at:at + 64]).min(0)) & U64(1)
    return out


class _Multisets:
    """The multisets of documents asked for, as sorted hashes of (shingle, occurrence)."""

    def __init__(self, docs: DataFrame):
        self.docs = docs

    def of(self, wanted: DataFrame) -> DataFrame:
        """The rows of ``wanted`` (node, ..) with units binary.  Nodes are row numbers; the documents are
        read again, and a bitmap of fixed size passes over most of the others before their words are cut."""
        known = wanted.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("node").alias("mark")), "mark"))

        def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = known.value
            for batch in batches:
                asked = batch.filter(pa.array(passes(words, batch.column("mark").to_numpy())))
                for part, some, cuts in text_chunks([asked]):
                    s, srow, nth = _units(some, cuts)
                    unit = mix(s + nth.astype(U64) * U64(0x9E3779B97F4A7C15))
                    cut = np.searchsorted(srow, np.arange(len(cuts)))
                    yield pa.RecordBatch.from_arrays([
                        part.column("row"), pa.array([np.sort(unit[x:y]).tobytes() for x, y in zip(cut, cut[1:])], pa.binary())],
                        names=["node", "units"])

        rows = self.docs.select("row", "text", F.xxhash64("row").alias("mark"))
        return wanted.join(rows.mapInArrow(units, "node long, units binary"), "node")

    def bound(self, nodes: DataFrame) -> DataFrame:
        """(node, size, w0..): the elements of a multiset and one bit of each of ``WIDE_BITS`` minimum hashes of the elements."""
        def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = np.zeros((batch.num_rows, WIDE_BITS), np.uint8)
                sizes = []
                for i, raw in enumerate(batch.column("units")):
                    units = np.frombuffer(raw.as_buffer(), U64)
                    sizes.append(len(units))
                    out[i] = wide_bits(units)
                longs = np.packbits(out, axis=1, bitorder="little").view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes, pa.int64()), *(pa.array(c) for c in longs.T.copy())],
                                                 names=["node", "size", *(f"w{k}_" for k in range(WIDE_BITS // 64))])

        names = [f"w{k}_" for k in range(WIDE_BITS // 64)]
        return self.of(nodes).mapInArrow(wide, ", ".join(f"{c} long" for c in ["node", "size", *names]))


def _overlaps(threshold: float):
    """Of rows (home, node, units) sorted by home, its own row first, the pairs whose multisets overlap enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, of = None, np.zeros(0, U64)
        for batch in batches:
            a, b = [], []
            for h, node, raw in zip(batch.column("home").to_pylist(), batch.column("node").to_pylist(), batch.column("units")):
                units = np.frombuffer(raw.as_buffer(), U64)
                if h == node:
                    home, of = h, units.copy()
                elif h == home and min(len(of), len(units)) >= threshold * max(len(of), len(units)):
                    both = np.sort(np.concatenate([of, units]))
                    n = np.count_nonzero(both[1:] == both[:-1])
                    if n >= threshold * (len(both) - n) - 1e-9:
                        a.append(min(h, node))
                        b.append(max(h, node))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _verifier(sets: _Multisets, threshold: float):
    """Candidate pairs of representatives to those whose multisets overlap enough.

    The document of a pair that has more pairs is its home.  The other's multiset goes there, and the
    home's own goes out once for each ``PARTNERS`` of its pairs, so no task holds more of a hot one."""
    def verify(pairs: DataFrame) -> DataFrame:
        degree = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.count("*").alias("n")), "degrees")
        both = (pairs.join(degree.select(F.col("node").alias("a"), F.col("n").alias("na")), "a")
                .join(degree.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b"))
        more = F.col("na") >= F.col("nb")
        node, parts = F.when(more, F.col("b")).otherwise(F.col("a")), F.ceil(F.greatest("na", "nb") / PARTNERS)
        meets = written(both.select(F.when(more, F.col("a")).otherwise(F.col("b")).alias("home"),
                                    F.pmod(F.xxhash64(node), parts).alias("part"), node.alias("node")), "meets")
        wanted = written(meets.union(meets.select("home", "part", F.col("home").alias("node")).distinct()), "asked")
        away = F.when(F.col("home") == F.col("node"), F.lit(0)).otherwise(F.lit(1))
        met = sets.of(wanted).repartition("home", "part").sortWithinPartitions("home", "part", away)
        return met.select("home", "node", "units").mapInArrow(_overlaps(threshold), pairs.schema)

    return verify


def near_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, class_size, n_shingles), a row for each row of ``docs``."""
    return _grouped(numbered(docs.select("doc_id", "text")), threshold).drop("row", "first")


def representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, with its columns, with one document of each group: the first with the smallest id.
    ``docs`` is read from files."""
    names = docs.columns
    rows = numbered(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
                                F.col("doc_id"), F.col("text")))
    others = written(_grouped(rows.select("doc_id", "text", "row"), threshold).where("row <> first").select("row"), "others")
    return (rows.join(others, "row", "left_anti")
            .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)]))


def _grouped(docs: DataFrame, threshold: float) -> DataFrame:
    """The classes with the number ``row`` of every document and ``first`` of its class."""
    rows = written(signed(docs).withColumn("node", F.col("row")), "signatures")
    wordy = rows.where("n_shingles > 0")
    first = F.min(F.struct("doc_id", "node", "bands", "sketch")).alias("r")
    reps = written(wordy.groupBy("key").agg(first).select("key", "r.*"), "representatives")
    members = (reps.select("node", "sketch", F.explode(F.array_distinct("bands")).alias("bucket"))
               .select("bucket", "node", "sketch"))
    sets = _Multisets(docs)
    placed = connected(members, SKETCH_BITS, _verifier(sets, threshold), sets.bound, threshold, WIDE_LIMIT)
    # the group of every text, and its first document
    of = written(reps.join(placed, "node", "left").select("key", "doc_id", "node", F.coalesce("root", "node").alias("root")), "placed")
    named = written(of.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("f")), "named")
    classes = written(of.join(named, "root").select("key", "root", F.col("f.doc_id").alias("class_id"), F.col("f.node").alias("first")),
                      "classes")
    sizes = written(wordy.groupBy("key").count().join(classes, "key").groupBy("root").agg(F.sum("count").alias("class_size")),
                    "sizes")
    classes = written(classes.join(sizes, "root"), "sized")
    grouped = wordy.select("doc_id", "key", "n_shingles", "row").join(classes, "key")
    cols = ["doc_id", "class_id", "class_size", "n_shingles", "row", "first"]
    alone = rows.where("n_shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"),
                                                "n_shingles", "row", F.col("row").alias("first"))
    return grouped.select(*cols).union(alone)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    return near_groups(documents(spark, sf_dir))
