"""Connected groups of near copies from buckets, without all pairs of a bucket.

``connected`` takes members (bucket, node, sketch): nodes that share a bucket and whose
sketches differ in ``limit`` bits at most (and that meet the caller's further condition) are candidates.  It finds the connected
components of the verified candidates:

1. Each bucket has one or two centres: its first node and, with more than ``SMALL`` members, the one
   whose sketch is nearest to the majority of all their sketches (copies of one original
   resemble it more than each other).  Every member is a candidate with each of them, so a
   bucket costs rows in proportion to its members, however large it is.
2. Components of the verified links.
3. A pair of a bucket that is still in two components may yet be linked.  The members
   outside a bucket's largest component meet all its members of other components; the
   sketches are compared inside the join.  Pairs within one component need no test.
   In buckets of over ``LARGE`` members ``bound`` rules out pairs, if given: it has for every node its
   size and a wide sketch.  Sizes bound the Jaccard similarity.  Without ``bound`` the
   pairs of such buckets also agree on one of ``limit`` + 1 parts of their sketches, if those have
   ``PART_BITS`` bits or more.
4. Components of all verified links.

So every candidate pair has been tested or is connected already, or ruled out by its sketches.
Sketches are probabilistic, the narrow and the wide one: the chance to lose a near copy follows from
the limits that the caller sets.  The other bounds are exact.
Tables that a hot bucket or node makes uneven are written first and joined as such, so
that adaptive execution can split their partitions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlytics.llm.common import drop, passing, written

#: members up to which a bucket has one centre
SMALL = 8
#: members beyond which a bucket's pairs of step 3 are bounded first
LARGE = 64
#: bits of a part of a sketch below which parts rule out too little
PART_BITS = 8
#: links up to which the driver finds components (16 bytes each)
FEW_LINKS = 1 << 20


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links and the smallest node that each is connected with."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    root = np.arange(len(node))
    while len(a):
        lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = lo < hi
        a, b = a[apart], b[apart]
        np.minimum.at(root, hi[apart], lo[apart])
        while (root[root] != root).any():
            root = root[root]
    return node, node[root]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); the root is the smallest node.

    Up to ``FEW_LINKS`` links are grouped on the driver, in a few megabytes.  With more, two steps alternate until
    nothing changes: link the larger neighbours of every node to its smallest neighbour, then the smaller
    ones.  Each round's links are written."""
    spark = links.sparkSession
    with passing(spark) as keep:
        now = keep(written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                           .distinct(), "links"))
    if now.isEmpty():
        return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    if now.count() <= FEW_LINKS:
        got = now.toArrow()
        node, root = _roots(*(got.column(c).to_numpy() for c in ("a", "b")))
        return spark.createDataFrame(pa.table({"node": node, "root": root}))
    mark = None
    while True:
        with passing(spark) as keep:
            both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
            least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
            larger = (both.where("v > u").join(least, "u").where("v <> m")
                      .select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())
            larger = written(larger, "larger")
            least = written(larger.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")), "least")
            smaller = (larger.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u")
                       .select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b"))
            now = keep(written(smaller.union(least.select("m", "u")).distinct(), "links"))
        total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(total) == mark:
            break
        mark = tuple(total)
    # now every link goes from a root to a node of its star
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def _majority(rows: DataFrame) -> DataFrame:
    """(bucket, most): the majority of each bit of the sketches of a bucket."""
    sums = [F.sum(F.shiftrightunsigned("sketch", k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(64)]
    bits = [F.when(2 * F.col(f"b{k}") > F.col("n"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))
            for k in range(64)]
    most = bits[0]
    for b in bits[1:]:
        most = most.bitwiseOR(b)
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), *sums).select("bucket", most.alias("most"))


def connected(members: DataFrame, limit: int, verify: Callable[[DataFrame], DataFrame],
              bound: Callable[[DataFrame], DataFrame] | None = None, threshold: float = 0.0,
              wide_limit: int = 0, pairs: DataFrame | None = None, alike: Column | None = None,
              columns: tuple[str, ...] = ()) -> DataFrame:
    """(node, root) of the nodes with a verified link.

    ``members``: bucket long, node long, sketch long, a node once in a bucket.
    ``verify``: from distinct pairs (a, b) with a < b those that are near copies; when it is called,
    ``members`` and ``pairs`` are not read any more.
    ``bound``: from nodes to (node, size, and longs w0_, w1_ .. of a wide sketch); near copies
    have a Jaccard similarity of ``threshold`` at least, and their wide sketches differ in
    ``wide_limit`` bits at most.
    ``pairs``: candidates (a, b) with a < b that the caller has found in further buckets.
    ``alike``: a further condition on candidates, of ``columns`` of the members and the same
    with a 2 at the end."""
    near = F.bit_count(F.col("sketch").bitwiseXOR(F.col("sketch2"))) <= limit
    if alike is not None:
        near &= alike
    given = pairs
    with passing(members.sparkSession) as keep:  # on the way
        shared = written(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
        live = written(members.join(shared, "bucket"), "members")
        centre = ["bucket", *(F.col("c")[c].alias(c + "2") for c in ("node", "sketch", *columns))]
        first = live.groupBy("bucket").agg(F.min(F.struct("node", "sketch", *columns)).alias("c")).select(*centre)
        many = live.where(F.col("n") > SMALL)
        most = written(_majority(many), "majority")
        away = F.bit_count(F.col("sketch").bitwiseXOR(F.col("most")))
        middle = many.join(most, "bucket").groupBy("bucket").agg(F.min(F.struct(away.alias("away"), "node", "sketch", *columns)).alias("c"))
        centres = written(first.union(middle.select(*centre)).distinct(), "centres")

        def pairs(rows: DataFrame) -> DataFrame:
            return rows.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()

        tried = pairs(live.join(centres, "bucket").where(F.col("node") != F.col("node2")).where(near))
        tried = written(tried if given is None else tried.union(given.select("a", "b")).distinct(), "tried")
        links = written(verify(tried), "verified")
        placed = written(components(links), "components")

        comp = F.coalesce("root", "node").alias("comp")
        lives = written(live.join(placed, "node", "left").select("bucket", "n", "node", "sketch", *columns, comp), "placed")
        drop(live)
        sizes = lives.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
        mixed = written(sizes.groupBy("bucket").agg(F.max(F.struct("k", "comp"))["comp"].alias("main"), F.count("*").alias("comps"))
                        .where("comps > 1").drop("comps"), "mixed")
        open_ = written(lives.join(mixed, "bucket"), "open")
        drop(lives)

        def rest(rows: DataFrame, *more: str) -> DataFrame:
            """Candidates in different components of a bucket, one of them not in the main one."""
            strays = rows.where("comp <> main").select("bucket", *[F.col(c).alias(c + "2") for c in ("node", "sketch", "comp", *columns, *more)])
            once = (F.col("comp") == F.col("main")) | (F.col("node") < F.col("node2"))
            return rows.join(strays, "bucket").where((F.col("comp") != F.col("comp2")) & once & near)

        large = open_.where(F.col("n") > LARGE)
        if bound is None and 64 // (limit + 1) < PART_BITS:
            more = pairs(rest(open_))
        elif bound is None:
            # sketches that differ in few bits agree on one of limit + 1 parts
            width = min(62, 64 // (limit + 1))
            parts = [F.xxhash64("bucket", F.lit(k), F.shiftrightunsigned("sketch", k * width).bitwiseAND(F.lit((1 << width) - 1)))
                     for k in range(limit + 1)]
            finer = large.withColumn("bucket", F.explode(F.array(*parts)))
            more = pairs(rest(open_.where(F.col("n") <= LARGE))).union(pairs(rest(finer))).distinct()
        else:
            known = written(bound(large.select("node").distinct()), "bounds")
            large = written(large.join(known, "node"), "large")
            able = F.least("size", "size2") >= threshold * F.greatest("size", "size2")
            wide = [c for c in known.columns if c[0] == "w"]
            apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(c + "2"))) for c in wide), F.lit(0))
            more = pairs(rest(open_.where(F.col("n") <= LARGE))).union(
                pairs(rest(large, "size", *wide).where(able & (apart <= wide_limit)))).distinct()
        more = written(more.join(tried, ["a", "b"], "left_anti"), "strays")
        drop(open_, tried)
        if more.isEmpty():
            return keep(placed)
        found = written(verify(more), "verified")
        if found.isEmpty():
            return keep(placed)
        # the stars of the first components stand for their links
        return keep(written(components(placed.select(F.col("root").alias("a"), F.col("node").alias("b")).union(found)), "components"))
