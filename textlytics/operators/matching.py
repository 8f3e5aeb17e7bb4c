"""Which of a list's keywords a text contains as a substring (R4, ST2).

A short list is tested in the row.  Of a long list each keyword is looked for by one signature only: of
its substrings of ``GRAM`` characters (or itself, if it is shorter) the one that texts have least
often, as measured first on a bounded sample of them, and of those the one that fewest keywords have.  So
keywords with a common beginning are told apart by what follows it.

Every text that contains a keyword has its signature among its own substrings.  A bitmap of fixed size says
which substrings may be signatures; a text keeps those, they are joined with the signatures, and the
keyword is verified on the text.  Signatures of up to ``SENT_KEYWORDS`` keywords are sent to the texts, which are
not shuffled.  A longer list never travels whole: the substrings meet it with the number of their text only, and each
text then meets its candidates once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import spread
from .ordering import bounded_broadcast, cut, is_bounded

#: characters of a signature
GRAM = 4
#: texts on which the frequencies of substrings are measured; they decide the cost, never the rows
SAMPLE_ROWS = 2000
#: bits of the bitmap of signatures, as a power of two; two for each signature
BITS = 23
#: keywords whose signatures are sent to every task
SENT_KEYWORDS = 200_000
#: entries of a keyword list that are tested one by one in each row
IN_ROW_KEYWORDS = 500


def _grams(text: Column, lengths: Iterable[int]) -> Column:
    """The hashes of all substrings of these lengths of a text: for each length, the
    matches of that many characters from each of the first places on."""
    runs = [F.regexp_extract_all(F.substring(text, start + 1, 2**31 - 1) if start else text,
                                 F.lit("(?s)" + "." * length), F.lit(0))
            for length in lengths for start in range(length)]
    return F.array_distinct(F.transform(F.concat(*runs), lambda g: F.xxhash64(g)))


def signatures(keywords: DataFrame, sample: DataFrame | None, gram: int = GRAM) -> DataFrame:
    """(keyword, n, gram, length): each distinct keyword with its entries in the list, the hash of
    its signature and that signature's length.  ``sample`` has a column ``_lower``."""
    kw = keywords.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    length = F.least(F.length("keyword"), F.lit(gram))
    parts = F.when(F.length("keyword") <= gram, F.array(F.xxhash64("keyword"))).otherwise(_grams(F.col("keyword"), [gram]))
    each = cut(kw.select("keyword", "n", length.alias("length"), F.explode(parts).alias("gram")))
    shared = each.groupBy("gram", "length").agg(F.count(F.lit(1)).alias("keywords"))
    if sample is not None:
        seen = (sample.select(F.explode(_grams(F.col("_lower"), range(1, gram + 1))).alias("gram"))
                .groupBy("gram").agg(F.count(F.lit(1)).alias("texts")))
        shared = shared.join(seen, "gram", "left")
    else:
        shared = shared.withColumn("texts", F.lit(0).cast("long"))
    rare = F.struct(F.coalesce("texts", F.lit(0)), "keywords", "gram")
    return cut(each.join(cut(shared), ["gram", "length"]).groupBy("keyword")
               .agg(F.min_by(F.struct("n", "gram", "length"), rare).alias("s")).select("keyword", "s.*"))


def _slots(gram: Column, bits: int) -> list[Column]:
    mask = F.lit((1 << bits) - 1).cast("long")
    return [gram.bitwiseAND(mask), F.shiftright(gram, 32).bitwiseAND(mask)]


def _bitmap(found: DataFrame, bits: int) -> Column:
    """One row with 2**(bits - 6) longs in which both bits of each signature are set, as a scalar column."""
    words = (found.select(F.explode(F.array(*_slots(F.col("gram"), bits))).alias("slot"))
             .groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("m")))
    whole = found.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("w")).join(words, "w", "left")
    ordered = F.array_sort(F.collect_list(F.struct("w", F.coalesce("m", F.lit(0).cast("long")).alias("m"))))
    return cut(whole.agg(ordered.getField("m").alias("words"))).scalar()


def _may_be(gram: Column, words: Column, bits: int) -> Column:
    def one(slot: Column) -> Column:
        return F.getbit(F.get(words, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
    first, second = _slots(gram, bits)
    return one(first) & one(second)


def keyword_matches(tickets: DataFrame, keywords: DataFrame, *carry: str, in_row: int = IN_ROW_KEYWORDS) -> DataFrame:
    """(carry.., keyword): a row for each ticket and keyword entry that its lower-cased ``title``
    contains.  The rows are the same for a list of any length; how they are found is not: up to ``in_row``
    entries travel as one array and are tested in the row, a longer list is joined by signatures."""
    listed = keywords.select("keyword").where(F.length("keyword") > 0)
    few = [r["keyword"] for r in listed.orderBy("keyword").limit(in_row + 1).collect()]
    rows = tickets.select(*carry, F.lower(F.coalesce("title", F.lit(""))).alias("_lower"))
    if len(few) <= in_row:
        entries = F.array(*[F.lit(k) for k in few]).cast("array<string>")
        held = F.filter(entries, lambda k: F.contains(F.col("_lower"), k))
        return rows.select(*carry, F.explode_outer(held).alias("keyword")).where(F.col("keyword").isNotNull())
    if carry and not tickets.isStreaming:
        rows = spread(tickets, carry[0]).select(*carry, F.lower(F.coalesce("title", F.lit(""))).alias("_lower"))
    # a stream cannot be looked at beforehand: there the keywords' own substrings decide
    found = signatures(listed, None if tickets.isStreaming else rows.select("_lower").limit(SAMPLE_ROWS))
    lengths = [r["length"] for r in found.select("length").distinct().orderBy("length").collect()]  # GRAM rows at most
    if not lengths:
        return rows.select(*carry, F.lit(None).cast("string").alias("keyword")).where(F.lit(False))
    words = _bitmap(found, BITS)

    # explode_outer: plain explode would add a filter that makes the substrings twice.  The bitmap is looked at
    # in the same generated loop, so the text is copied for the substrings that pass only.
    def hits(texts: DataFrame, *columns: str) -> DataFrame:
        return (texts.select(*columns, F.explode_outer(_grams(F.col("_lower"), lengths)).alias("gram"))
                .where(F.col("gram").isNotNull() & _may_be(F.col("gram"), words, BITS))
                .join(bounded_broadcast(found.select("keyword", "n", "gram"), SENT_KEYWORDS), "gram"))

    if tickets.isStreaming or is_bounded(found, SENT_KEYWORDS):
        held = hits(rows, *carry, "_lower").where(F.contains(F.col("_lower"), F.col("keyword")))
        return held.select(*carry, F.explode(F.array_repeat("keyword", F.col("n").cast("int"))).alias("keyword"))
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))  # written: the numbers stay
    of = hits(rows, "_row").groupBy("_row").agg(F.collect_list(F.struct("keyword", "n")).alias("_of"))  # of one text
    held = F.filter("_of", lambda k: F.contains(F.col("_lower"), k["keyword"]))
    return (rows.join(of, "_row").select(*carry, F.explode(held).alias("_k"))
            .select(*carry, F.explode(F.array_repeat("_k.keyword", F.col("_k.n").cast("int"))).alias("keyword")))
