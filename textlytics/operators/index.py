"""Indexing (S3, S4, T2): corpus rows → postings.

The postings table replaces the inverted index.  Per-document statistics that
the original kept as norms (token count) or recomputed per query (distinct
term count) are computed in-row, before the explode, and carried on every
posting, so scoring never needs a join back to the documents.

Shuffle: none of postings.  A document's terms are sorted and counted in its own row, so a
posting is made once, with its tf.  Only rows that share an id with another row (ids are counted first) are
put together with it, by a ``groupBy(doc_id, term)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import MAX_TOKEN_LENGTH, STOP_WORDS, TOKEN_PATTERN, analyze, keep_token, raw_tokens, term_counts
from .ordering import cut, running_totals

POSTINGS_COLUMNS = ("doc_id", "term", "tf", "doc_len", "doc_terms")
POSTINGS_SCHEMA = "doc_id long, term string, tf long, doc_len long, doc_terms long"


#: operators over which a scan keeps its partitions
_NARROW = {"Project", "Filter", "LogicalRelation", "SubqueryAlias", "View"}


def _scans_only(plan) -> bool:
    children = plan.children()
    return plan.nodeName() in _NARROW and all(_scans_only(children.apply(i)) for i in range(children.size()))


def spread(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Guarantee enough tasks for the CPU-bound analyser.

    A corpus stored as a few large row groups scans as a few partitions and
    would be tokenised by a few cores.  Only then it is hash-partitioned by
    document id (deterministic under retries; ids are unique, so balanced).
    A large corpus already scans as thousands of splits and is left as is, and
    so is a plan with a shuffle (counting its partitions would run it)."""
    if not hasattr(docs, "_jdf") or not _scans_only(docs._jdf.queryExecution().optimizedPlan()):
        return docs
    target = docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() >= target:
        return docs
    return docs.repartition(target, F.col(id_col))


def analyzed_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  pattern: str = TOKEN_PATTERN, stop=STOP_WORDS,
                  max_len: int = MAX_TOKEN_LENGTH) -> DataFrame:
    """(doc_id, terms array, doc_len, doc_terms) — one row per document, no shuffle."""
    terms = analyze(text_col, pattern, stop, max_len)
    return (spread(docs, id_col).select(F.col(id_col).cast("long").alias("doc_id"), terms.alias("terms"))
            .withColumn("doc_len", F.size("terms").cast("long"))
            .withColumn("doc_terms", F.size(F.array_distinct("terms")).cast("long")))


#: repeated document ids that are sent to every task; with more, all rows are put together by id
REPEATED_IDS = 200_000


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys.., term, tf, doc_len, doc_terms) of rows (keys.., terms), each row by itself.  No shuffle."""
    # explode_outer: plain explode makes Catalyst add a size(...) > 0 filter,
    # which evaluates the regex a second time per document.
    return (rows.select(*keys, F.size("terms").cast("long").alias("doc_len"), term_counts("terms").alias("counts"))
            .select(*keys, "doc_len", F.size("counts").cast("long").alias("doc_terms"), F.explode_outer("counts").alias("c"))
            .where(F.col("c").isNotNull())
            .select(*keys, F.col("c.term").alias("term"), F.col("c.tf").alias("tf"), "doc_len", "doc_terms"))


def _by_occurrence(docs: DataFrame, id_col: str) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of ``docs`` whose id no other row has, and those that share theirs; None where there are none, or
    where too many share theirs to tell them apart without a shuffle (then all rows are the second part)."""
    number = F.col(id_col).cast("long")
    twice = cut(docs.groupBy(number.alias("_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id"))
    n = twice.limit(REPEATED_IDS + 1).count()
    rows = spread(docs, id_col)
    if not n:
        return rows, None
    if n > REPEATED_IDS:
        return None, rows
    known = F.broadcast(twice)
    single, shared = (rows.join(known, number.eqNullSafe(F.col("_id")), how) for how in ("left_anti", "left_semi"))
    return single, shared


def _by_id(docs: DataFrame, id_col: str, analyzed, *keys: str, norm: bool = False) -> DataFrame:
    """The postings of ``analyzed(docs)``, rows (keys.., terms) with ``doc_id`` among the keys; the terms of rows with one id count together.
    With ``norm`` a column l1 has the sum of tf of the row's keys."""
    def alone(rows: DataFrame) -> DataFrame:
        counted = _counted(analyzed(rows), *keys)
        return counted.withColumn("l1", F.col("doc_len")) if norm else counted

    def together(rows: DataFrame) -> DataFrame:
        counted = (_counted(analyzed(rows), *keys).groupBy(*keys, "term")
                   .agg(F.sum("tf").alias("tf"), F.max("doc_len").alias("doc_len"), F.max("doc_terms").alias("doc_terms")))
        return counted.withColumn("l1", F.sum("tf").over(Window.partitionBy(*keys))) if norm else counted  # one document

    if docs.isStreaming:
        return together(docs)
    single, shared = _by_occurrence(docs, id_col)
    if single is None or shared is None:
        return together(shared) if single is None else alone(single)
    return alone(single).unionByName(together(shared))


def document_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = TOKEN_PATTERN,
                  stop=STOP_WORDS, max_len: int = MAX_TOKEN_LENGTH) -> DataFrame:
    """(doc_id, terms): the distinct terms of each document, as the postings have them.  No shuffle but of rows that share an id."""
    def sets(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.array_distinct(analyze(text_col, pattern, stop, max_len)).alias("terms"))

    single, shared = _by_occurrence(docs, id_col)
    if shared is None:
        return sets(single)
    joined = (sets(shared).select("doc_id", F.explode_outer("terms").alias("term"))
              .groupBy("doc_id").agg(F.collect_set("term").alias("terms")))  # one document
    return joined if single is None else sets(single).unionByName(joined)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             pattern: str = TOKEN_PATTERN, stop=STOP_WORDS,
             max_len: int = MAX_TOKEN_LENGTH, norm: bool = False) -> DataFrame:
    """Postings of one text field: (doc_id, term, tf, doc_len, doc_terms), with ``norm`` also l1, the sum of the document's tf."""
    def analyzed(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(id_col).cast("long").alias("doc_id"), analyze(text_col, pattern, stop, max_len).alias("terms"))
    return _by_id(docs, id_col, analyzed, "doc_id", norm=norm).select(*POSTINGS_COLUMNS, *(["l1"] if norm else []))


#: listed terms that travel as one array; a longer list is joined with the postings of all documents
LISTED = 500


def listed_postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    pattern: str = TOKEN_PATTERN, stop=STOP_WORDS, max_len: int = MAX_TOKEN_LENGTH,
                    listed: int = LISTED) -> DataFrame:
    """The postings of the terms of a list (``terms.term``), as in :func:`postings`, without analysing every text.

    A term of a text is a part of its lower-cased form, so a text that contains no listed
    term as a substring cannot have one and is left out before the analyser; and only listed terms are
    exploded.  ``doc_len`` and ``doc_terms`` are those of the whole document.  A list of more than
    ``listed`` terms, of which most texts contain some, is joined with the postings of all documents instead."""
    few = [r.term for r in terms.select("term").where(F.col("term").isNotNull()).distinct().limit(listed + 1).collect()]
    if len(few) > listed:
        return postings(docs, id_col, text_col, pattern, stop, max_len).join(terms.select("term").distinct(), "term", "left_semi").select(
            *POSTINGS_COLUMNS)
    wanted = F.array(*[F.lit(t) for t in sorted(few)]).cast("array<string>")
    # the lower-cased text is bound once, as the one element of an array
    held = F.exists(F.array(F.lower(F.col(text_col))), lambda text: F.exists(wanted, lambda t: F.contains(text, t)))
    a = analyzed_docs(spread(docs, id_col).where(held), id_col, text_col, pattern, stop, max_len)
    return (a.select("doc_id", "doc_len", "doc_terms",
                     F.explode_outer(F.filter("terms", lambda t: F.array_contains(wanted, t))).alias("term"))
            .where(F.col("term").isNotNull()).groupBy("doc_id", "term")
            .agg(F.count(F.lit(1)).alias("tf"), F.max("doc_len").alias("doc_len"), F.max("doc_terms").alias("doc_terms"))
            .select(*POSTINGS_COLUMNS))


INDEX_COLUMNS = ("doc_id", "field", "term", "tf", "doc_len", "doc_terms")


def index_documents(docs: DataFrame, id_col: str = "doc_id",
                    fields: Sequence[str] | None = None, pattern: str = TOKEN_PATTERN,
                    stop=STOP_WORDS, max_len: int = MAX_TOKEN_LENGTH) -> DataFrame:
    """S3: postings for every listed field (default: all but the id) of every record,
    (doc_id, field, term, tf, doc_len, doc_terms).

    The postings of one field (:func:`field_postings`) are what every other operator
    reads.  Non-string fields are indexed by their text form; NULL cells give no terms."""
    if fields is None:
        fields = [c for c in docs.columns if c != id_col]
    cells = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields
    ])).alias("cell")

    def analyzed(rows: DataFrame) -> DataFrame:
        return (rows.select(F.col(id_col).cast("long").alias("doc_id"), cells)
                .select("doc_id", F.col("cell.field").alias("field"), analyze(F.col("cell.value"), pattern, tuple(stop), max_len).alias("terms")))
    return _by_id(docs, id_col, analyzed, "doc_id", "field").select(*INDEX_COLUMNS)


def field_postings(index: DataFrame, field: str) -> DataFrame:
    """The postings of one field of an index, as :func:`postings` gives them."""
    return index.where(F.col("field") == field).select(*POSTINGS_COLUMNS)


def append_documents(path: str, new_docs: DataFrame, id_col: str = "doc_id",
                     fields: Sequence[str] | None = None, **analyzer) -> None:
    """Add the postings of new documents to the index saved at ``path``.

    New rows never touch existing postings, so this only writes new files."""
    write_index(new_docs, path, id_col, fields, mode="append", **analyzer)


def term_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   pattern: str = TOKEN_PATTERN, stop=STOP_WORDS,
                   max_len: int = MAX_TOKEN_LENGTH) -> DataFrame:
    """(doc_id, pos, term).  Positions count removed stop words, so the gaps
    they leave are kept, as in a positional index.  No shuffle."""
    stop = tuple(stop)
    return (spread(docs, id_col).select(F.col(id_col).cast("long").alias("doc_id"),
                        F.posexplode_outer(raw_tokens(text_col, pattern)).alias("pos", "term"))
            .where(F.col("term").isNotNull() & keep_token(F.col("term"), stop, max_len))
            .select("doc_id", F.col("pos").cast("long").alias("pos"), "term"))


#: documents of which the terms' ranges are measured, and postings of a range, about
SAMPLE_DOCS = 2000
RANGE_POSTINGS = 4_000_000


def _ranges(sample: DataFrame, times: float, least: int) -> list[tuple[str, str]]:
    """The (field, term) at which each range but the first begins, for ranges of about ``RANGE_POSTINGS``; ``sample`` is
    the index of some of the documents, of which there are ``times`` as many (at least ``least`` ranges, if there are terms)."""
    counts = cut(sample.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    each = total / max(least, -(-int(total * times) // RANGE_POSTINGS))
    if not total:
        return []
    before = running_totals(counts, [F.asc("field"), F.asc("term")], {"upto": "n"}, rank_col=None)
    first = F.floor((F.col("upto") - F.col("n")) / each).cast("long")  # the range that the term's first posting is in
    starts = before.groupBy(first.alias("range")).agg(F.min(F.struct("field", "term")).alias("at")).orderBy("range").collect()
    return [(r["at"]["field"], r["at"]["term"]) for r in starts][1:]


def _range_of(starts: list[tuple[str, str]]) -> Column:
    """The number of the range that (field, term) is in, by halving."""
    def part(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        field, term = starts[mid]
        return F.when((F.col("field") < field) | ((F.col("field") == field) & (F.col("term") < term)), part(lo, mid)).otherwise(part(mid + 1, hi))
    return part(0, len(starts))


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", fields: Sequence[str] | None = None,
                mode: str = "errorifexists", **analyzer) -> None:
    """Index documents and persist the index as :func:`save_index` does, analysing every document once.

    A range partitioning runs its input twice, the first time to measure the ranges.  Here they are measured
    on about ``SAMPLE_DOCS`` documents; that decides where files begin and end, and every document is indexed."""
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(1, n))
    sample = index_documents(docs if share == 1.0 else docs.sample(share, 17), id_col, fields, **analyzer)
    starts = _ranges(sample, 1 / share, docs.sparkSession.sparkContext.defaultParallelism)
    index = index_documents(docs, id_col, fields, **analyzer)
    (index.repartitionById(len(starts) + 1, _range_of(starts)).sortWithinPartitions("field", "term", "doc_id")
     .write.mode(mode).partitionBy("field").parquet(path))


def save_index(index: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Persist an index (or the postings of one field) as the corpus' inverted index.

    A folder for each field, range-partitioned and sorted by term within it: every
    file holds a contiguous term range and its row groups carry tight min/max term
    statistics, so a field filter prunes folders and a later ``term IN (...)``
    filter is pushed into the scan and skips files and row groups."""
    if "field" not in index.columns:
        index = index.withColumn("field", F.lit("text"))
    (index.repartitionByRange("field", "term").sortWithinPartitions("field", "term", "doc_id")
     .write.mode(mode).partitionBy("field").parquet(path))


def load_index(spark, path: str, field: str | None = None) -> DataFrame:
    """Read an index written by :func:`save_index`; with ``field``, its postings."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("term", T.StringType())]
                          + [T.StructField(c, T.LongType()) for c in ("tf", "doc_len", "doc_terms")]
                          + [T.StructField("field", T.StringType())])
    index = spark.read.schema(schema).parquet(path)
    return index.select(*INDEX_COLUMNS) if field is None else field_postings(index, field)
