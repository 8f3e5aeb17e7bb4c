"""Naive Bayes labelling and its evaluation.

Model (multinomial, +1 smoothed, as the classic simple Naive Bayes over an
index).  With D = documents having a class, D_c = documents whose category
contains class token c, hits(t, c) = class-c documents containing t, and
u = postings / documents-with-terms of the text field:

    log_prior(c) = ln D_c − ln D
    log_den(c)   = ln(u·D_c + D)
    score(d, c)  = log_prior(c) − n_d·log_den(c) + Σ_t tf(d,t)·ln(hits(t,c)+1)

The last form only needs the (class, term) pairs that exist, so training is
two aggregates and scoring is one join on term — no vocabulary × class
product.  The terms' weights are joined as vectors, one row for each term and block of ``BLOCK``
classes of which one has the term: with up to ``BLOCK`` classes the join has a row for each posting, with
more, one for each posting and block, and not for each posting and class.  The weights of the ``SENT_TERMS`` terms
with most hits are sent to every task: their postings are scored where they are read and leave as one partial
row for each document; only postings of the other, rare terms are shuffled.  The class list is that of the labels and travels as one array value
(a scalar sub-query); per document the argmax over it is a higher-order
function, ties going to the lowest class.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import analyze
from .ordering import cut

#: classes whose weights for a term stand in one row
BLOCK = 8
#: terms whose weights are sent to every task (as many rows of weights, also with several blocks)
SENT_TERMS = 200_000


@dataclass
class NBModel:
    classes: DataFrame      # (class, n_docs, log_prior, log_den)
    class_terms: DataFrame  # (class, term, hits)
    vectors: DataFrame      # (term, block, w0..), see :func:`class_vectors`


def class_tokens(labelled: DataFrame, id_col: str = "doc_id", class_col: str = "category") -> DataFrame:
    """(doc_id, class): the analysed tokens of each document's category."""
    return (labelled.select(F.col(id_col).cast("long").alias("doc_id"),
                            F.explode(F.array_distinct(analyze(F.col(class_col).cast("string")))).alias("class")))


def class_vectors(post: DataFrame, ct: DataFrame) -> DataFrame:
    """(term, block, w0..): ln(hits + 1) of a term for each class of a block, 0 where the class does not have
    it, straight from the postings and the documents' classes.  Classes are numbered in their order; a
    block is ``BLOCK`` of them."""
    listed = ct.agg(F.array_sort(F.collect_set("class")).alias("c")).select(F.posexplode("c").alias("i", "class"))
    placed = ct.join(listed, "class").select("doc_id", F.floor(F.col("i") / BLOCK).cast("int").alias("block"), (F.col("i") % BLOCK).alias("at"))
    # the documents of a partition make the hash table: postings are not sorted
    hits = post.select("doc_id", "term").join(placed.hint("shuffle_hash"), "doc_id").groupBy("term", "block").agg(
        *[F.count(F.when(F.col("at") == k, 1)).alias(f"h{k}") for k in range(BLOCK)])
    return hits.select("term", "block", *[F.log(F.col(f"h{k}") + 1.0).alias(f"w{k}") for k in range(BLOCK)])


def nb_train(post: DataFrame, labelled: DataFrame, id_col: str = "doc_id",
             class_col: str = "category") -> NBModel:
    """Train on (doc_id, category); ``post`` holds the text field of the
    whole index (labelled or not), which defines u."""
    ct = class_tokens(labelled, id_col, class_col)
    d_all = ct.select(F.countDistinct("doc_id")).scalar()
    # u = postings / documents with terms; no postings at all → 0 (not a division by zero)
    u_num, u_den = F.count(F.lit(1)), F.countDistinct("doc_id")
    u = post.agg(F.coalesce(F.try_divide(u_num.cast("double"), u_den), F.lit(0.0)).alias("u")).scalar()
    classes = (ct.groupBy("class").agg(F.countDistinct("doc_id").cast("long").alias("n_docs"))
               .select("class", "n_docs",
                       (F.log(F.col("n_docs").cast("double")) - F.log(d_all.cast("double"))).alias("log_prior"),
                       F.log(u * F.col("n_docs") + d_all).alias("log_den")))
    class_terms = (post.select("doc_id", "term").join(ct, "doc_id")
                   .groupBy("class", "term").agg(F.count(F.lit(1)).cast("long").alias("hits")))
    return NBModel(classes, class_terms, class_vectors(post, ct))


def _partial_scores(post: DataFrame, vectors: DataFrame, sent: int) -> DataFrame:
    """(doc_id, block, s0..): the sums of tf times weight of the documents' terms, for each block of classes."""
    rows = post.select("doc_id", "term", "tf")
    blocks = vectors.agg(F.coalesce(F.countDistinct("block"), F.lit(0))).first()[0]
    heavy = vectors.groupBy("term").agg(F.sum(sum((F.col(f"w{k}") for k in range(BLOCK)), F.lit(0.0))).alias("w"))
    top = cut(heavy.orderBy(F.desc("w"), "term").limit(max(1, sent // max(1, blocks))).select("term"))
    near = rows.join(F.broadcast(vectors.join(F.broadcast(top), "term", "left_semi")), "term")
    sums = [F.sum(F.col("tf") * F.col(f"w{k}")).alias(f"s{k}") for k in range(BLOCK)]
    parts = near.groupBy("doc_id", "block").agg(*sums)
    rare = cut(vectors.join(F.broadcast(top), "term", "left_anti"))
    if not rare.isEmpty():
        far = rows.join(F.broadcast(top), "term", "left_anti").join(rare, "term").groupBy("doc_id", "block").agg(*sums)
        parts = parts.unionByName(far).groupBy("doc_id", "block").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(BLOCK)])
    return parts


def nb_classify(post: DataFrame, docs: DataFrame, model: NBModel, id_col: str = "doc_id", sent: int = SENT_TERMS) -> DataFrame:
    """(doc_id, predicted, score) for every document of ``docs`` (of which only the
    ids are read: lengths are on the postings).  Scores do not depend on ``sent`` but for the order of their sums."""
    cls = model.classes.select(F.array_sort(F.collect_list(
        F.struct("class", "log_prior", "log_den"))).alias("c")).scalar()
    target = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    vectors = cut(model.vectors)
    # documents that are not asked for leave with their sums, a row each, and not with their postings
    partial = (_partial_scores(post, vectors, sent).groupBy("doc_id")  # a row for each block of classes
               .agg(F.map_from_entries(F.collect_list(F.struct("block", F.array(*[f"s{k}" for k in range(BLOCK)])))).alias("m")))
    lens = (target.join(post.groupBy("doc_id").agg(F.max("doc_len").alias("doc_len")), "doc_id", "left")
            .select("doc_id", F.coalesce("doc_len", F.lit(0)).alias("doc_len")))
    # the class array is projected first: sub-queries may not sit inside a lambda
    scored = lens.join(partial, "doc_id", "left").withColumn("_cls", cls).select(
        "doc_id",
        F.array_max(F.transform("_cls", lambda c, i: F.struct(
            (c["log_prior"] - F.col("doc_len") * c["log_den"]
             + F.coalesce(F.get(F.col("m")[F.floor(i / BLOCK).cast("int")], (i % BLOCK).cast("int")), F.lit(0.0))).alias("score"),
            (-i).alias("neg_idx"), c["class"].alias("class")))).alias("best"))
    return scored.select("doc_id", F.col("best.class").alias("predicted"), F.col("best.score").alias("score"))


def nb_label_unlabelled(post: DataFrame, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                        class_col: str = "category") -> DataFrame:
    """Train on the labelled documents, predict those without a category."""
    model = nb_train(post, labels.where(F.col(class_col).isNotNull()), id_col, class_col)
    unl = docs.join(labels.where(F.col(class_col).isNotNull()).select(id_col), id_col, "left_anti")
    return nb_classify(post, unl, model, id_col)


def confusion_matrix(pred: DataFrame, actual: DataFrame, categories, id_col: str = "doc_id",
                     class_col: str = "category") -> DataFrame:
    """C4: (actual, predicted, n) over a fixed category list, zero-filled;
    documents whose actual or predicted class is not listed are dropped.
    Actual labels are lower-cased to compare with analysed predictions."""
    cats = [c.lower() for c in categories]
    arr = F.array(*[F.lit(c) for c in cats])
    spark = pred.sparkSession
    grid = (spark.range(1).select(F.explode(arr).alias("actual"))
            .select("actual", F.explode(arr).alias("predicted")))
    pairs = (pred.select(F.col("doc_id").cast("long").alias("doc_id"), "predicted")
             .join(actual.select(F.col(id_col).cast("long").alias("doc_id"),
                                 F.lower(F.col(class_col).cast("string")).alias("actual")), "doc_id")
             .where(F.col("actual").isin(*cats) & F.col("predicted").isin(*cats)))
    counts = pairs.groupBy("actual", "predicted").agg(F.count(F.lit(1)).cast("long").alias("n"))
    return (grid.join(F.broadcast(counts), ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def accuracy_error(cm: DataFrame) -> DataFrame:
    """(total, correct, accuracy, error_rate); NULL rates when total = 0."""
    agg = cm.agg(F.sum("n").cast("long").alias("total"),
                 F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).cast("long").alias("correct"))
    return agg.select("total", "correct",
                      F.try_divide(F.col("correct").cast("double"), F.col("total")).alias("accuracy"),
                      F.try_divide((F.col("total") - F.col("correct")).cast("double"), F.col("total")).alias("error_rate"))
