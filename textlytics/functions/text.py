"""Text analysis as column expressions (T1, T2): no UDFs, all JVM-side.

The analyser is: word-break with one regular expression, lower-case, drop
English stop words, drop tokens longer than ``max_token_length``.  Every
operator goes through :func:`analyze`, so one change of pattern or stop list
applies everywhere (the pluggable-analyser hook of the original tool).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: must equal the original analyser for equal results -------
# Word pattern (Unicode letters, digits, underscore; inner ' ’ . : joiners).
TOKEN_PATTERN = r"[\p{L}\p{N}_]+(?:['’.:][\p{L}\p{N}_]+)*"
# The 33 English stop words of the standard analyser.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will",
    "with",
)
# Longest token the standard tokenizer emits.
MAX_TOKEN_LENGTH = 255
# ---------------------------------------------------------------------------


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def raw_tokens(text: Column | str, pattern: str = TOKEN_PATTERN) -> Column:
    """Lower-cased word tokens *before* stop-word removal (NULL text → [])."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(pattern), 0)


def keep_token(tok: Column, stop: Iterable[str] = STOP_WORDS,
               max_len: int = MAX_TOKEN_LENGTH) -> Column:
    stop = tuple(stop)
    cond = F.length(tok) <= F.lit(max_len)
    if stop:
        cond = cond & ~tok.isin(*stop)
    return cond


def analyze(text: Column | str, pattern: str = TOKEN_PATTERN,
            stop: Iterable[str] = STOP_WORDS, max_len: int = MAX_TOKEN_LENGTH) -> Column:
    """Text → array<string> of terms, in text order, with repeats."""
    stop = tuple(stop)
    return F.filter(raw_tokens(text, pattern), lambda t: keep_token(t, stop, max_len))


def term_counts(terms: Column | str) -> Column:
    """array<struct<term, tf>>: the distinct elements of an array, sorted, with the times that they occur.

    The array is sorted and its runs are measured, from where each begins to where the next does.  What
    several places need is bound once, as the one element of an array."""
    def once(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def runs(ordered: Column) -> Column:
        begins = F.filter(F.transform(ordered, lambda t, i: F.when((i == 0) | (t != F.get(ordered, i - 1)), i)), lambda i: i.isNotNull())
        return once(begins, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(ordered, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).cast("long").alias("tf"))))

    return once(F.sort_array(_c(terms)), runs)


def ticket_text(text: Column | str) -> Column:
    """The ticket text that keyword reports match and display: the whole text
    (NULL → ''), never a prefix of it."""
    return F.coalesce(_c(text), F.lit(""))


def length_norm(n: Column | str, quantized: bool = True) -> Column:
    """Length norm of a field with ``n`` terms: 1/sqrt(n), kept to 3 significant
    bits like the one-byte norm of the original index (value decoded back)."""
    r = F.lit(1.0) / F.sqrt(_c(n).cast("double"))
    if not quantized:
        return r
    p = F.pow(F.lit(2.0), F.floor(F.log2(r)) - F.lit(2))
    return F.floor(r / p) * p


def idf(df: Column | str, n_docs: Column | str) -> Column:
    """Classic idf: 1 + ln(N / (df + 1))."""
    return F.lit(1.0) + F.log(_c(n_docs).cast("double") / (_c(df).cast("double") + F.lit(1.0)))


def tf_weight(tf: Column | str) -> Column:
    """Classic tf weight: sqrt(tf)."""
    return F.sqrt(_c(tf).cast("double"))
