"""Scalar column functions (P7, P8, P10–P12).  All built-ins, codegen'd."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed value: date text format of the original tool
DATE_FORMAT = "MM-dd-yyyy"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalise_cell(col: Column | str, dtype: T.DataType) -> Column:
    """Any cell → its text: dates (and timestamps) as MM-dd-yyyy, numbers
    and strings as their text, booleans as true/false, NULL → ''."""
    c = _c(col)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        s = F.date_format(c, DATE_FORMAT)
    elif isinstance(dtype, T.BooleanType):
        s = F.when(c, F.lit("true")).when(~c, F.lit("false"))
    elif isinstance(dtype, (T.StringType, T.NumericType)):
        s = c.cast("string")
    else:  # nested or binary values have no cell text
        s = F.lit(None).cast("string")
    return F.coalesce(s, F.lit(""))


def normalise_cells(df: DataFrame) -> DataFrame:
    """P7 over a whole table: every column to its cell text."""
    return df.select([normalise_cell(f.name, f.dataType).alias(f.name) for f in df.schema.fields])


def lowercase_values(col: Column | str) -> Column:
    """P8."""
    return F.lower(_c(col))


def decode_url(col: Column | str) -> Column:
    """P10: URL-decode (UTF-8); malformed input → NULL."""
    return F.try_url_decode(_c(col))


def parse_date(col: Column | str, fmt: str = DATE_FORMAT) -> Column:
    """MM-dd-yyyy text → date; text that does not parse → NULL."""
    return F.to_date(F.try_to_timestamp(_c(col), F.lit(fmt)))


def format_date(col: Column | str, fmt: str = DATE_FORMAT) -> Column:
    """Date → MM-dd-yyyy text."""
    return F.date_format(_c(col), fmt)
