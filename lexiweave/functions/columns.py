"""The text primitives as columns: built-in functions wherever these can say it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from . import text as T


def utf16_length(c) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def first_code_point(c) -> Column:
    """First code point; 0 for an empty text."""
    return F.ascii(c)


def char_count(point) -> Column:
    """UTF-16 code units of a code point."""
    return F.when(F.col(point) > 0xFFFF, 2).otherwise(1)


def ids_arity(point) -> Column:
    """Operands of a description operator's code point."""
    p = F.col(point)
    return F.when(p.isin(0x2FF2, 0x2FF3), 3).when(p.isin(0x2FFE, 0x2FFF), 1).when(p.between(T.IDS_FIRST, T.IDS_LAST), 2).otherwise(0)


def has_ids(c) -> Column:
    """Whether a text holds a description operator at all."""
    return F.rlike(c, F.lit("[⿰-⿿]"))


def is_well_formed(c) -> Column:
    """Whether binary is well-formed UTF-8."""
    return F.is_valid_utf8(F.col(c).cast("string"))


@F.pandas_udf(IntegerType())
def ids_length(texts: pd.Series) -> pd.Series:
    """Code points of the complete description sequence a text begins with, or 0."""
    return texts.map(lambda t: None if t is None else T.ids_length(t))


@F.pandas_udf(StringType())
def fnv1a64(data: pd.Series) -> pd.Series:
    """FNV-1a 64 of binary as sixteen hexadecimal digits."""
    return data.map(lambda b: None if b is None else T.hex64(T.fnv1a64(bytes(b))))


@F.pandas_udf(StringType())
def decode_lenient(data: pd.Series) -> pd.Series:
    """Binary as text, one U+FFFD per malformed byte."""
    return data.map(lambda b: None if b is None else T.decode_lenient(bytes(b)))


@F.pandas_udf(StringType())
def escape(texts: pd.Series) -> pd.Series:
    """Text on one printable line."""
    return texts.map(lambda t: None if t is None else T.escape(t))
