"""Key spellings and row identities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def accession_key(col: Column) -> Column:
    """Accession number without hyphens and blanks; NULL for NULL and blank ones, which refer to nothing."""
    return F.nullif(F.translate(col, "- \t\n\u000b\f\r", ""), F.lit(""))


def cik_key(col: Column) -> Column:
    """Digits of a cik without leading zeros, as text; NULL for NULL and blank."""
    bare = F.regexp_replace(F.trim(col.cast("string")), "^0+(?=.)", "")
    return F.when(bare != "", bare)


def uuid_key(col: Column) -> Column:
    """UUID text in lower case without outer blanks; NULL for NULL and blank."""
    bare = F.lower(F.trim(col))
    return F.when(bare != "", bare)


def digest(*cols: Column) -> Column:
    """128 bits, as a struct of two longs, that stand for a tuple of values; NULL is a value of its own."""
    parts = [x for c in cols for x in (c, c.isNull())]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("h1"), F.xxhash64(F.lit(2), *parts).alias("h2"))


def age(col: Column, kind: str) -> Column:
    """Interval up to the end of the calendar: smaller is later. ``kind`` is the column's type name."""
    return F.lit("9999-12-31 23:59:59.999999").cast(kind) - col
