"""Numbers in texts, and matching a number against a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a suffix multiplies by. There is no word boundary after a suffix: "3 Tesla" is three trillion.
MULTIPLIERS = {"trillion": 1e12, "tn": 1e12, "t": 1e12, "billion": 1e9, "bn": 1e9, "b": 1e9, "million": 1e6, "mn": 1e6, "m": 1e6, "thousand": 1e3, "k": 1e3}
# The spelling of numbers and of suffixes.
DIGITS = r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?|\.[0-9]+"
SUFFIX = "billion|million|thousand|trillion|bn|mn|tn|b|m|k|t|%"
_BLANK = r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]*"
#: The first group is a number in accounting brackets, opened within the five characters before it and closed right after it.
_NUMBER = rf"(?is)(?:(?<=\(.{{0,4}})({DIGITS})\)|(?:{DIGITS})\)?){_BLANK}(?:{SUFFIX})?"


def extract_numbers(text: Column | str) -> Column:
    """array<struct(raw, value, is_percent, is_negative)> of a text's numbers in order, on the JVM; empty for a NULL text.

    A number in accounting brackets is negative. A suffix scales its number, but percentages are not scaled.
    """
    col = F.col(text) if isinstance(text, str) else text
    found = lambda group: F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(_NUMBER), F.lit(group))
    scale = F.create_map(*[x for k, v in MULTIPLIERS.items() for x in (F.lit(k), F.lit(v))])

    def number(pair: Column) -> Column:
        raw, negative = pair["raw"], pair["bracketed"] != ""
        digits = F.regexp_replace(F.regexp_extract(raw, rf"^({DIGITS})", 1), ",", "").cast("double")
        suffix = F.lower(F.regexp_extract(raw, rf"(?i)({SUFFIX})$", 1))
        size = digits * F.coalesce(F.try_element_at(scale, suffix), F.lit(1.0))
        trimmed = F.regexp_replace(raw, rf"{_BLANK}$", "")
        return F.struct(trimmed.alias("raw"), F.when(negative, -size).otherwise(size).alias("value"), (suffix == "%").alias("is_percent"), negative.alias("is_negative"))

    # Zipped, for within the lambda the second array would be found anew for each number.
    return F.transform(F.arrays_zip(found(0).alias("raw"), found(1).alias("bracketed")), number)


def unsigned_values(text: Column) -> Column:
    """The absolute values of a text's numbers."""
    return F.transform(extract_numbers(text), lambda n: F.abs(n["value"]))


def match_number(target: Column, values: Column, tolerance_pct: float = 0.5) -> Column:
    """struct(matched, value, error_pct): the first value within the tolerance of the target, else the closest.

    The error is relative to the target's size, in percent; a target of zero needs a value below 1e-6. NULL value and
    error where the text has no number (or, for a zero target, no zero).
    """
    size = F.abs(target)
    err = lambda v: F.abs(v - target) / size * 100
    near = F.filter(values, lambda v: err(v) <= tolerance_pct)
    tried = F.transform(values, lambda v, i: F.struct(err(v).alias("error_pct"), i.alias("i"), v.alias("value")))
    closest = F.array_min(tried)
    zeros = F.filter(values, lambda v: F.abs(v) < 1e-6)
    result = lambda ok, v, e: F.struct(ok.alias("matched"), v.cast("double").alias("value"), e.cast("double").alias("error_pct"))
    none = F.lit(None)
    zero_case = F.when(F.size(zeros) > 0, result(F.lit(True), F.get(zeros, F.lit(0)), F.lit(0.0))).otherwise(result(F.lit(False), none, none))
    first = F.get(near, F.lit(0))
    other = F.when(F.size(near) > 0, result(F.lit(True), first, err(first))).otherwise(result(F.lit(False), closest["value"], closest["error_pct"]))
    return F.when(target == 0, zero_case).otherwise(other)
