"""Filters that are left out of the plan when they are not asked for."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.calc import all_of


def any_of(col: Column, wanted: object) -> Column | None:
    """Membership in a list; a scalar counts as a list of one, an empty list or None as no filter."""
    if wanted is None:
        return None
    values = [wanted] if isinstance(wanted, (str, int)) else list(wanted)  # type: ignore[call-overload]
    return col.isin(values) if values else None


def where(df: DataFrame, push_section: bool = True, **filters: object) -> DataFrame:
    """Keep rows whose columns match all given filters. ``push_section=False`` ignores a section filter."""
    active = [any_of(F.col(name), wanted) for name, wanted in filters.items() if push_section or name != "section"]
    return df.where(all_of([c for c in active if c is not None]))


def unknown_values(requested: Iterable, allowed: Iterable) -> list:
    """Requested values that are not allowed, in order and once each."""
    known = set(allowed)
    return [x for x in dict.fromkeys(requested) if x not in known]


def split_list(col: Column) -> Column:
    """Comma separated text as an array of trimmed, upper-case, non-empty parts."""
    return F.filter(F.transform(F.split(col, ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")
