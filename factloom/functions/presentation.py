"""How answers are shown, as Column expressions over claim arrays and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_citations(claims: Column) -> Column:
    """The citations of numeric claims, once each, in order."""
    return F.array_distinct(F.flatten(F.transform(F.filter(claims, lambda c: c["is_numeric"]), lambda c: c["citations"])))


def cited_lines(claims: Column) -> Column:
    """Numbered lines ``[claim.citation] text`` of the cited numeric claims."""
    cited = F.filter(claims, lambda c: c["is_numeric"] & (F.size(c["citations"]) > 0))
    lines = F.flatten(
        F.transform(
            cited,
            lambda c, i: F.transform(c["citations"], lambda x, j: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("."), (j + 1).cast("string"), F.lit("] "), x.cast("string"))),
        )
    )
    return F.array_join(lines, "\n")


def table_cells(table: Column) -> Column:
    """A pipe table as an array of rows of trimmed cells, without separator rows, each padded or cut to the first row's width."""
    rows = F.filter(F.split(F.trim(table), "\n"), lambda r: F.contains(r, F.lit("|")) & ~r.rlike(r"^[|:\-\s]+$"))
    cells = F.transform(rows, lambda r: F.transform(F.filter(F.split(r, r"\|"), lambda c: c != ""), lambda c: F.trim(c)))
    width = F.size(F.get(cells, F.lit(0)))
    return F.transform(cells, lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width))


def first_of(items: Column, most: int) -> Column:
    """The first ``most`` items of an array."""
    return F.slice(items, 1, most)
