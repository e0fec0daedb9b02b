"""Overlapping and gapped time intervals: continuous periods and the gaps between them.

Spans are first reduced to one row per (entity, start day) with the latest end. A hot entity then
has at most one row for each day of the calendar, however many records it has, so the ordered
window over an entity is bounded by the calendar and not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _starts(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    cols = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    spans = df.select(*cols, F.col(start).cast("date").alias("_start"), F.col(end).cast("date").alias("_end"))
    for i in range(len(keys)):
        spans = spans.where(F.col(f"_k{i}").isNotNull())
    spans = spans.where(F.col("_start") <= F.col("_end"))
    names = [f"_k{i}" for i in range(len(keys))]
    return spans.groupBy(*names, "_start").agg(F.max("_end").alias("_end"), F.count(F.lit(1)).alias("_n"))


def _with_previous(df: DataFrame, keys: Sequence[str], start: str, end: str) -> tuple[DataFrame, list[str]]:
    names = [f"_k{i}" for i in range(len(keys))]
    before = Window.partitionBy(*names).orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    return _starts(df, keys, start, end).withColumn("_covered", F.max("_end").over(before)), names


def continuous_periods(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Merge overlapping, nested and adjoining spans per entity.

    Returns the keys, period_no (from 1), period_start, period_end, n_spans and n_days. Spans with a
    NULL day or key, or that end before they start, are no spans and are left out; both days belong
    to a span, so spans that meet on consecutive days are one period. An empty table gives no row.
    """
    rows, names = _with_previous(df, keys, start, end)
    upto = Window.partitionBy(*names).orderBy("_start").rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("_covered").isNull() | (F.col("_start") > F.date_add("_covered", 1))).cast("int")
    return (
        rows.withColumn("_opens", opens)
        .withColumn("period_no", F.sum("_opens").over(upto).cast("int"))
        .groupBy(*names, "period_no")
        .agg(F.min("_start").alias("period_start"), F.max("_end").alias("period_end"), F.sum("_n").alias("n_spans"))
        .withColumn("n_days", F.datediff("period_end", "period_start") + 1)
        .select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "period_no", "period_start", "period_end", "n_spans", "n_days")
    )


def period_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """The uncovered stretches between an entity's first and last covered day.

    Returns the keys, gap_start and gap_end (dates, both within the gap) and n_days. Spans are
    chosen as in :func:`continuous_periods`; an entity with one continuous period gives no row.
    """
    rows, names = _with_previous(df, keys, start, end)
    return (
        rows.where(F.col("_start") > F.date_add("_covered", 1))
        .select(
            *[F.col(n).alias(k) for n, k in zip(names, keys)],
            F.date_add("_covered", 1).alias("gap_start"),
            F.date_sub("_start", 1).alias("gap_end"),
        )
        .withColumn("n_days", F.datediff("gap_end", "gap_start") + 1)
    )
