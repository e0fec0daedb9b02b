"""Structured facts: retrieval, one value per year, and series over years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import calc
from factloom.functions.concepts import base_form
from factloom.operators.predicates import where


def query_facts(facts: DataFrame, companies: DataFrame, concepts: object, tickers: object = None, fiscal_years: object = None, fiscal_period: object = None, form: object = "10-K") -> DataFrame:
    """Facts of the concepts with their ticker; all periods of the matching rows, amendments included.

    Filters reach the scan of the facts; empty ones are no filter. Facts of unknown companies are left out.
    """
    wanted = where(facts.withColumn("base_form", base_form(F.col("form"))), canonical_concept=concepts, fiscal_year=fiscal_years, fiscal_period=fiscal_period, base_form=form)
    known = where(companies.select("cik", "ticker"), ticker=tickers)
    return wanted.join(known, "cik").select("ticker", "cik", "canonical_concept", "fiscal_year", "fiscal_period", "form", "period_start", "period_end", "value", "unit", "accession_number", "created_at", "id")


def comparison_table(rows: DataFrame, scale: float = 1e9, label: str = "value_bn") -> DataFrame:
    """Long comparison table: value and value / scale under ``label``."""
    return rows.select("ticker", "canonical_concept", "fiscal_year", "fiscal_period", F.col("value").cast("double").alias("value"), (F.col("value").cast("double") / scale).alias(label))


def annual_values(facts: DataFrame, concepts: Sequence[str]) -> DataFrame:
    """(cik, canonical_concept, fiscal_year, value): of the full-year facts the one with the latest
    period end, then the latest record, then the least id. Reduced before the shuffle."""
    newest = F.struct("period_end", "created_at", "id")
    full = facts.where(F.col("canonical_concept").isin(list(concepts)) & (F.col("fiscal_period") == "FY") & F.col("value").isNotNull() & (base_form(F.col("form")) == "10-K"))
    return full.groupBy("cik", "canonical_concept", "fiscal_year").agg(F.max_by("value", newest).cast("double").alias("value"))


def wide(values: DataFrame, concepts: Sequence[str], keys: Sequence[str] = ("cik", "fiscal_year")) -> DataFrame:
    """One column per concept, by conditional aggregation (no pivot pass over distinct values)."""
    return values.groupBy(*keys).agg(*[F.max(F.when(F.col("canonical_concept") == c, F.col("value"))).alias(c) for c in concepts])


def with_previous(values: DataFrame, entity: Sequence[str], year: str = "fiscal_year", value: str = "value") -> DataFrame:
    """Adds prev_value, the value of the year before; NULL where that very year is missing."""
    w = Window.partitionBy(*entity).orderBy(year)
    return values.withColumn("prev_value", F.when(F.lag(year).over(w) == F.col(year) - 1, F.lag(value).over(w)))


def growth(values: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Adds growth_pct over the year before; rows without one are kept with NULL."""
    return with_previous(values, entity).withColumn("growth_pct", F.round(calc.yoy_growth(F.col("value"), F.col("prev_value")), 6))


def compound_growth(values: DataFrame, entity: Sequence[str]) -> DataFrame:
    """start_value, end_value, years and cagr_pct between an entity's first and last year."""
    return (
        values.groupBy(*entity)
        .agg(
            F.min_by("value", "fiscal_year").alias("start_value"),
            F.max_by("value", "fiscal_year").alias("end_value"),
            (F.max("fiscal_year") - F.min("fiscal_year")).alias("years"),
        )
        .withColumn("cagr_pct", F.round(calc.cagr(F.col("start_value"), F.col("end_value"), F.col("years")), 6))
    )


def scaled_to_unit(values: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Each series between 0 and 1; a flat series is 0; series of a single point are left out."""
    w = Window.partitionBy(*entity)
    low, high = F.min("value").over(w), F.max("value").over(w)
    rows = values.withColumn("n_points", F.count("value").over(w))
    return rows.withColumn("scaled", F.round(F.coalesce((F.col("value") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)), 9)).where("n_points >= 2").drop("n_points")


def first_of_year(facts: DataFrame, tags: DataFrame) -> DataFrame:
    """(cik, canonical, fiscal_year, value, concept, period_end): the row with the earliest period end, within it the raw
    tag of the best priority, then the least id."""
    rows = facts.where("value IS NOT NULL").join(tags, "concept")
    first = F.struct("period_end", "priority", "id")
    return rows.groupBy("cik", "canonical", "fiscal_year").agg(
        F.min_by("value", first).cast("double").alias("value"), F.min_by("concept", first).alias("concept"), F.min_by("period_end", first).alias("period_end")
    )


def large_number(value: Column) -> Column:
    """Money in words: trillions and billions with two places, millions with one, smaller as is."""
    size = F.abs(value)
    scaled = lambda by, fmt: F.format_string(fmt, value / by)
    return F.when(size >= 1e12, scaled(1e12, "$%.2fT")).when(size >= 1e9, scaled(1e9, "$%.2fB")).when(size >= 1e6, scaled(1e6, "$%.1fM")).otherwise(F.format_string("$%.0f", value))
