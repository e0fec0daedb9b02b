"""Landing nested and parallel-array records as rows, and writes that can be repeated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.concepts import base_form

ENTRY = "end string, start string, val decimal(28,4), accn string, fy int, fp string, form string, filed string"
FACTS_JSON = f"map<string, map<string, struct<units: map<string, array<struct<{', '.join(p.replace(' ', ': ', 1) for p in ENTRY.split(', ') if '(' not in p)}, val: decimal(28,4)>>>>>>"
# What is read from nested facts.
TAXONOMIES, UNITS, FORMS = ("us-gaap",), ("USD", "shares", "USD/shares"), ("10-K", "10-Q")


def parallel_rows(df: DataFrame, keys: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """One row per place of parallel arrays; the shortest array decides how many."""
    n = F.least(*[F.size(a) for a in arrays]) if len(arrays) > 1 else F.size(arrays[0])
    cut = [F.slice(a, F.lit(1), n).alias(a) for a in arrays]
    rows = df.where(n > 0).select(*keys, F.explode(F.arrays_zip(*cut)).alias("_row"))
    return rows.select(*keys, *[F.col(f"_row.{a}").alias(a) for a in arrays])


def concat_pages(pages: Sequence[DataFrame]) -> DataFrame:
    """Pages of one listing as one table; columns a page lacks are NULL."""
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def fiscal_label(filed: Column, period_end: Column, form: Column) -> tuple[Column, Column]:
    """(fiscal year, period): annual reports FY of the period's year, quarterly ones the calendar
    quarter of its end, current reports FY of the filing's year."""
    base = base_form(form)
    year = F.when(base == "8-K", F.year(filed)).otherwise(F.year(F.coalesce(period_end, filed)))
    period = F.when(base == "10-Q", F.concat(F.lit("Q"), F.quarter(F.coalesce(period_end, filed)).cast("string"))).otherwise("FY")
    return year, period


def parsed_date(text: Column) -> Column:
    """A date, 0001-01-01 for an empty text, NULL for what is none."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit("0001-01-01").cast("date")).otherwise(F.try_to_date(F.trim(text), "yyyy-MM-dd"))


def primary_document(docs: Column, form: Column) -> Column:
    """Name of the first HTML document of the form's type, else the first HTML document, else NULL.

    ``docs`` is an array of structs with name and type.
    """
    html = F.filter(docs, lambda d: F.lower(d["name"]).rlike(r"\.html?$"))
    typed = F.filter(html, lambda d: d["type"] == form)
    return F.coalesce(F.get(typed, F.lit(0)), F.get(html, F.lit(0)))["name"]


def flatten_facts(df: DataFrame, json: str, keys: Sequence[str], tags: DataFrame, years: Sequence[int] = ()) -> DataFrame:
    """Rows of nested facts: taxonomy -> tag -> units -> entries.

    Keeps the accepted taxonomies, units and forms and, if any are given, fiscal years; tags without a canonical concept are
    left out (see :func:`unmapped_tags`). Text that is no such JSON gives no row.
    """
    rows = (
        df.select(*keys, F.explode(F.from_json(json, FACTS_JSON)).alias("taxonomy", "concepts"))
        .where(F.col("taxonomy").isin(*TAXONOMIES))
        .select(*keys, F.explode("concepts").alias("concept", "body"))
        .select(*keys, "concept", F.explode("body.units").alias("unit", "entries"))
        .where(F.col("unit").isin(*UNITS))
        .select(*keys, "concept", "unit", F.inline("entries"))
        .withColumn("form", base_form(F.col("form")))
        .where(F.col("form").isin(*FORMS))
    )
    if years:
        rows = rows.where(F.col("fy").isin(*years))
    return rows.join(tags.select("concept", F.col("canonical").alias("canonical_concept")), "concept")


def unmapped_tags(facts: DataFrame, tags: DataFrame) -> DataFrame:
    """(concept, n): raw tags without a canonical concept."""
    return facts.where("concept IS NOT NULL").join(tags, "concept", "left_anti").groupBy("concept").agg(F.count(F.lit(1)).alias("n"))


def insert_ignore(target: DataFrame | None, incoming: DataFrame, keys: Sequence[str], nulls_distinct: bool = True) -> DataFrame:
    """Rows of ``incoming`` that an insert which ignores conflicts would add to ``target`` (None: an empty table).

    With ``nulls_distinct`` a row with a NULL key never conflicts, neither with the target nor within the
    batch. Of incoming rows with one key the least by all its columns is taken.
    """
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    bound = incoming.where(~some_null) if nulls_distinct else incoming
    row = F.struct(*incoming.columns)
    first = bound.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).agg(F.min(row).alias("_row")).select("_row.*")
    if target is None:
        return first.unionByName(incoming.where(some_null)) if nulls_distinct else first
    t = target.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (F.col(k).eqNullSafe(F.col(f"_t{i}")))
    added = first.join(t, same, "left_anti")
    return added.unionByName(incoming.where(some_null)) if nulls_distinct else added


def deterministic_id(*cols: Column) -> Column:
    """A stable id from the given values, so that a repeated run writes the same rows."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols]), 256)


def content_hash(col: Column) -> Column:
    """SHA-256 of the content."""
    return F.sha2(col.cast(T.BinaryType()), 256)


def missing_children(parents: DataFrame, key: str, children: DataFrame, foreign: str) -> DataFrame:
    """Parents without a child."""
    return parents.join(children.select(F.col(foreign).alias(key)), key, "left_anti")


def latest_per_key(df: DataFrame, keys: Sequence[str], latest: Sequence[str]) -> DataFrame:
    """The row with the greatest ``latest`` columns per key, reduced before the shuffle."""
    row = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*latest)).alias("_row")).select(*keys, "_row.*")


def lookup_by_id_or_accession(refs: DataFrame, ref: str, filings: DataFrame, accession: Column) -> DataFrame:
    """Adds filing_id: by id where the reference is shaped like one, else by accession number.

    Two equality joins, never one with OR; of filings that share an accession number the least id.
    """
    shaped = F.lower(F.col(ref)).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    keyed = refs.withColumn("_id", F.when(shaped, F.lower(ref))).withColumn("_acc", F.when(~shaped, F.regexp_replace(ref, r"[-\s]", "")))
    by_id = filings.select(F.col("id").alias("_id"), F.col("id").alias("_by_id")).distinct()
    by_acc = filings.groupBy(accession.alias("_acc")).agg(F.min("id").alias("_by_acc")).where("_acc IS NOT NULL")
    return keyed.join(by_id, "_id", "left").join(by_acc, "_acc", "left").withColumn("filing_id", F.coalesce("_by_id", "_by_acc")).drop("_id", "_acc", "_by_id", "_by_acc")
