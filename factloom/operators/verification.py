"""Claims against the texts they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.keys import accession_key
from factloom.functions.numbers import extract_numbers, match_number
from factloom.operators.documents import slice_text
from factloom.operators.ingest import lookup_by_id_or_accession

TOLERANCE_PCT, SEMANTIC_THRESHOLD = 0.5, 0.55


def resolve_citations(citations: DataFrame, chunks: DataFrame, sections: DataFrame, filings: DataFrame) -> DataFrame:
    """Adds filing_id, cited_text and problem to citations of (ref, char_offset_start, char_offset_end).

    ``ref`` is a filing's id or its accession number in any spelling. At the filing's offsets, an exact chunk is taken first (of several
    the least text), else the slice of the filing's section that covers the offsets (the least of several). problem:
    ``filing_missing`` where no filing is meant or it has neither chunk nor section, ``offset_invalid`` where no section covers the
    offsets. ``citations`` must have a unique citation_id and no column filing_id.
    """
    place = ["filing_id", "char_offset_start", "char_offset_end"]
    meant = lookup_by_id_or_accession(citations, "ref", filings, accession_key(F.col("accession_number")))
    known = meant.join(chunks.groupBy(*place).agg(F.min("text").alias("_chunk")), place, "left")
    parts = sections.select("filing_id", F.col("char_offset_start").alias("_base"), F.col("text_md").alias("_body"))
    start, stop = F.col("char_offset_start") - F.col("_base"), F.col("char_offset_end") - F.col("_base")
    cut = slice_text(F.col("_body"), start, stop)
    sliced = known.where("_chunk IS NULL").select("citation_id", *place).join(parts, "filing_id").groupBy("citation_id").agg(F.min(cut).alias("_slice"), F.count(F.lit(1)).alias("_sections"))
    found = known.join(sliced, "citation_id", "left").withColumn("cited_text", F.coalesce("_chunk", "_slice"))
    problem = F.when(F.col("cited_text").isNotNull(), None).when(F.col("_sections").isNull(), "filing_missing").otherwise("offset_invalid")
    return found.withColumn("problem", problem).drop("_chunk", "_slice", "_sections")


def verdict(is_numeric: Column, value: Column, problem: Column, match: Column, similarity: Column, tolerance_pct: float = TOLERANCE_PCT, threshold: float = SEMANTIC_THRESHOLD) -> Column:
    """struct(verified, method, confidence, matched_value) of a claim against its cited text."""
    out = lambda ok, how, conf, v: F.struct(F.lit(ok).alias("verified"), how.alias("method"), conf.cast("double").alias("confidence"), v.cast("double").alias("matched_value"))
    none = F.lit(None)
    error = match["error_pct"]
    numeric = (
        F.when(value.isNull(), out(False, F.lit("no_numeric_value"), none, none))
        .when(match["matched"] & (error <= 1e-6), out(True, F.lit("numeric_exact"), F.lit(1.0), match["value"]))
        .when(match["matched"], out(True, F.lit("numeric_tolerance"), 1 - error / tolerance_pct, match["value"]))
        .otherwise(out(False, F.lit("numeric_mismatch"), none, match["value"]))
    )
    narrative = F.when(similarity >= threshold, out(True, F.lit("semantic_similarity"), similarity, none)).otherwise(out(False, F.lit("semantic_below_threshold"), similarity, none))
    return F.when(problem.isNotNull(), out(False, problem, none, none)).when(is_numeric, numeric).otherwise(narrative)


def verify_claims(claims: DataFrame, similarity: Column, tolerance_pct: float = TOLERANCE_PCT, threshold: float = SEMANTIC_THRESHOLD, values: Column | None = None) -> DataFrame:
    """Adds the verdict to claims with is_numeric, numeric_value, cited_text and problem.

    ``values``: the numbers of the cited text, if they are there already.
    """
    rows = claims.withColumn("_values", F.transform(extract_numbers("cited_text"), lambda n: n["value"]) if values is None else values)
    match = match_number(F.col("numeric_value"), F.col("_values"), tolerance_pct)
    rows = rows.withColumn("_match", match)
    v = verdict(F.col("is_numeric"), F.col("numeric_value"), F.col("problem"), F.col("_match"), similarity, tolerance_pct, threshold)
    return rows.withColumn("verdict", v).drop("_values", "_match")


def uncited_numeric(claims: Column) -> Column:
    """Texts of numeric claims without a citation, from an array of claim structs."""
    return F.transform(F.filter(claims, lambda c: c["is_numeric"] & (F.size(c["citations"]) == 0)), lambda c: c["text"])


def faithfulness(claims: Column) -> Column:
    """Share of numeric claims with a citation; 1.0 where no claim is numeric."""
    numeric = F.filter(claims, lambda c: c["is_numeric"])
    cited = F.filter(numeric, lambda c: F.size(c["citations"]) > 0)
    return F.when(F.size(numeric) == 0, 1.0).otherwise(F.size(cited) / F.size(numeric))


def gold_error(gold: Column, value: Column) -> Column:
    """Error of a value in percent of max(|gold|, 1)."""
    return F.abs(value - gold) / F.greatest(F.abs(gold), F.lit(1.0)) * 100


def numeric_accuracy(gold: Column, values: Column, tolerance_pct: float = 0.5) -> Column:
    """struct(matched, error_pct) of the numeric claims' values against a gold value.

    NULLs without a gold value; false without a value. Here the error is relative to max(|gold|, 1); a match
    reports the first value within the tolerance, a miss the closest.
    """
    errors = F.transform(values, lambda v: gold_error(gold, v))
    near = F.filter(errors, lambda e: e <= tolerance_pct)
    out = lambda ok, e: F.struct(ok.cast("boolean").alias("matched"), e.cast("double").alias("error_pct"))
    none = F.lit(None)
    return (
        F.when(gold.isNull(), out(none, none))
        .when(F.coalesce(F.size(values), F.lit(0)) <= 0, out(F.lit(False), none))
        .when(F.size(near) > 0, out(F.lit(True), F.get(near, F.lit(0))))
        .otherwise(out(F.lit(False), F.array_min(errors)))
    )
