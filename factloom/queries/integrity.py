"""Queries on broken references (p2) and reported periods (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.keys import accession_key, cik_key, uuid_key
from factloom.operators.intervals import continuous_periods, period_gaps
from factloom.operators.references import Child, Parent, orphan_counts, orphan_references
from factloom.sources.tables import table


def _references(spark: SparkSession, sf: str) -> tuple[list[Parent], list[Child], DataFrame]:
    facts, sections = table(spark, sf, "xbrl_facts"), table(spark, sf, "filing_sections")
    filings, companies = table(spark, sf, "filings"), table(spark, sf, "companies")
    removed = table(spark, sf, "deleted_keys")
    c = F.col
    fact_period = (c("fiscal_year"), c("fiscal_period"))
    parents = [
        Parent("accession_number", filings, accession_key(c("accession_number")), c("ingested_at")),
        Parent("filing_id", filings, uuid_key(c("id")), c("ingested_at"), fact_period),
        Parent("cik", companies, cik_key(c("cik")), c("created_at")),
    ]
    children = [
        Child("xbrl_facts", "accession_number", "accession_number", facts, c("id"), accession_key(c("accession_number")), c("created_at"), fact_period),
        Child("xbrl_facts", "cik", "cik", facts, c("id"), cik_key(c("cik")), c("created_at"), fact_period),
        Child("filing_sections", "filing_id", "filing_id", sections, c("id"), uuid_key(c("filing_id")), c("created_at"), None),
    ]
    field, value = c("key_field"), c("key_value")
    key = F.when(field == "accession_number", accession_key(value)).when(field == "cik", cik_key(value)).when(field == "filing_id", uuid_key(value))
    return parents, children, removed.select(field.alias("parent"), key.alias("key"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_references(*_references(spark, sf), periods=False)


def p2_orphans_by_period(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_counts(*_references(spark, sf))


_ENTITY = ("cik", "canonical_concept")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    gaps = period_gaps(table(spark, sf, "xbrl_facts"), _ENTITY, "period_start", "period_end")
    return gaps.select(*_ENTITY, F.date_format("gap_start", "yyyy-MM-dd").alias("gap_start"), F.date_format("gap_end", "yyyy-MM-dd").alias("gap_end"))


def p3_periods(spark: SparkSession, sf: str) -> DataFrame:
    return continuous_periods(table(spark, sf, "xbrl_facts"), _ENTITY, "period_start", "period_end")


_REFS = """
WITH refs AS (
  SELECT 'xbrl_facts' AS ref_table, 'accession_number' AS ref_field, id AS record_id, nullif(regexp_replace(accession_number, '[-\\s]', '', 'g'), '') AS k,
         created_at AS since, fiscal_year, fiscal_period FROM xbrl_facts
  UNION ALL SELECT 'xbrl_facts', 'cik', id, cast(cik AS VARCHAR), created_at, fiscal_year, fiscal_period FROM xbrl_facts
  UNION ALL SELECT 'filing_sections', 'filing_id', id, nullif(lower(trim(filing_id)), ''), created_at, NULL, NULL FROM filing_sections
), owners AS (
  SELECT ref_field, k, min(since) AS since, min(y) AS y, min(p) AS p FROM (
    SELECT 'accession_number' AS ref_field, nullif(regexp_replace(accession_number, '[-\\s]', '', 'g'), '') AS k, ingested_at AS since, NULL AS y, NULL AS p FROM filings
    UNION ALL SELECT 'filing_id', lower(trim(id)), ingested_at, fiscal_year, fiscal_period FROM filings
    UNION ALL SELECT 'cik', cast(cik AS VARCHAR), created_at, NULL, NULL FROM companies) GROUP BY 1, 2
), removed AS (
  SELECT DISTINCT key_field AS ref_field, CASE key_field WHEN 'accession_number' THEN regexp_replace(key_value, '[-\\s]', '', 'g')
    WHEN 'cik' THEN regexp_replace(trim(key_value), '^0+', '') ELSE lower(trim(key_value)) END AS k FROM deleted_keys
), cases AS (
  SELECT r.*, o.y, o.p, CASE WHEN o.k IS NULL THEN CASE WHEN d.k IS NULL THEN 'missing' ELSE 'deleted' END WHEN r.since < o.since THEN 'late' END AS ref_state
  FROM refs r LEFT JOIN owners o ON r.ref_field = o.ref_field AND r.k = o.k LEFT JOIN removed d ON r.ref_field = d.ref_field AND r.k = d.k
  WHERE r.k IS NOT NULL)
"""

_SPANS = """
WITH spans AS (SELECT cik, canonical_concept, period_start AS s, period_end AS e FROM xbrl_facts
  WHERE cik IS NOT NULL AND canonical_concept IS NOT NULL AND period_start <= period_end),
run AS (SELECT *, max(e) OVER (PARTITION BY cik, canonical_concept ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM spans)
"""

QUERIES = {
    "p2_found": p2_found,
    "p2_orphans_by_period": p2_orphans_by_period,
    "p3_found": p3_found,
    "p3_periods": p3_periods,
}

SQL = {
    "p2_found": _REFS + "SELECT ref_table, ref_field, record_id, ref_state FROM cases WHERE ref_state IS NOT NULL",
    "p2_orphans_by_period": _REFS
    + """SELECT ref_table, ref_field, cast(CASE WHEN ref_table = 'xbrl_facts' THEN fiscal_year ELSE y END AS INTEGER) AS fiscal_year,
         CASE WHEN ref_table = 'xbrl_facts' THEN fiscal_period ELSE p END AS fiscal_period, ref_state, count(*) AS n_records, count(DISTINCT k) AS n_keys
         FROM cases WHERE ref_state IS NOT NULL GROUP BY 1, 2, 3, 4, 5""",
    "p3_found": _SPANS
    + """SELECT cik, canonical_concept, strftime(covered + INTERVAL 1 DAY, '%Y-%m-%d') AS gap_start, strftime(s - INTERVAL 1 DAY, '%Y-%m-%d') AS gap_end
         FROM run WHERE s > covered + INTERVAL 1 DAY""",
    "p3_periods": _SPANS
    + """, numbered AS (SELECT *, sum(CASE WHEN covered IS NULL OR s > covered + INTERVAL 1 DAY THEN 1 ELSE 0 END)
           OVER (PARTITION BY cik, canonical_concept ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS period_no FROM run)
         SELECT cik, canonical_concept, cast(period_no AS INTEGER) AS period_no, min(s) AS period_start, max(e) AS period_end,
           count(*) AS n_spans, cast(date_diff('day', min(s), max(e)) + 1 AS INTEGER) AS n_days FROM numbered GROUP BY 1, 2, 3""",
}
