"""Queries on landing, keys and repeatable writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.concepts import TAGS, base_form, tag_table
from factloom.functions.keys import accession_key
from factloom.operators import ingest as op
from factloom.operators.predicates import split_list
from factloom.sources.tables import table


def fiscal_period_inference(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "filings")
    year, period = op.fiscal_label(F.col("filed_date"), F.col("period_end"), F.col("form"))
    return f.select("id", year.alias("inferred_year"), period.alias("inferred_period"), (year == F.col("fiscal_year")).alias("same_year"))


def form_normalise(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "xbrl_facts")
    return f.groupBy(base_form(F.col("form")).alias("base_form"), F.col("form").endswith("/A").alias("amended")).agg(F.count(F.lit(1)).alias("n"))


def canonical_concepts(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "xbrl_facts")
    rows = f.join(tag_table(spark), "concept")
    return rows.groupBy("concept", "canonical").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("canonical") == F.col("canonical_concept")).alias("n_as_stored"))


def unmapped_concepts(spark: SparkSession, sf: str) -> DataFrame:
    """Raw tags that the tag table lacks, of the facts and, spelled in capitals as some filers do, once more."""
    facts = table(spark, sf, "xbrl_facts").select("concept")
    return op.unmapped_tags(facts.unionByName(facts.select(F.upper("concept").alias("concept"))), tag_table(spark))


def dedupe_insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """Filings ingested from 2016 on that an insert into those before would add; one per accession number."""
    f = table(spark, sf, "filings").select(accession_key(F.col("accession_number")).alias("accession"), "id", "form", "ingested_at")
    border = F.lit("2016-01-01").cast("timestamp_ntz")
    added = op.insert_ignore(f.where(F.col("ingested_at") < border), f.where(F.col("ingested_at") >= border), ["accession"], nulls_distinct=False)
    return added.select("accession", "id")


def facts_insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """Facts kept by the unique key of the fact table, per year; rows with a NULL in the key never conflict."""
    keys = ["cik", "canonical_concept", "period_start", "period_end", "form", "accession_number"]
    f = table(spark, sf, "xbrl_facts").select(*keys, "id", "fiscal_year")
    kept = op.insert_ignore(None, f, keys)
    return kept.groupBy("fiscal_year").agg(F.count(F.lit(1)).alias("n_kept"))


def missing_children_anti(spark: SparkSession, sf: str) -> DataFrame:
    f, s = table(spark, sf, "filings"), table(spark, sf, "filing_sections")
    return op.missing_children(f.select("id", "form", "fiscal_year"), "id", s, "filing_id").groupBy("form", "fiscal_year").agg(F.count(F.lit(1)).alias("n"))


def latest_version_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """Of each ticker, section, year and form the section filed last."""
    s = table(spark, sf, "filing_sections").select(F.col("id").alias("section_id"), "filing_id", F.upper(F.trim("section")).alias("section"))
    f = table(spark, sf, "filings").select(F.col("id").alias("filing_id"), "cik", "fiscal_year", base_form(F.col("form")).alias("form"), "filed_date")
    c = table(spark, sf, "companies").select("cik", "ticker")
    rows = s.join(f, "filing_id").join(c, "cik").select("ticker", "section", "fiscal_year", "form", "filed_date", "section_id")
    return op.latest_per_key(rows, ["ticker", "section", "fiscal_year", "form"], ["filed_date", "section_id"])


def existence_semi(spark: SparkSession, sf: str) -> DataFrame:
    f, x = table(spark, sf, "filings"), table(spark, sf, "xbrl_facts")
    known = x.select(accession_key(F.col("accession_number")).alias("k"))
    return f.withColumn("k", accession_key(F.col("accession_number"))).join(known, "k", "left_semi").groupBy("form").agg(F.count(F.lit(1)).alias("n"))


def ticker_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Section versions with the cik of their ticker, whatever its case."""
    v = table(spark, sf, "section_versions").select("version_id", F.upper(F.trim("ticker")).alias("ticker"))
    c = table(spark, sf, "companies").select(F.upper("ticker").alias("ticker"), "cik")
    return v.join(c, "ticker", "left")


def accession_or_id_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every second reference by id, the others by accession number; resolved to the filing."""
    v = table(spark, sf, "section_versions")
    refs = v.select("version_id", F.when(F.col("fiscal_year") % 2 == 0, F.col("filing_id")).otherwise(F.col("accession_number")).alias("ref"))
    f = table(spark, sf, "filings")
    return op.lookup_by_id_or_accession(refs, "ref", f, accession_key(F.col("accession_number"))).select("version_id", "filing_id")


def nested_json_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Facts written as nested JSON (taxonomy, tag, unit, entries) and read back as rows."""
    x = table(spark, sf, "xbrl_facts").where("concept IS NOT NULL AND unit IS NOT NULL AND value IS NOT NULL")
    entry = F.struct(F.date_format("period_end", "yyyy-MM-dd").alias("end"), F.date_format("period_start", "yyyy-MM-dd").alias("start"), F.col("value").alias("val"), F.col("accession_number").alias("accn"), F.col("fiscal_year").alias("fy"), F.col("fiscal_period").alias("fp"), F.col("form"))
    body = F.create_map(F.lit("us-gaap"), F.create_map(F.col("concept"), F.struct(F.create_map(F.col("unit"), F.array(entry)).alias("units"))))
    rows = op.flatten_facts(x.select("cik", F.to_json(body).alias("json")), "json", ["cik"], tag_table(spark))
    return rows.groupBy("cik", "canonical_concept", "unit", "form").agg(F.count(F.lit(1)).alias("n"), F.sum("val").cast("double").alias("total"), F.max("end").alias("last_end"))


def parallel_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Filings as pages of parallel arrays, one page per company and month, and back to rows."""
    f = table(spark, sf, "filings").where("form IN ('10-K', '10-Q', '10-K/A', '10-Q/A')")
    ordered = F.array_sort(F.collect_list(F.struct("id", "form", "filed_date", "period_end")))
    pages = f.groupBy("cik", F.trunc("filed_date", "month").alias("page")).agg(ordered.alias("rows")).select("cik", "page", *[F.col(f"rows.{c}").alias(c) for c in ("id", "form", "filed_date", "period_end")])
    rows = op.parallel_rows(pages, ["cik", "page"], ["id", "form", "filed_date", "period_end"])
    return rows.select("cik", "id", base_form(F.col("form")).alias("form"), "filed_date", F.coalesce("period_end", "filed_date").alias("period_end"))


def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """SHA-256 of each section's whole text."""
    s = table(spark, sf, "filing_sections")
    return s.select("id", op.content_hash(F.col("text_md")).alias("sha256"), F.length("text_md").alias("n_chars"))


def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic ids of chunks; doubled chunks share one."""
    c = table(spark, sf, "chunks")
    key = op.deterministic_id(F.col("filing_id"), F.col("section"), F.col("char_offset_start"), F.col("char_offset_end"), F.col("text"))
    return c.groupBy(key.alias("chunk_key")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))


def health_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts and missing parts of the store, one row per table."""
    count = lambda name, col: table(spark, sf, name).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(col).isNull()).alias("n_missing"))
    return count("filings", "fiscal_period").unionByName(count("xbrl_facts", "value")).unionByName(count("chunks", "token_count")).unionByName(count("filing_sections", "item_label"))


def universe_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Tickers that section versions name outside the universe, which is the companies with a known sector."""
    v = table(spark, sf, "section_versions").select("fiscal_year", F.explode(split_list(F.col("ticker"))).alias("ticker"))
    return v.join(table(spark, sf, "companies").where("sector IS NOT NULL").select(F.upper("ticker").alias("ticker")), "ticker", "left_anti").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        fiscal_period_inference, form_normalise, canonical_concepts, unmapped_concepts, dedupe_insert_ignore, facts_insert_ignore, missing_children_anti, latest_version_per_key,
        existence_semi, ticker_lookup, accession_or_id_lookup, nested_json_flatten, parallel_arrays, content_hashes, chunk_ids, health_counts, universe_guard,
    )
}

_TAGS = "tags(concept, canonical) AS (VALUES " + ", ".join(f"('{t}', '{c}')" for t, c, _ in TAGS) + ")"
_BASE = "upper(trim(regexp_replace(form, '(?i)/A\\s*$', '')))"
_ACC = "nullif(regexp_replace(accession_number, '[-\\s]', '', 'g'), '')"

SQL = {
    "fiscal_period_inference": f"""WITH f AS (SELECT *, {_BASE} AS base FROM filings), y AS (SELECT id, fiscal_year, cast(CASE WHEN base = '8-K' THEN year(filed_date) ELSE year(coalesce(period_end, filed_date)) END AS INTEGER) AS inferred_year,
      CASE WHEN base = '10-Q' THEN 'Q' || quarter(coalesce(period_end, filed_date)) ELSE 'FY' END AS inferred_period FROM f) SELECT id, inferred_year, inferred_period, inferred_year = fiscal_year AS same_year FROM y""",
    "form_normalise": f"SELECT {_BASE} AS base_form, form LIKE '%/A' AS amended, count(*) AS n FROM xbrl_facts GROUP BY 1, 2",
    "canonical_concepts": f"WITH {_TAGS} SELECT concept, canonical, count(*) AS n, count(*) FILTER (canonical = canonical_concept) AS n_as_stored FROM xbrl_facts JOIN tags USING (concept) GROUP BY 1, 2",
    "unmapped_concepts": f"""WITH {_TAGS}, x AS (SELECT concept FROM xbrl_facts UNION ALL SELECT upper(concept) FROM xbrl_facts)
      SELECT concept, count(*) AS n FROM x WHERE concept IS NOT NULL AND concept NOT IN (SELECT concept FROM tags) GROUP BY 1""",
    "dedupe_insert_ignore": f"""WITH f AS (SELECT {_ACC} AS accession, id, form, ingested_at FROM filings), new AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY id) AS r FROM f WHERE ingested_at >= TIMESTAMP '2016-01-01')
      SELECT accession, id FROM new WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM f o WHERE o.ingested_at < TIMESTAMP '2016-01-01' AND o.accession IS NOT DISTINCT FROM new.accession)""",
    "facts_insert_ignore": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY cik, canonical_concept, period_start, period_end, form, accession_number ORDER BY id) AS r,
      cik IS NULL OR canonical_concept IS NULL OR period_start IS NULL OR period_end IS NULL OR form IS NULL OR accession_number IS NULL AS free FROM xbrl_facts)
      SELECT fiscal_year, count(*) AS n_kept FROM k WHERE free OR r = 1 GROUP BY 1""",
    "missing_children_anti": "SELECT form, fiscal_year, count(*) AS n FROM filings f WHERE NOT EXISTS (SELECT 1 FROM filing_sections s WHERE s.filing_id = f.id) GROUP BY 1, 2",
    "latest_version_per_key": f"""SELECT ticker, upper(trim(section)) AS section, fiscal_year, {_BASE} AS form, filed_date, s.id AS section_id FROM filing_sections s JOIN filings f ON f.id = s.filing_id JOIN companies c ON c.cik = f.cik
      QUALIFY row_number() OVER (PARTITION BY ticker, upper(trim(section)), fiscal_year, {_BASE} ORDER BY filed_date DESC, s.id DESC) = 1""",
    "existence_semi": f"SELECT form, count(*) AS n FROM filings WHERE {_ACC} IN (SELECT {_ACC} FROM xbrl_facts WHERE {_ACC} IS NOT NULL) GROUP BY 1",
    "ticker_lookup": "SELECT version_id, upper(trim(v.ticker)) AS ticker, cik FROM section_versions v LEFT JOIN companies c ON upper(c.ticker) = upper(trim(v.ticker))",
    "accession_or_id_lookup": f"""WITH r AS (SELECT version_id, CASE WHEN fiscal_year % 2 = 0 THEN filing_id ELSE accession_number END AS ref FROM section_versions),
      s AS (SELECT *, regexp_matches(lower(ref), '^[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}$') AS shaped FROM r),
      a AS (SELECT {_ACC} AS k, min(id) AS id FROM filings GROUP BY 1)
      SELECT version_id, CASE WHEN shaped THEN f.id ELSE a.id END AS filing_id FROM s LEFT JOIN filings f ON shaped AND f.id = lower(ref) LEFT JOIN a ON NOT shaped AND a.k = regexp_replace(ref, '[-\\s]', '', 'g')""",
    "nested_json_flatten": f"""WITH {_TAGS} SELECT cik, canonical AS canonical_concept, unit, {_BASE} AS form, count(*) AS n, cast(sum(value) AS DOUBLE) AS total, strftime(max(period_end), '%Y-%m-%d') AS last_end
      FROM xbrl_facts JOIN tags USING (concept) WHERE unit IN ('USD', 'shares', 'USD/shares') AND value IS NOT NULL AND {_BASE} IN ('10-K', '10-Q') GROUP BY 1, 2, 3, 4""",
    "parallel_arrays": f"SELECT cik, id, {_BASE} AS form, filed_date, coalesce(period_end, filed_date) AS period_end FROM filings WHERE form IN ('10-K', '10-Q', '10-K/A', '10-Q/A')",
    "content_hashes": "SELECT id, sha256(text_md) AS sha256, cast(length(text_md) AS INTEGER) AS n_chars FROM filing_sections",
    "chunk_ids": """SELECT sha256(concat_ws('|', coalesce(filing_id, chr(0)), coalesce(section, chr(0)), coalesce(char_offset_start::VARCHAR, chr(0)), coalesce(char_offset_end::VARCHAR, chr(0)), coalesce(text, chr(0)))) AS chunk_key,
      count(*) AS n, min(id) AS id FROM chunks GROUP BY 1""",
    "health_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_missing FROM {t}"
        for t, c in (("filings", "fiscal_period"), ("xbrl_facts", "value"), ("chunks", "token_count"), ("filing_sections", "item_label"))
    ),
    "universe_guard": "SELECT upper(trim(ticker)) AS ticker, count(*) AS n FROM section_versions WHERE upper(trim(ticker)) <> '' AND upper(trim(ticker)) NOT IN (SELECT upper(ticker) FROM companies WHERE sector IS NOT NULL) GROUP BY 1",
}
