"""Queries that run as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.keys import accession_key
from factloom.sources.tables import table
from factloom.streaming import events as st


def events_micro_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts by type, computed by a stream."""
    stream = st.windowed_counts(st.table_stream(spark, sf, "events"), "ts", ["event_type"])
    return st.run_complete(stream, "events").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def incremental_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Filings ingested file by file, one row per accession number."""
    filings = st.table_stream(spark, sf, "filings", files_per_trigger=4)
    keyed = filings.select(accession_key(F.col("accession_number")).alias("accession"), "id", "cik", "form")
    return st.ingested(keyed, ["accession"], "filings").select("accession", "cik")


def event_stream_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as typed event lines and parsed back: per user, what comes before the first error."""
    kinds = {"view": "tool_call", "click": "tool_result", "signup": "plan", "purchase": "synthesis", "error": "error"}
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type"))
    e = table(spark, sf, "events")
    line = st.event_line(kind, F.create_map(F.lit("value"), F.col("value").cast("string")), F.col("user_id").cast("string"), F.lit(0), F.col("event_id").cast("double"))
    parsed = st.parse_event_lines(e.select(F.trim(line, F.lit("\n")).alias("value")))
    return st.until_done(parsed).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").cast("long").alias("last_event"))


QUERIES = {f.__name__: f for f in (events_micro_batch, incremental_ingest, event_stream_lines)}

SQL = {
    "events_micro_batch": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, cast(sum(cast(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
    "incremental_ingest": "SELECT regexp_replace(accession_number, '[-\\s]', '', 'g') AS accession, arg_min(cik, id) AS cik FROM filings GROUP BY 1",
    "event_stream_lines": """WITH f AS (SELECT user_id, min(event_id) AS last FROM events WHERE event_type = 'error' GROUP BY 1)
      SELECT cast(user_id AS VARCHAR) AS trace_id, count(*) AS n, max(event_id) AS last_event FROM events LEFT JOIN f USING (user_id) WHERE last IS NULL OR event_id <= last GROUP BY 1""",
}
