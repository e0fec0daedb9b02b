"""Queries on long documents and question texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import diffs, documents
from factloom.sources.tables import table

# Patterns of comparing questions, and of questions after one fact.
COMPARING = (
    r"\bcompare\b", r"\bdifference\b", r"\bversus\b|\bvs\.?\b", r"\bbetween\b", r"\bwhich\b.*\b(?:grew|grow|fastest|highest|lowest)\b",
    r"\bover\s+(?:the\s+)?(?:past|last)\s+\d+\s+years?\b", r"\bcagr\b|\bcompound\b", r"\bgrowth\b",
)
SINGLE_FACT = (r"\bwhat\s+was\b", r"\bhow\s+much\s+did\b", r"\breport(?:ed)?\b")


def named_tickers(questions: DataFrame, question: str, companies: DataFrame) -> DataFrame:
    """Adds n_tickers: how many tickers of the universe a question names, as whole words in capitals."""
    words = F.array_distinct(F.regexp_extract_all(F.col(question), F.lit(r"\b([A-Z][A-Z0-9.\-]*)\b"), F.lit(1)))
    asked = questions.select(F.xxhash64(question).alias("_q"), F.explode(words).alias("ticker")).distinct()
    known = companies.select("ticker").where("ticker IS NOT NULL").distinct()
    counts = asked.join(known, "ticker").groupBy("_q").agg(F.count(F.lit(1)).alias("n_tickers"))
    return questions.withColumn("_q", F.xxhash64(question)).join(counts, "_q", "left").drop("_q").fillna(0, ["n_tickers"])


def looks_like_single_fact(question: Column, n_tickers: Column) -> Column:
    """A short question after one fact of one company that compares nothing."""
    q = F.lower(question)
    any_of = lambda patterns: F.rlike(q, F.lit("|".join(f"(?:{p})" for p in patterns)))
    short = F.size(F.split(F.trim(q), r"\s+")) < 16
    return F.coalesce(~any_of(COMPARING) & any_of(SINGLE_FACT) & short & (n_tickers <= 1), F.lit(False))


def question_tier(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation items, and the same questions with two companies' tickers in front."""
    items, companies = table(spark, sf, "eval_items").select("item_id", "question"), table(spark, sf, "companies").select("ticker")
    two = companies.agg(F.concat_ws(" ", F.min("ticker"), F.max("ticker")).alias("two"))
    both = items.select("item_id", F.lit(False).alias("two_named"), "question").unionByName(items.join(two).select("item_id", F.lit(True).alias("two_named"), F.concat_ws(" ", "two", "question").alias("question")))
    return named_tickers(both, "question", companies).select("item_id", "two_named", looks_like_single_fact(F.col("question"), F.col("n_tickers")).alias("single_fact"))


def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "filing_sections").where("raw_html IS NOT NULL")
    return s.select("id", documents.html_to_text("raw_html").alias("text"))


def _full_texts(spark: SparkSession, sf: str) -> DataFrame:
    """A filing's full text: a header line and the text of each section, in order of their offsets.

    A filing has a few dozen items by form, so gathering them per filing is bounded.
    """
    s = table(spark, sf, "filing_sections")
    part = F.struct("char_offset_start", "id", F.concat(F.lit("Item "), F.upper(F.regexp_replace(F.col("section"), r"(?i)^[^0-9]*", "")), F.lit(". "), F.coalesce("item_label", F.lit("")), F.lit("\n"), F.coalesce("text_md", F.lit(""))).alias("body"))
    parts = F.transform(F.array_sort(F.collect_list(part)), lambda x: x["body"])
    full = s.groupBy("filing_id").agg(F.array_join(parts, "\n").alias("full_text"))
    return full.join(table(spark, sf, "filings").select(F.col("id").alias("filing_id"), "form"), "filing_id")


def section_detect(spark: SparkSession, sf: str) -> DataFrame:
    return documents.detect_sections(_full_texts(spark, sf), "filing_id", "full_text", "form")


def chunk_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return documents.chunk_sections(table(spark, sf, "filing_sections"), "id", "text_md")


def chunk_offsets_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Stored chunks against the section they were cut from: whether the slice at their offsets is their text."""
    c = table(spark, sf, "chunks").select("id", "filing_id", F.col("char_offset_start").alias("a"), F.col("char_offset_end").alias("b"), F.col("text").alias("chunk_text"))
    s = table(spark, sf, "filing_sections").select("filing_id", F.col("char_offset_start").alias("base"), "text_md", F.col("id").alias("section_id"))
    found = c.join(s, "filing_id").where((F.col("a") >= F.col("base")) & (F.col("a") < F.col("base") + F.length("text_md")))
    cut = documents.slice_text(F.col("text_md"), F.col("a") - F.col("base"), F.col("b") - F.col("base"))
    return found.select("id", "section_id", cut.isNotNull().alias("in_range"), F.coalesce(cut == F.col("chunk_text"), F.lit(False)).alias("same_text"))


def paragraph_split_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "filing_sections").select("id", "text_md")
    return documents.distinct_paragraphs(s, ["id"], "text_md").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("paragraph")).alias("n_chars"), F.max("pos").alias("last_pos"))


def _version_pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf, "section_versions").select("version_id", F.upper(F.trim("ticker")).alias("ticker"), F.upper("section").alias("section"), "fiscal_year", "text")
    return diffs.consecutive_versions(v, ["ticker", "section"], "fiscal_year", "version_id"), v


def section_diff(spark: SparkSession, sf: str) -> DataFrame:
    pairs, v = _version_pairs(spark, sf)
    rows = diffs.section_diffs(pairs, v, "version_id", "text")
    first = lambda c: F.to_json(F.slice(c, 1, 5))
    return rows.select("ticker", "section", "year_a", "year_b", "version_a", "version_b", "state", F.size("added").alias("n_added"), F.size("removed").alias("n_removed"), "common", first("added").alias("first_added"), first("removed").alias("first_removed"))


def section_set_diff(spark: SparkSession, sf: str) -> DataFrame:
    pairs, v = _version_pairs(spark, sf)
    return diffs.paragraph_set_diff(pairs, v, "version_id", "text")


def mention_trend(spark: SparkSession, sf: str) -> DataFrame:
    """How often a term is mentioned, by year."""
    v = table(spark, sf, "section_versions")
    return v.groupBy("fiscal_year").agg(F.sum(F.regexp_count(F.lower("text"), F.lit(r"\bsupplier|\bvendor|\brefiner"))).alias("mentions"), F.count(F.lit(1)).alias("n_versions"))


def text_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """Short previews of documents, without colour codes."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", documents.overlong_value(documents.without_colour_codes(F.col("text")), 80).alias("shown"), F.substring("text", 1, 200).alias("preview"), F.floor(F.length("text") / 4).alias("token_estimate"))


QUERIES = {
    f.__name__: f
    for f in (question_tier, html_to_text, section_detect, chunk_overlap, chunk_offsets_valid, paragraph_split_dedupe, section_diff, section_set_diff, mention_trend, text_cleanup)
}

_any = lambda patterns: "|".join(f"(?:{p})" for p in patterns)
_PARTS = r"""parts AS (SELECT key, unnest(range(len(p))) AS pos, trim(unnest(p), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS paragraph FROM
  (SELECT key, string_split(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10) || chr(10)) AS p FROM source)),
  kept AS (SELECT * FROM parts WHERE length(paragraph) >= 20 QUALIFY row_number() OVER (PARTITION BY key, paragraph ORDER BY pos) = 1)"""

SQL = {
    "question_tier": f"""WITH two AS (SELECT min(ticker) || ' ' || max(ticker) AS two FROM companies),
      q AS (SELECT item_id, false AS two_named, question FROM eval_items UNION ALL SELECT item_id, true, two || ' ' || question FROM eval_items, two),
      n AS (SELECT item_id, two_named, count(DISTINCT ticker) AS n FROM q JOIN companies ON list_contains(regexp_extract_all(question, '\\b([A-Z][A-Z0-9.\\-]*)\\b', 1), ticker) GROUP BY 1, 2)
      SELECT item_id, two_named, coalesce(NOT regexp_matches(lower(question), '{_any(COMPARING)}') AND regexp_matches(lower(question), '{_any(SINGLE_FACT)}')
      AND len(string_split_regex(trim(question), '\\s+')) < 16 AND coalesce(n, 0) <= 1, false) AS single_fact FROM q LEFT JOIN n USING (item_id, two_named)""",
    "chunk_offsets_valid": """SELECT c.id, s.id AS section_id, coalesce(c.char_offset_start < c.char_offset_end AND c.char_offset_end - s.char_offset_start <= length(text_md), false) AS in_range,
      coalesce(c.char_offset_start < c.char_offset_end AND c.char_offset_end - s.char_offset_start <= length(text_md)
        AND substring(text_md, c.char_offset_start - s.char_offset_start + 1, c.char_offset_end - c.char_offset_start) = text, false) AS same_text
      FROM chunks c JOIN filing_sections s USING (filing_id) WHERE c.char_offset_start >= s.char_offset_start AND c.char_offset_start < s.char_offset_start + length(text_md)""",
    "paragraph_split_dedupe": f"WITH source AS (SELECT id AS key, text_md AS body FROM filing_sections), {_PARTS} SELECT key AS id, count(*) AS n, cast(sum(length(paragraph)) AS BIGINT) AS n_chars, cast(max(pos) AS INTEGER) AS last_pos FROM kept GROUP BY 1",
    "section_set_diff": f"""WITH source AS (SELECT version_id AS key, text AS body FROM section_versions), {_PARTS}, p AS (SELECT DISTINCT key, paragraph FROM kept),
      c AS (SELECT version_id AS version_b, lag(version_id) OVER (PARTITION BY upper(trim(ticker)), upper(section) ORDER BY fiscal_year, version_id) AS version_a FROM section_versions),
      s AS (SELECT version_a, version_b, paragraph, 1 AS side FROM c JOIN p ON key = version_a UNION ALL SELECT version_a, version_b, paragraph, 2 FROM c JOIN p ON key = version_b WHERE version_a IS NOT NULL),
      g AS (SELECT version_a, version_b, paragraph, sum(side) AS side FROM s GROUP BY 1, 2, 3)
      SELECT version_a, version_b, count(*) FILTER (side = 2) AS added, count(*) FILTER (side = 1) AS removed, count(*) FILTER (side = 3) AS common FROM g GROUP BY 1, 2""",
    "mention_trend": r"SELECT fiscal_year, cast(sum(len(regexp_extract_all(lower(text), '\bsupplier|\bvendor|\brefiner'))) AS BIGINT) AS mentions, count(*) AS n_versions FROM section_versions GROUP BY 1",
    "text_cleanup": r"""WITH c AS (SELECT *, regexp_replace(text, '\x1b\[[0-9;]*m', '', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 80 THEN substring(t, 1, 80) || '...' ELSE t END AS shown,
      substring(text, 1, 200) AS preview, cast(length(text) // 4 AS BIGINT) AS token_estimate FROM c""",
}
