"""Queries on claims, citations and evaluation results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.numbers import DIGITS, MULTIPLIERS, SUFFIX, extract_numbers, match_number, unsigned_values
from factloom.operators import evaluation as ev
from factloom.operators import verification as vf
from factloom.operators.search import STOP_WORDS, term_overlap
from factloom.sources.tables import table


def number_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of each section version: how many, how many negative or in percent, and the largest."""
    v = table(spark, sf, "section_versions").select("version_id", extract_numbers("text").alias("n"))
    largest = F.array_max(F.transform("n", lambda x: F.abs(x["value"])))
    return v.select("version_id", F.size("n").alias("n_numbers"), F.size(F.filter("n", lambda x: x["is_negative"])).alias("n_negative"), F.size(F.filter("n", lambda x: x["is_percent"])).alias("n_percent"), largest.alias("largest"))


def number_values(spark: SparkSession, sf: str) -> DataFrame:
    """The same without signs."""
    v = table(spark, sf, "section_versions").select("version_id", unsigned_values(F.col("text")).alias("n"))
    return v.select("version_id", F.size("n").alias("n_numbers"), F.array_max("n").alias("largest"))


def numeric_match(spark: SparkSession, sf: str) -> DataFrame:
    """Gold amounts of the evaluation items against the numbers of their passages."""
    e = table(spark, sf, "eval_items").select("item_id", F.get(extract_numbers("gold_answer"), F.lit(0))["value"].alias("gold"), F.transform(extract_numbers("passage"), lambda x: x["value"]).alias("values"))
    m = match_number(F.col("gold"), F.col("values"))
    return e.where("gold IS NOT NULL").select("item_id", "gold", m.alias("m")).select("item_id", "gold", "m.matched", "m.value", F.round("m.error_pct", 6).alias("error_pct"))


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    """Stored chunks, which cite by filing id, and section versions, which cite by accession number, with the text at the place they name."""
    chunks, versions = table(spark, sf, "chunks"), table(spark, sf, "section_versions")
    place = ["char_offset_start", "char_offset_end"]
    by_id = chunks.select(F.concat(F.lit("chunk "), "id").alias("citation_id"), F.col("filing_id").alias("ref"), *place, F.col("text").alias("claim"))
    by_accession = versions.select(F.concat(F.lit("version "), "version_id").alias("citation_id"), F.col("accession_number").alias("ref"), *place, F.col("text").alias("claim"))
    return vf.resolve_citations(by_id.unionByName(by_accession), chunks, table(spark, sf, "filing_sections"), table(spark, sf, "filings"))


def verify_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Every number of the citing texts as a claim, and whole texts without numbers, against the text cited."""
    values = lambda c: F.transform(extract_numbers(c), lambda n: n["value"])
    texts = _cited(spark, sf).select("citation_id", "problem", "cited_text", "claim", values("claim").alias("claims"), values("cited_text").alias("cited_values"))
    claims = texts.select("*", F.posexplode_outer("claims").alias("claim_no", "numeric_value")).withColumn("is_numeric", F.col("numeric_value").isNotNull())
    rows = vf.verify_claims(claims, F.when(~F.col("is_numeric"), term_overlap(F.col("claim"), F.col("cited_text"))), values=F.col("cited_values"))
    return rows.select("citation_id", "claim_no", "numeric_value", "verdict.verified", "verdict.method", F.round("verdict.confidence", 6).alias("confidence"), "verdict.matched_value")


def resolve_citations(spark: SparkSession, sf: str) -> DataFrame:
    return _cited(spark, sf).select("citation_id", "filing_id", "problem", F.length("cited_text").alias("n_chars"))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Events read as evaluation results: type as failure mode, value as latency, user as tier."""
    e = table(spark, sf, "events")
    modes = {"purchase": "correct", "signup": "retrieval_miss", "error": "tool_error", "view": "hallucination", "click": "arithmetic_error"}
    mode = F.create_map(*[F.lit(x) for kv in modes.items() for x in kv])
    rows = e.select("event_id", (F.col("user_id") % 4 + 1).cast("int").alias("tier"), F.round(F.col("value") * 100).alias("latency_ms"), F.try_element_at(mode, F.col("event_type")).alias("failure_mode"))
    return rows.withColumn("numerical_match", F.when(F.col("failure_mode") != "retrieval_miss", F.col("failure_mode") == "correct")).withColumn("faithfulness", (F.col("failure_mode") != "hallucination").cast("double"))


def tier_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ev.tier_summary(_results(spark, sf))


def overall_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return ev.overall_rollup(_results(spark, sf))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return ev.latency_percentiles(_results(spark, sf), ["tier"]).withColumn("mean_ms", F.round("mean_ms", 6))


def failure_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return ev.failure_histogram(_results(spark, sf), ["tier"])


def failure_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Failure modes of answers that the numbered flags of each event stand for."""
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    flag = lambda n: F.col("k") % n == 0
    tools = F.filter(F.array(F.when(flag(2), "xbrl_sql"), F.when(flag(3), "calculator"), F.when(flag(5), "filing_retriever")), lambda t: t.isNotNull())
    errors = F.when(flag(11), F.array(F.lit("timeout"))).otherwise(F.array().cast("array<string>"))
    mode = ev.classify_failure(~flag(13), errors, flag(7), F.col("user_id") % 2 == 0, F.col("k") % 4, F.col("k") % 6, tools)
    return e.where("k IS NOT NULL").groupBy(mode.alias("failure_mode")).agg(F.count(F.lit(1)).alias("n"))


def faithfulness(spark: SparkSession, sf: str) -> DataFrame:
    """Per citing text: its numbers as claims, cited if the place they name can be found and its text has the number."""
    found = F.struct(extract_numbers("claim").alias("n"), F.transform(extract_numbers("cited_text"), lambda x: x["value"]).alias("there"))
    rows = _cited(spark, sf).select("citation_id", F.inline(F.array(found)))  # a row of its own, else the numbers are found anew for each claim
    cited = lambda x: F.when(F.array_contains("there", x["value"]), F.array("citation_id")).otherwise(F.array().cast("array<string>"))
    claims = F.transform("n", lambda x: F.struct(x["raw"].alias("text"), F.lit(True).alias("is_numeric"), cited(x).alias("citations")))
    answers = rows.select("citation_id", claims.alias("claims"))
    return answers.select("citation_id", F.size("claims").alias("n_claims"), F.round(vf.faithfulness(F.col("claims")), 9).alias("faithfulness"), F.size(vf.uncited_numeric(F.col("claims"))).alias("n_uncited"))


def numeric_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Gold amounts of the evaluation items against the numbers of their passages, by the error relative to max(|gold|, 1)."""
    e = table(spark, sf, "eval_items").select("item_id", F.get(extract_numbers("gold_answer"), F.lit(0))["value"].alias("gold"), F.transform(extract_numbers("passage"), lambda x: x["value"]).alias("values"))
    return e.select("item_id", vf.numeric_accuracy(F.col("gold"), F.col("values")).alias("a")).select("item_id", "a.matched", F.round("a.error_pct", 6).alias("error_pct"))


def _ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Two ratings of each order: by price and by the customer's balance."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    rows = o.join(c.select("c_custkey", "c_acctbal", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", "c_mktsegment", F.floor(F.col("o_totalprice") / 150_000).cast("int").alias("rater_a"), F.greatest(F.floor(F.col("c_acctbal") / 3_000), F.lit(-1)).cast("int").alias("rater_b"))


def kappa(spark: SparkSession, sf: str) -> DataFrame:
    rows = ev.cohens_kappa(_ratings(spark, sf), "rater_a", "rater_b", (0, 1, 2, 3), ["c_mktsegment"])
    return rows.select("c_mktsegment", "n", F.round("p_o", 9).alias("p_o"), F.round("p_e", 9).alias("p_e"), F.round("kappa", 9).alias("kappa"), ev.agreement_label(F.col("kappa")).alias("reading"))


def score_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return ev.score_distribution(_ratings(spark, sf), ["rater_a", "rater_b"], (0, 1, 2, 3))


def ablation_table(spark: SparkSession, sf: str) -> DataFrame:
    """A line per tier as in the ablation table."""
    r = _results(spark, sf)
    rows = ev.tier_summary(r).join(ev.latency_percentiles(r, ["tier"]).select("tier", "p95_ms"), "tier", "left")
    return rows.select("tier", ev.ablation_row(F.concat(F.lit("tier "), F.col("tier").cast("string")), F.col("accuracy"), F.col("faithfulness"), F.col("p95_ms")).alias("line"))


QUERIES = {
    f.__name__: f
    for f in (
        number_extract, number_values, numeric_match, verify_verdict, resolve_citations, tier_summary, overall_rollup, latency_percentiles, failure_histogram, failure_classify, faithfulness,
        numeric_accuracy, kappa, score_distribution, ablation_table,
    )
}

_RESULTS = """r AS (SELECT event_id, cast(user_id % 4 + 1 AS INTEGER) AS tier, round(value * 100) AS latency_ms, CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'signup' THEN 'retrieval_miss' WHEN 'error' THEN 'tool_error'
  WHEN 'view' THEN 'hallucination' WHEN 'click' THEN 'arithmetic_error' END AS failure_mode FROM events),
  x AS (SELECT *, CASE WHEN failure_mode <> 'retrieval_miss' THEN failure_mode = 'correct' END AS m, (failure_mode <> 'hallucination')::DOUBLE AS f FROM r)"""
_SUMMARY = "count(*) AS n, count(m) AS n_numeric, count(*) FILTER (m) / greatest(count(m), 1) AS accuracy, avg(f) AS faithfulness"
_MODES = ", ".join(f"('{m}')" for m in ev.MODES)
_RATINGS = "r AS (SELECT c_mktsegment, cast(floor(o_totalprice / 150000) AS INTEGER) AS a, cast(greatest(floor(c_acctbal / 3000), -1) AS INTEGER) AS b FROM orders JOIN customer ON o_custkey = c_custkey)"
_LATENCY = """l AS (SELECT tier, latency_ms, row_number() OVER (PARTITION BY tier ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY tier) AS n FROM x WHERE latency_ms > 0),
  p AS (SELECT tier, max(n) AS n, round(avg(latency_ms), 6) AS mean_ms, median(latency_ms) AS p50_ms, max(latency_ms) FILTER (i = least(n * 95 // 100, n - 1)) AS p95_ms FROM l GROUP BY 1)"""
_NUMBER = rf"(?:{DIGITS})\)?[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{3000}}]*(?:{SUFFIX})?"
_SCALE = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in MULTIPLIERS.items())


def _numbers_sql(name: str, source: str) -> str:
    """CTEs ending in ``name``(key, n): the numbers of source(key, body) as structs of v, pct and neg, in order.

    The five characters before a number are the end of the stretches and numbers before it.
    """
    before = "right(coalesce(b[i - 2], '') || coalesce(r[i - 2], '') || coalesce(b[i - 1], '') || coalesce(r[i - 1], '') || b[i], 5)"
    neg = f"(contains({before}, '(') AND regexp_matches(r[i], '^(?:{DIGITS})\\)'))"
    suffix = f"lower(regexp_extract(r[i], '(?i)({SUFFIX})$', 1))"
    value = f"(CASE WHEN {neg} THEN -1 ELSE 1 END) * replace(regexp_extract(r[i], '^({DIGITS})', 1), ',', '')::DOUBLE * (CASE {suffix} {_SCALE} ELSE 1.0 END)"
    return f"""{name}_split AS (SELECT key, regexp_extract_all(coalesce(body, ''), '(?i){_NUMBER}') AS r, string_split_regex(coalesce(body, ''), '(?i){_NUMBER}') AS b FROM ({source})),
      {name} AS (SELECT key, list_transform(range(1, len(r) + 1), lambda i: struct_pack(v := {value}, pct := {suffix} = '%', neg := {neg})) AS n FROM {name}_split)"""


_CITED = """c AS (SELECT 'chunk ' || id AS citation_id, filing_id AS ref, char_offset_start AS a, char_offset_end AS b, text AS claim FROM chunks
    UNION ALL SELECT 'version ' || version_id, accession_number, char_offset_start, char_offset_end, text FROM section_versions),
  acc AS (SELECT nullif(regexp_replace(accession_number, '[-\\s]', '', 'g'), '') AS k, min(id) AS id FROM filings GROUP BY 1),
  m AS (SELECT c.*, CASE WHEN regexp_matches(lower(ref), '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$') THEN f.id ELSE acc.id END AS filing_id
    FROM c LEFT JOIN filings f ON f.id = lower(ref) LEFT JOIN acc ON acc.k = regexp_replace(ref, '[-\\s]', '', 'g')),
  k AS (SELECT filing_id, char_offset_start AS a, char_offset_end AS b, min(text) AS chunk FROM chunks GROUP BY 1, 2, 3),
  s AS (SELECT citation_id, count(*) AS n, min(CASE WHEN a >= char_offset_start AND a < b AND b - char_offset_start <= length(text_md) THEN substring(text_md, a - char_offset_start + 1, b - a) END) AS slice
    FROM m JOIN filing_sections USING (filing_id) GROUP BY 1),
  cited AS (SELECT m.citation_id, m.filing_id, m.claim, coalesce(chunk, slice) AS cited_text,
    CASE WHEN coalesce(chunk, slice) IS NOT NULL THEN NULL WHEN s.n IS NULL THEN 'filing_missing' ELSE 'offset_invalid' END AS problem FROM m LEFT JOIN k USING (filing_id, a, b) LEFT JOIN s USING (citation_id))"""
_ITEMS = f"""{_numbers_sql("gold", "SELECT item_id AS key, gold_answer AS body FROM eval_items")}, {_numbers_sql("passage", "SELECT item_id AS key, passage AS body FROM eval_items")},
  e AS (SELECT gold.key AS item_id, gold.n[1].v AS gold, list_transform(passage.n, lambda x: x.v) AS vals FROM gold JOIN passage USING (key))"""
# Of target t and values vals: the first within half a percent, else the closest; a target of zero needs a zero.
_MATCH = """CASE WHEN {t} = 0 THEN CASE WHEN len(list_filter(vals, lambda v: abs(v) < 1e-6)) > 0 THEN struct_pack(ok := true, v := list_filter(vals, lambda v: abs(v) < 1e-6)[1], e := 0.0::DOUBLE) ELSE struct_pack(ok := false, v := NULL::DOUBLE, e := NULL::DOUBLE) END
  WHEN len(list_filter(vals, lambda v: abs(v - {t}) / abs({t}) * 100 <= 0.5)) > 0 THEN struct_pack(ok := true, v := list_filter(vals, lambda v: abs(v - {t}) / abs({t}) * 100 <= 0.5)[1], e := abs(list_filter(vals, lambda v: abs(v - {t}) / abs({t}) * 100 <= 0.5)[1] - {t}) / abs({t}) * 100)
  ELSE struct_pack(ok := false, v := list_sort(list_transform(range(1, len(vals) + 1), lambda i: struct_pack(e := abs(vals[i] - {t}) / abs({t}) * 100, i := i, v := vals[i])))[1].v,
    e := list_min(list_transform(vals, lambda v: abs(v - {t}) / abs({t}) * 100))) END"""
_WORDS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"
_ASKED = f"list_distinct(list_filter({_WORDS.format('claim')}, lambda t: t NOT IN ({', '.join(repr(w) for w in STOP_WORDS)})))"

SQL = {
    "number_extract": f"""WITH {_numbers_sql("x", "SELECT version_id AS key, text AS body FROM section_versions")} SELECT key AS version_id, cast(len(n) AS INTEGER) AS n_numbers,
      cast(len(list_filter(n, lambda z: z.neg)) AS INTEGER) AS n_negative, cast(len(list_filter(n, lambda z: z.pct)) AS INTEGER) AS n_percent, list_max(list_transform(n, lambda z: abs(z.v))) AS largest FROM x""",
    "number_values": f"""WITH {_numbers_sql("x", "SELECT version_id AS key, text AS body FROM section_versions")}
      SELECT key AS version_id, cast(len(n) AS INTEGER) AS n_numbers, list_max(list_transform(n, lambda z: abs(z.v))) AS largest FROM x""",
    "numeric_match": f"WITH {_ITEMS}, x AS (SELECT *, {_MATCH.format(t='gold')} AS m FROM e WHERE gold IS NOT NULL) SELECT item_id, gold, m.ok AS matched, m.v AS value, round(m.e, 6) AS error_pct FROM x",
    "numeric_accuracy": f"""WITH {_ITEMS}, x AS (SELECT *, list_transform(vals, lambda v: abs(v - gold) / greatest(abs(gold), 1.0) * 100) AS errs FROM e)
      SELECT item_id, CASE WHEN gold IS NOT NULL THEN len(list_filter(errs, lambda q: q <= 0.5)) > 0 END AS matched,
      CASE WHEN gold IS NOT NULL THEN round(coalesce(list_filter(errs, lambda q: q <= 0.5)[1], list_min(errs)), 6) END AS error_pct FROM x""",
    "resolve_citations": f"WITH {_CITED} SELECT citation_id, filing_id, problem, cast(length(cited_text) AS INTEGER) AS n_chars FROM cited",
    "faithfulness": f"""WITH {_CITED}, {_numbers_sql("p", "SELECT citation_id AS key, claim AS body FROM cited")}, {_numbers_sql("q", "SELECT citation_id AS key, cited_text AS body FROM cited")},
      x AS (SELECT p.key AS citation_id, p.n AS claims, list_transform(q.n, lambda z: z.v) AS there FROM p JOIN q USING (key)),
      y AS (SELECT citation_id, len(claims) AS n, len(list_filter(claims, lambda z: list_contains(there, z.v))) AS ok FROM x)
      SELECT citation_id, cast(n AS INTEGER) AS n_claims, CASE WHEN n = 0 THEN 1.0 ELSE round(ok / n, 9) END AS faithfulness, cast(n - ok AS INTEGER) AS n_uncited FROM y""",
    "verify_verdict": f"""WITH {_CITED}, {_numbers_sql("p", "SELECT citation_id AS key, claim AS body FROM cited")}, {_numbers_sql("q", "SELECT citation_id AS key, cited_text AS body FROM cited")},
      x AS (SELECT cited.*, p.n AS claims, list_transform(q.n, lambda z: z.v) AS vals, unnest(CASE WHEN len(p.n) = 0 THEN [NULL] ELSE range(1, len(p.n) + 1) END) AS i FROM cited JOIN p ON p.key = citation_id JOIN q ON q.key = citation_id),
      y AS (SELECT *, claims[i].v AS t FROM x), z AS (SELECT *, CASE WHEN t IS NOT NULL AND problem IS NULL THEN {_MATCH.format(t="t")} END AS m,
        CASE WHEN t IS NULL THEN len(list_intersect({_ASKED}, {_WORDS.format("cited_text")})) / nullif(len({_ASKED}), 0) END AS sim FROM y)
      SELECT citation_id, cast(i - 1 AS INTEGER) AS claim_no, t AS numeric_value, problem IS NULL AND CASE WHEN t IS NULL THEN coalesce(sim >= 0.55, false) ELSE m.ok END AS verified,
        CASE WHEN problem IS NOT NULL THEN problem WHEN t IS NULL THEN CASE WHEN sim >= 0.55 THEN 'semantic_similarity' ELSE 'semantic_below_threshold' END
          WHEN m.ok AND m.e <= 1e-6 THEN 'numeric_exact' WHEN m.ok THEN 'numeric_tolerance' ELSE 'numeric_mismatch' END AS method,
        round(CASE WHEN problem IS NOT NULL THEN NULL WHEN t IS NULL THEN sim WHEN m.ok AND m.e <= 1e-6 THEN 1.0 WHEN m.ok THEN 1 - m.e / 0.5 END, 6) AS confidence,
        CASE WHEN problem IS NULL AND t IS NOT NULL THEN m.v END AS matched_value FROM z""",
    "tier_summary": f"WITH {_RESULTS} SELECT tier, {_SUMMARY} FROM x GROUP BY 1",
    "overall_rollup": f"WITH {_RESULTS} SELECT tier, {_SUMMARY} FROM x GROUP BY ROLLUP (tier)",
    "latency_percentiles": f"WITH {_RESULTS}, {_LATENCY} SELECT * FROM p",
    "failure_histogram": f"""WITH {_RESULTS}, modes(failure_mode) AS (VALUES {_MODES}), t AS (SELECT tier, count(*) AS total FROM x GROUP BY 1), c AS (SELECT tier, failure_mode, count(*) AS n FROM x GROUP BY 1, 2)
      SELECT tier, failure_mode, coalesce(n, 0) AS n, round(coalesce(n, 0) / total * 100, 6) AS pct FROM t CROSS JOIN modes LEFT JOIN c USING (tier, failure_mode)""",
    "failure_classify": """WITH e AS (SELECT user_id, cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), f AS (SELECT *, k % 2 = 0 AS sql, k % 3 = 0 AS calc, k % 5 = 0 AS ret FROM e WHERE k IS NOT NULL)
      SELECT CASE WHEN k % 13 = 0 THEN 'planning_failure' WHEN k % 11 = 0 THEN 'tool_error' WHEN user_id % 2 = 0 THEN CASE WHEN k % 7 = 0 THEN 'correct' WHEN NOT sql THEN 'table_parsing_error' WHEN k % 4 = 0 THEN 'hallucination'
        WHEN calc THEN 'arithmetic_error' ELSE 'hallucination' END WHEN ret THEN CASE WHEN k % 6 = 0 THEN 'hallucination' ELSE 'correct' END WHEN NOT sql AND NOT calc THEN 'planning_failure' ELSE 'retrieval_miss' END AS failure_mode,
        count(*) AS n FROM f GROUP BY 1""",
    "kappa": f"""WITH {_RATINGS}, n AS (SELECT c_mktsegment, count(*) AS n, count(*) FILTER (a = b) / count(*) AS p_o, {" + ".join(f"(count(*) FILTER (a = {i}) / count(*)) * (count(*) FILTER (b = {i}) / count(*))" for i in range(4))} AS p_e FROM r GROUP BY 1),
      k AS (SELECT *, (p_o - p_e) / (1 - p_e) AS k FROM n) SELECT c_mktsegment, n, round(p_o, 9) AS p_o, round(p_e, 9) AS p_e, round(k, 9) AS kappa,
      CASE WHEN k >= 0.8 THEN 'almost perfect' WHEN k >= 0.6 THEN 'substantial' WHEN k >= 0.4 THEN 'moderate' WHEN k >= 0.2 THEN 'fair' WHEN k >= 0 THEN 'slight' ELSE 'poor' END AS reading FROM k""",
    "score_distribution": f"WITH {_RATINGS}, s(score) AS (VALUES (0), (1), (2), (3)) SELECT score, (SELECT count(*) FROM r WHERE a = score) AS rater_a, (SELECT count(*) FROM r WHERE b = score) AS rater_b FROM s",
    "ablation_table": f"""WITH {_RESULTS}, {_LATENCY}, t AS (SELECT tier, {_SUMMARY} FROM x GROUP BY 1)
      SELECT tier, 'tier ' || tier || ' | ' || printf('%.0f%%', accuracy * 100) || ' | ' || printf('%.0f%%', faithfulness * 100) || ' | ' || coalesce(printf('%.1fs', p95_ms / 1000), 'N/A') AS line FROM t LEFT JOIN p USING (tier)""",
}
