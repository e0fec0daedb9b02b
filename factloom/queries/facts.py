"""Queries on structured facts and arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import calc
from factloom.functions.concepts import TAGS, tag_table
from factloom.operators import facts as op
from factloom.operators.predicates import any_of, where
from factloom.operators.quantiles import exact_median
from factloom.sources.tables import table

_YEARS = (2015, 2016, 2017, 2018, 2019)
_PAIR = ("net_income", "revenue")


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "xbrl_facts")


def _companies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "companies")


def _with_ticker(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    return rows.join(_companies(spark, sf).select("cik", "ticker"), "cik")


def facts_by_company_year(spark: SparkSession, sf: str) -> DataFrame:
    rows = op.query_facts(_facts(spark, sf), _companies(spark, sf), "revenue", fiscal_years=_YEARS)
    return rows.select("ticker", "fiscal_year", "canonical_concept", F.col("value").cast("double").alias("value"), "fiscal_period", "period_end", "id")


def facts_multi_concept(spark: SparkSession, sf: str) -> DataFrame:
    rows = op.query_facts(_facts(spark, sf), _companies(spark, sf), ["revenue", "net_income", "capex"], fiscal_years=[], fiscal_period="FY")
    return rows.groupBy("canonical_concept", "fiscal_year").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ticker").alias("n_companies"))


def comparison_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = op.query_facts(_facts(spark, sf), _companies(spark, sf), ["revenue", "cash"], fiscal_years=2018, form=["10-K", "10-Q"])
    return op.comparison_table(rows)


def single_fact(spark: SparkSession, sf: str) -> DataFrame:
    rows = op.annual_values(_facts(spark, sf), ["revenue"]).where("fiscal_year = 2018")
    return _with_ticker(spark, sf, rows).select("ticker", "fiscal_year", "value", op.large_number(F.col("value")).alias("shown"))


def _ratio_query(spark: SparkSession, sf: str, top: str, bottom: str) -> DataFrame:
    rows = op.wide(op.annual_values(_facts(spark, sf), [top, bottom]), [top, bottom]).where(F.col(top).isNotNull() & F.col(bottom).isNotNull())
    pct = F.round(calc.margin(F.col(top), F.col(bottom)), 6)
    return _with_ticker(spark, sf, rows).select("ticker", "fiscal_year", F.col(top).alias("numerator"), F.col(bottom).alias("denominator"), pct.alias("pct"))


def margin_by_company_year(spark: SparkSession, sf: str) -> DataFrame:
    return _ratio_query(spark, sf, *_PAIR)


def intensity_pct(spark: SparkSession, sf: str) -> DataFrame:
    return _ratio_query(spark, sf, "rd_expense", "revenue")


def pivot_periods(spark: SparkSession, sf: str) -> DataFrame:
    periods = ["FY", "Q1", "Q2", "Q3"]
    rows = _facts(spark, sf).where("canonical_concept = 'net_income' AND value IS NOT NULL")
    return rows.groupBy("cik", "fiscal_year").pivot("fiscal_period", periods).agg(F.sum("value").cast("double"))


def eps_growth(spark: SparkSession, sf: str) -> DataFrame:
    rows = op.growth(op.annual_values(_facts(spark, sf), ["eps_basic"]), ["cik"])
    return rows.select("cik", "fiscal_year", "value", "prev_value", "growth_pct")


def growth_a_gt_b(spark: SparkSession, sf: str) -> DataFrame:
    """Years in which revenue grew faster than cost of revenue."""
    rows = op.growth(op.annual_values(_facts(spark, sf), ["revenue", "cost_of_revenue"]), ["cik", "canonical_concept"])
    a = rows.where("canonical_concept = 'revenue'").select("cik", "fiscal_year", F.col("growth_pct").alias("growth_a"))
    b = rows.where("canonical_concept = 'cost_of_revenue'").select("cik", "fiscal_year", F.col("growth_pct").alias("growth_b"))
    return a.join(b, ["cik", "fiscal_year"]).where("growth_a > growth_b")


def any_decline(spark: SparkSession, sf: str) -> DataFrame:
    rows = op.growth(op.annual_values(_facts(spark, sf), ["revenue"]), ["cik"])
    return rows.groupBy("cik").agg(F.coalesce(F.bool_or(F.col("growth_pct") < 0), F.lit(False)).alias("any_decline"), F.count_if(F.col("growth_pct") < 0).alias("n_declines"))


def fastest_cagr(spark: SparkSession, sf: str) -> DataFrame:
    """The company with the fastest compound revenue growth in each sector."""
    rows = op.compound_growth(op.annual_values(_facts(spark, sf), ["revenue"]), ["cik"]).where("cagr_pct IS NOT NULL")
    known = rows.join(_companies(spark, sf).select("cik", "ticker", F.coalesce("sector", F.lit("none")).alias("sector")), "cik")
    w = Window.partitionBy("sector").orderBy(F.desc("cagr_pct"), "cik")
    return known.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("sector", "ticker", "start_value", "end_value", "years", "cagr_pct")


def series_scaled(spark: SparkSession, sf: str) -> DataFrame:
    return op.scaled_to_unit(op.annual_values(_facts(spark, sf), ["cash"]), ["cik"]).select("cik", "fiscal_year", "value", "scaled")


def series_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """One ordered series per company, of two points or more."""
    rows = op.annual_values(_facts(spark, sf), ["total_assets"])
    points = F.array_sort(F.collect_list(F.struct("fiscal_year", "value")))
    shown = F.array_join(F.transform("points", lambda p: F.concat_ws(":", p["fiscal_year"].cast("string"), F.format_string("%.0f", p["value"]))), ",")
    return rows.groupBy("cik").agg(points.alias("points")).where(F.size("points") >= 2).select("cik", F.size("points").alias("n_points"), shown.alias("series"))


def side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    """Annual revenue of the first and the last ticker, a column each."""
    companies = table(spark, sf, "companies").select("cik", "ticker")
    ends = companies.agg(F.min("ticker").alias("first"), F.max("ticker").alias("last"))
    rows = op.annual_values(_facts(spark, sf), ["revenue"]).join(companies, "cik").join(ends, (F.col("ticker") == F.col("first")) | (F.col("ticker") == F.col("last")))
    of = lambda end: F.max(F.when(F.col("ticker") == F.col(end), F.col("value")))
    return rows.groupBy("fiscal_year").agg(of("first").alias("first_ticker"), of("last").alias("last_ticker"))


def _narrative(spark: SparkSession, sf: str, pattern: str) -> DataFrame:
    """(cik, fiscal_year, n_sections, n_mentions): how often the sections of a company's filings of a year mention a pattern."""
    f = table(spark, sf, "filings").select(F.col("id").alias("filing_id"), "cik", "fiscal_year")
    s = table(spark, sf, "filing_sections").select("filing_id", F.regexp_count(F.lower("text_md"), F.lit(pattern)).alias("n"))
    return s.join(f, "filing_id").groupBy("cik", "fiscal_year").agg(F.count(F.lit(1)).alias("n_sections"), F.sum("n").alias("n_mentions"))


def facts_with_narrative(spark: SparkSession, sf: str) -> DataFrame:
    """Annual revenue beside what the filings of the year say of it."""
    rows = op.annual_values(_facts(spark, sf), ["revenue"]).join(_narrative(spark, sf, r"\brevenues?\b"), ["cik", "fiscal_year"])
    return rows.select("cik", "fiscal_year", "value", "n_sections", "n_mentions")


def growth_with_narrative(spark: SparkSession, sf: str) -> DataFrame:
    """Years of falling revenue and how often the filings of that year speak of risk or decline; 0 where there is no section."""
    fell = op.growth(op.annual_values(_facts(spark, sf), ["revenue"]), ["cik"]).where("growth_pct < 0").select("cik", "fiscal_year", "growth_pct")
    return fell.join(_narrative(spark, sf, r"\brisks?\b|\bdeclin|\bdecreas"), ["cik", "fiscal_year"], "left").fillna(0, ["n_sections", "n_mentions"])


def first_alias_value(spark: SparkSession, sf: str) -> DataFrame:
    return op.first_of_year(_facts(spark, sf), tag_table(spark)).where("canonical = 'revenue'").drop("canonical")


def concept_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """1.0 or 0.0 per company and required concept."""
    required = ["revenue", "net_income", "capex"]
    has = _facts(spark, sf).groupBy("cik").agg(*[F.max((F.col("canonical_concept") == c).cast("double")).alias(c) for c in required])
    return has.select("cik", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in required])


def margin_by_nation_year(spark: SparkSession, sf: str) -> DataFrame:
    """Net over gross sales by nation and order year."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("fiscal_year"))
    customer, nation = table(spark, sf, "customer").select("c_custkey", "c_nationkey"), table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("ticker"))
    gross = F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))
    net = F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)"))
    rows = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("ticker", "fiscal_year")
        .agg(net.cast("double").alias("numerator"), gross.cast("double").alias("denominator"))
    )
    return rows.withColumn("pct", F.round(calc.margin(F.col("numerator"), F.col("denominator")), 6))


def calc_named_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Each two-operand operation over net income (a) and revenue (b)."""
    rows = op.wide(op.annual_values(_facts(spark, sf), _PAIR), _PAIR).where("net_income IS NOT NULL AND revenue IS NOT NULL")
    a, b = F.col("net_income"), F.col("revenue")
    named = {"add": calc.add(a, b), "subtract": calc.subtract(a, b), "multiply": calc.multiply(a, b / 1e9), "divide": calc.ratio(a, b), "yoy": calc.yoy_growth(a, b), "percent_of": calc.margin(a, b), "cagr": calc.cagr(a, b, F.lit(3))}
    return rows.select("cik", "fiscal_year", *[F.round(c, 6).alias(k) for k, c in named.items()])


def calc_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    rows = _facts(spark, sf).where("value IS NOT NULL")
    v = F.col("value").cast("double")
    sums = rows.groupBy("canonical_concept").agg(
        F.sum("value").cast("double").alias("sum_value"), F.round(F.sum("value").cast("double") / F.count("value"), 4).alias("mean_value"),
        F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.count("value").alias("n_values"),
    )
    return sums.join(exact_median(rows.withColumn("value", v), ["canonical_concept"], "value", "median_value"), "canonical_concept")


def calc_expression(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    value = calc.expression("price * (1 - discount) ** 2 // 3 - qty % -7 + 2 * -tax", price=F.col("l_extendedprice"), discount=F.col("l_discount"), qty=F.col("l_quantity"), tax=F.col("l_tax"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(value, 6).alias("result")).groupBy("l_orderkey").agg(F.count("result").alias("n"), F.max("result").alias("most"), F.min("result").alias("least"))


def filters_any_all(spark: SparkSession, sf: str) -> DataFrame:
    """Dynamic filters: a list, a scalar, an empty list (no filter) and a set membership scan."""
    rows = where(_facts(spark, sf), form=["10-K", "10-K/A"], fiscal_period="FY", fiscal_year=[])
    unit = any_of(F.lower("unit"), ["usd", "shares"])
    return rows.where(unit).groupBy("form", "fiscal_year").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        facts_by_company_year, facts_multi_concept, comparison_table, single_fact, margin_by_company_year, intensity_pct, pivot_periods, eps_growth, growth_a_gt_b, any_decline,
        fastest_cagr, series_scaled, series_arrays, side_by_side, facts_with_narrative, growth_with_narrative, first_alias_value, concept_coverage, margin_by_nation_year, calc_named_ops, calc_aggregates, calc_expression, filters_any_all,
    )
}

_BASE = "upper(trim(regexp_replace(form, '(?i)/A\\s*$', '')))"
_ANNUAL = f"""annual AS (SELECT cik, canonical_concept, fiscal_year, cast(value AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY cik, canonical_concept, fiscal_year
  ORDER BY period_end DESC, created_at DESC, id DESC) AS r FROM xbrl_facts WHERE fiscal_period = 'FY' AND value IS NOT NULL AND {_BASE} = '10-K') WHERE r = 1)"""
_GROWTH = f"""WITH {_ANNUAL}, prev AS (SELECT *, CASE WHEN lag(fiscal_year) OVER w = fiscal_year - 1 THEN lag(value) OVER w END AS prev_value FROM annual
  WINDOW w AS (PARTITION BY cik, canonical_concept ORDER BY fiscal_year)), growth AS (SELECT *, round((value - prev_value) / nullif(prev_value, 0) * 100, 6) AS growth_pct FROM prev)"""


def _ratio_sql(top: str, bottom: str) -> str:
    return f"""WITH {_ANNUAL}, w AS (SELECT cik, fiscal_year, max(value) FILTER (canonical_concept = '{top}') AS numerator, max(value) FILTER (canonical_concept = '{bottom}') AS denominator FROM annual GROUP BY 1, 2)
      SELECT ticker, fiscal_year, numerator, denominator, round(numerator / nullif(denominator, 0) * 100, 6) AS pct FROM w JOIN companies USING (cik) WHERE numerator IS NOT NULL AND denominator IS NOT NULL"""


_TAGS = ", ".join(f"('{t}', '{c}', {p})" for t, c, p in TAGS)

SQL = {
    "facts_by_company_year": f"""SELECT ticker, fiscal_year, canonical_concept, cast(value AS DOUBLE) AS value, fiscal_period, period_end, id FROM xbrl_facts JOIN companies USING (cik)
      WHERE canonical_concept = 'revenue' AND fiscal_year IN (2015, 2016, 2017, 2018, 2019) AND {_BASE} = '10-K'""",
    "facts_multi_concept": f"""SELECT canonical_concept, fiscal_year, count(*) AS n_rows, count(DISTINCT ticker) AS n_companies FROM xbrl_facts JOIN companies USING (cik)
      WHERE canonical_concept IN ('revenue', 'net_income', 'capex') AND fiscal_period = 'FY' AND {_BASE} = '10-K' GROUP BY 1, 2""",
    "comparison_table": f"""SELECT ticker, canonical_concept, fiscal_year, fiscal_period, cast(value AS DOUBLE) AS value, cast(value AS DOUBLE) / 1e9 AS value_bn FROM xbrl_facts JOIN companies USING (cik)
      WHERE canonical_concept IN ('revenue', 'cash') AND fiscal_year = 2018 AND {_BASE} IN ('10-K', '10-Q')""",
    "series_arrays": f"""WITH {_ANNUAL} SELECT cik, cast(count(*) AS INTEGER) AS n_points, string_agg(fiscal_year || ':' || printf('%.0f', value), ',' ORDER BY fiscal_year) AS series
      FROM annual WHERE canonical_concept = 'total_assets' GROUP BY 1 HAVING count(*) >= 2""",
    "side_by_side": f"""WITH {_ANNUAL}, e AS (SELECT min(ticker) AS a, max(ticker) AS b FROM companies), r AS (SELECT fiscal_year, ticker, value, a, b FROM annual JOIN companies USING (cik), e WHERE canonical_concept = 'revenue' AND ticker IN (a, b))
      SELECT fiscal_year, max(value) FILTER (ticker = a) AS first_ticker, max(value) FILTER (ticker = b) AS last_ticker FROM r GROUP BY 1""",
    "facts_with_narrative": f"""WITH {_ANNUAL}, n AS (SELECT cik, fiscal_year, count(*) AS n_sections, cast(sum(len(regexp_extract_all(lower(text_md), '\\brevenues?\\b'))) AS BIGINT) AS n_mentions
        FROM filing_sections s JOIN filings f ON f.id = s.filing_id GROUP BY 1, 2) SELECT cik, fiscal_year, value, n_sections, n_mentions FROM annual JOIN n USING (cik, fiscal_year) WHERE canonical_concept = 'revenue'""",
    "growth_with_narrative": _GROWTH + """, n AS (SELECT cik, fiscal_year, count(*) AS n_sections, cast(sum(len(regexp_extract_all(lower(text_md), '\\brisks?\\b|\\bdeclin|\\bdecreas'))) AS BIGINT) AS n_mentions
        FROM filing_sections s JOIN filings f ON f.id = s.filing_id GROUP BY 1, 2)
      SELECT cik, fiscal_year, growth_pct, coalesce(n_sections, 0) AS n_sections, coalesce(n_mentions, 0) AS n_mentions FROM growth LEFT JOIN n USING (cik, fiscal_year) WHERE canonical_concept = 'revenue' AND growth_pct < 0""",
    "single_fact": f"""WITH {_ANNUAL} SELECT ticker, fiscal_year, value, CASE WHEN abs(value) >= 1e12 THEN printf('$%.2fT', value / 1e12) WHEN abs(value) >= 1e9 THEN printf('$%.2fB', value / 1e9)
      WHEN abs(value) >= 1e6 THEN printf('$%.1fM', value / 1e6) ELSE printf('$%.0f', value) END AS shown FROM annual JOIN companies USING (cik) WHERE canonical_concept = 'revenue' AND fiscal_year = 2018""",
    "margin_by_company_year": _ratio_sql(*_PAIR),
    "intensity_pct": _ratio_sql("rd_expense", "revenue"),
    "pivot_periods": "SELECT cik, fiscal_year, "
    + ", ".join(f"cast(sum(value) FILTER (fiscal_period = '{p}') AS DOUBLE) AS {p}" for p in ("FY", "Q1", "Q2", "Q3"))
    + " FROM xbrl_facts WHERE canonical_concept = 'net_income' AND value IS NOT NULL GROUP BY 1, 2",
    "eps_growth": _GROWTH + "SELECT cik, fiscal_year, value, prev_value, growth_pct FROM growth WHERE canonical_concept = 'eps_basic'",
    "growth_a_gt_b": _GROWTH
    + """SELECT a.cik, a.fiscal_year, a.growth_pct AS growth_a, b.growth_pct AS growth_b FROM growth a JOIN growth b USING (cik, fiscal_year)
      WHERE a.canonical_concept = 'revenue' AND b.canonical_concept = 'cost_of_revenue' AND a.growth_pct > b.growth_pct""",
    "any_decline": _GROWTH + "SELECT cik, coalesce(bool_or(growth_pct < 0), false) AS any_decline, count(*) FILTER (growth_pct < 0) AS n_declines FROM growth WHERE canonical_concept = 'revenue' GROUP BY 1",
    "fastest_cagr": f"""WITH {_ANNUAL}, c AS (SELECT cik, arg_min(value, fiscal_year) AS start_value, arg_max(value, fiscal_year) AS end_value, max(fiscal_year) - min(fiscal_year) AS years FROM annual
      WHERE canonical_concept = 'revenue' GROUP BY 1), g AS (SELECT *, round((pow(end_value / start_value, 1.0 / years) - 1) * 100, 6) AS cagr_pct FROM c WHERE years > 0 AND start_value > 0 AND end_value > 0),
      r AS (SELECT coalesce(sector, 'none') AS sector, ticker, start_value, end_value, years, cagr_pct, row_number() OVER (PARTITION BY coalesce(sector, 'none') ORDER BY cagr_pct DESC, cik) AS r FROM g JOIN companies USING (cik))
      SELECT * EXCLUDE (r) FROM r WHERE r = 1""",
    "series_scaled": f"""WITH {_ANNUAL} SELECT cik, fiscal_year, value, round(coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0), 9) AS scaled FROM annual
      WHERE canonical_concept = 'cash' WINDOW w AS (PARTITION BY cik) QUALIFY count(value) OVER w >= 2""",
    "first_alias_value": f"""WITH tags(concept, canonical, priority) AS (VALUES {_TAGS}) SELECT cik, fiscal_year, cast(value AS DOUBLE) AS value, concept, period_end FROM xbrl_facts JOIN tags USING (concept)
      WHERE canonical = 'revenue' AND value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cik, fiscal_year ORDER BY period_end, priority, id) = 1""",
    "concept_coverage": "SELECT cik, "
    + ", ".join(f"cast(max((canonical_concept = '{c}')::INT) AS DOUBLE) AS {c}" for c in ("revenue", "net_income", "capex"))
    + " FROM xbrl_facts GROUP BY 1",
    "margin_by_nation_year": """SELECT n_name AS ticker, cast(year(o_orderdate) AS INTEGER) AS fiscal_year, cast(sum(cast(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS numerator,
      cast(sum(cast(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS denominator,
      round(cast(sum(cast(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) / cast(sum(cast(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) * 100, 6) AS pct
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    "calc_named_ops": f"""WITH {_ANNUAL}, w AS (SELECT cik, fiscal_year, max(value) FILTER (canonical_concept = 'net_income') AS a, max(value) FILTER (canonical_concept = 'revenue') AS b FROM annual GROUP BY 1, 2)
      SELECT cik, fiscal_year, round(a + b, 6) AS "add", round(a - b, 6) AS subtract, round(a * (b / 1e9), 6) AS multiply, round(a / nullif(b, 0), 6) AS divide, round((a - b) / nullif(b, 0) * 100, 6) AS yoy,
      round(a / nullif(b, 0) * 100, 6) AS percent_of, round(CASE WHEN a > 0 AND b > 0 THEN (pow(b / a, 1.0 / 3) - 1) * 100 END, 6) AS cagr FROM w WHERE a IS NOT NULL AND b IS NOT NULL""",
    "calc_aggregates": """SELECT canonical_concept, cast(sum(value) AS DOUBLE) AS sum_value, round(cast(sum(value) AS DOUBLE) / count(value), 4) AS mean_value, median(cast(value AS DOUBLE)) AS median_value,
      min(cast(value AS DOUBLE)) AS min_value, max(cast(value AS DOUBLE)) AS max_value, count(value) AS n_values FROM xbrl_facts WHERE value IS NOT NULL GROUP BY 1""",
    "calc_expression": """WITH r AS (SELECT l_orderkey, round(floor(l_extendedprice * pow(1 - l_discount, 2) / 3) - (l_quantity - (-7) * floor(l_quantity / (-7))) + 2 * (-l_tax), 6) AS result FROM lineitem)
      SELECT l_orderkey, count(result) AS n, max(result) AS most, min(result) AS least FROM r GROUP BY 1""",
    "filters_any_all": """SELECT form, fiscal_year, count(*) AS n FROM xbrl_facts WHERE form IN ('10-K', '10-K/A') AND fiscal_period = 'FY' AND lower(unit) IN ('usd', 'shares') GROUP BY 1, 2""",
}
