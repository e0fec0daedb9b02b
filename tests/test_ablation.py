from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.plans import ablation
from factloom.queries.search import eval_by_config, term_vector

SF = "/root/testdata/sf0.001"
FACTS = "id string, cik long, canonical_concept string, fiscal_year int, fiscal_period string, form string, period_start date, period_end date, value double, unit string, accession_number string, created_at timestamp"


def setting(spark):
    end = dt.date(2020, 12, 31)
    row = lambda i, cik, concept, year, value, acc, form="10-K": (str(i), cik, concept, year, "FY", form, None, end, value, "USD", acc, None)
    facts = [
        row(1, 1, "revenue", 2020, 500.0, "a-1"), row(2, 1, "revenue", 2021, 501.0, None), row(3, 2, "revenue", 2020, 900.0, "a-2", "10-K/A"), row(4, 2, "revenue", 2020, None, "a-3"),
        row(5, 1, "net_income", 2020, 77.0, "a-4"), row(6, 9, "revenue", 2020, 77.0, "a-5"), row(7, 1, "revenue", 2020, 77.0, "a-6", "10-Q"),
    ]
    questions = [
        (1, 1, "copper mill output", 500.0, None, None), (2, 1, "copper mill output", 77.0, None, []), (3, 2, "barley harvest", 500.0, ["BBB"], None), (4, 2, "barley harvest", 12.0, None, None),
        (5, 3, "barley harvest", None, ["AAA"], [2021]), (6, 3, "zzz", 900.0, None, [2020]),
    ]
    return (
        spark.createDataFrame(questions, "id long, tier int, text string, gold double, tickers array<string>, fiscal_years array<int>"),
        spark.createDataFrame([(10, "copper mill output rose"), (11, "barley harvest of 12 acres")], "id long, text string"),
        spark.createDataFrame(facts, FACTS), spark.createDataFrame([(1, "AAA"), (2, "BBB")], "cik long, ticker string"),
    )


def test_facts_step(spark):
    questions, chunks, facts, companies = setting(spark)
    plain, with_facts = ablation.STEPS[0][0], ablation.STEPS[2][0]
    got = {(r.config, r.id): r for r in ablation.evaluate_all(questions, chunks, [plain, with_facts], term_vector, facts, companies).collect()}
    assert len(got) == 12
    of = lambda config: [(got[config, i].numerical_match, None if got[config, i].error_pct is None else round(got[config, i].error_pct, 3), round(got[config, i].faithfulness, 3), got[config, i].failure_mode) for i in range(1, 7)]
    parse = "table_parsing_error"
    assert of(plain) == [(False, None, 1.0, parse), (False, None, 1.0, parse), (False, 97.6, 1.0, parse), (True, 0.0, 1.0, "correct"), (None, None, 1.0, "correct"), (False, None, 1.0, "planning_failure")]
    # 500, 501 (not cited) and 900 for questions without filters; other concepts, forms, unknown filers and NULL values are no claims
    assert of(with_facts) == [
        (True, 0.0, 0.667, "correct"), (False, 549.351, 0.667, parse), (False, 80.0, 1.0, parse), (True, 0.0, 0.75, "correct"), (None, None, 0.5, "correct"), (True, 0.0, 1.0, "correct"),
    ]


def test_steps_that_are_not_run(spark):
    questions, chunks, facts, companies = setting(spark)
    for name, _ in ablation.STEPS[3:]:
        with pytest.raises(ValueError, match="not run here"):
            ablation.evaluate_all(questions, chunks, [name], term_vector, facts, companies)
    with pytest.raises(ValueError, match="facts"):
        ablation.evaluate_all(questions, chunks, [ablation.STEPS[2][0]], term_vector)
    with pytest.raises(ValueError, match="vector"):
        ablation.retrieve(questions.select("id", "text"), chunks, ablation.steps_of(ablation.STEPS[1][0]), None)
    with pytest.raises(ValueError, match="unknown"):
        ablation.steps_of("other")


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_tables(spark):
    rows = eval_by_config(spark, SF).groupBy("config").agg(F.count_distinct("id").alias("n")).collect()
    assert {r.config: r.n for r in rows} == {name: 240 for name, _ in ablation.STEPS[:3]}
