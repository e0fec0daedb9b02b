from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from factloom.functions.concepts import TAGS, base_form, tag_table
from factloom.operators import facts, ingest
from factloom.operators.predicates import split_list, unknown_values, where


def test_tags():
    rows = TAGS
    assert len(rows) == 51 and len({c for _, c, _ in rows}) == 36 and sum(c == "revenue" for _, c, _ in rows) == 9 and len({t for t, _, _ in rows}) == 51


def test_forms_and_fiscal_labels(spark):
    df = spark.createDataFrame([("10-K/A",), (" 10-q",), ("8-K",), (None,)], "f string")
    assert [r[0] for r in df.select(base_form(F.col("f"))).collect()] == ["10-K", "10-Q", "8-K", None]
    d = dt.date
    df = spark.createDataFrame([(d(2021, 2, 1), d(2020, 12, 31), "10-K"), (d(2021, 8, 1), d(2021, 6, 30), "10-Q"), (d(2022, 1, 5), d(2021, 12, 31), "8-K"), (d(2021, 11, 1), None, "10-Q/A")], "filed date, e date, f string")
    year, period = ingest.fiscal_label(F.col("filed"), F.col("e"), F.col("f"))
    assert [tuple(r) for r in df.select(year, period).collect()] == [(2020, "FY"), (2021, "Q2"), (2022, "FY"), (2021, "Q4")]


def test_parallel_arrays(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], [1, 2]), (2, [], [1]), (3, None, [1])], "k int, x array<string>, y array<int>")
    assert sorted(tuple(r) for r in ingest.parallel_rows(df, ["k"], ["x", "y"]).collect()) == [(1, "a", 1), (1, "b", 2)]
    pages = ingest.concat_pages([df.select("k"), spark.createDataFrame([(9, "z")], "k int, w string")])
    assert sorted(tuple(r) for r in pages.collect()) == [(1, None), (2, None), (3, None), (9, "z")]


def test_dates_and_documents(spark):
    df = spark.createDataFrame([("2020-01-02",), ("",), (None,), ("soon",)], "t string")
    assert [r[0] for r in df.select(ingest.parsed_date(F.col("t"))).collect()] == [dt.date(2020, 1, 2), dt.date(1, 1, 1), dt.date(1, 1, 1), None]
    docs = spark.createDataFrame([([("a.pdf", "10-K"), ("b.htm", "EX"), ("c.HTML", "10-K")], "10-K"), ([("b.htm", "EX")], "10-K"), ([], "10-K")], "d array<struct<name:string,type:string>>, f string")
    assert [r[0] for r in docs.select(ingest.primary_document(F.col("d"), F.col("f"))).collect()] == ["c.HTML", "b.htm", None]


def test_nested_facts(spark):
    entry = {"end": "2020-12-31", "start": "2020-01-01", "val": 5, "accn": "a", "fy": 2020, "fp": "FY", "form": "10-K/A", "filed": "2021-01-01"}
    body = {"us-gaap": {"Revenues": {"units": {"USD": [entry, entry | {"form": "8-K"}, entry | {"fy": 1999}], "EUR": [entry]}}, "Unheard": {"units": {"USD": [entry]}}}, "dei": {"Revenues": {"units": {"USD": [entry]}}}}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "no json"), (3, None)], "cik int, j string")
    rows = ingest.flatten_facts(df, "j", ["cik"], tag_table(spark), [2020]).collect()
    assert [(r.cik, r.canonical_concept, r.unit, r.form, float(r.val)) for r in rows] == [(1, "revenue", "USD", "10-K", 5.0)]
    assert ingest.unmapped_tags(spark.createDataFrame([("Odd",), ("Odd",), ("Assets",), (None,)], "concept string"), tag_table(spark)).collect() == [("Odd", 2)]


def test_insert_ignore(spark):
    schema = "a int, b string, v int"
    target = spark.createDataFrame([(1, "x", 0), (2, None, 0)], schema)
    new = spark.createDataFrame([(1, "x", 5), (3, "y", 7), (3, "y", 6), (2, None, 1), (2, None, 1)], schema)
    assert sorted(ingest.insert_ignore(target, new, ["a", "b"]).collect(), key=str) == [(2, None, 1), (2, None, 1), (3, "y", 6)]
    assert sorted(ingest.insert_ignore(target, new, ["a", "b"], nulls_distinct=False).collect(), key=str) == [(3, "y", 6)]
    assert ingest.insert_ignore(None, new, ["a", "b"], nulls_distinct=False).count() == 3


def test_lookups(spark):
    filings = spark.createDataFrame([("11111111-1111-1111-1111-111111111111", "1-2"), ("22222222-2222-2222-2222-222222222222", "12")], "id string, acc string")
    refs = spark.createDataFrame([("11111111-1111-1111-1111-111111111111",), ("1 2",), ("zz",), (None,)], "ref string")
    got = {r.ref: r.filing_id for r in ingest.lookup_by_id_or_accession(refs, "ref", filings, F.regexp_replace("acc", "-", "")).collect()}
    assert {k: v and v[0] for k, v in got.items()} == {"11111111-1111-1111-1111-111111111111": "1", "1 2": "1", "zz": None, None: None}
    latest = ingest.latest_per_key(spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "c")], "k int, t int, v string"), ["k"], ["t", "v"])
    assert latest.collect() == [(1, 7, "c")]
    assert ingest.missing_children(filings.select("id"), "id", spark.createDataFrame([("11111111-1111-1111-1111-111111111111",)], "f string"), "f").count() == 1


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, section string")
    assert where(df, n=[]).count() == 3 and where(df, n=2).count() == 1 and where(df, n=[1, 3], section="a").count() == 1
    assert where(df, push_section=False, n=[1, 3], section="a").count() == 2
    assert unknown_values(["x", "y", "x"], ["y"]) == ["x"]
    assert spark.createDataFrame([(" a, b,,",)], "t string").select(split_list(F.col("t"))).first()[0] == ["A", "B"]


def test_series(spark):
    v = spark.createDataFrame([(1, 2019, 10.0), (1, 2020, 15.0), (1, 2022, 30.0), (2, 2020, 4.0)], "cik int, fiscal_year int, value double")
    g = {(r.cik, r.fiscal_year): r.growth_pct for r in facts.growth(v, ["cik"]).collect()}
    assert g == {(1, 2019): None, (1, 2020): 50.0, (1, 2022): None, (2, 2020): None}
    c = {r.cik: (r.years, r.cagr_pct) for r in facts.compound_growth(v, ["cik"]).collect()}
    assert c[1] == (3, round(((30 / 10) ** (1 / 3) - 1) * 100, 6)) and c[2] == (0, None)
    s = {(r.cik, r.fiscal_year): r.scaled for r in facts.scaled_to_unit(v, ["cik"]).collect()}
    assert s == {(1, 2019): 0, (1, 2020): 0.25, (1, 2022): 1}
    shown = spark.createDataFrame([(2.5e12,), (-3e9,), (1.24e6,), (999.0,)], "v double").select(facts.large_number(F.col("v"))).collect()
    assert [r[0] for r in shown] == ["$2.50T", "$-3.00B", "$1.2M", "$999"]
