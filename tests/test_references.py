from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from factloom.functions.keys import accession_key, cik_key
from factloom.operators.references import Child, Parent, orphan_counts, orphan_references

T0, T1, T2 = dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2), dt.datetime(2020, 1, 3)


def run(spark, children, parents, deleted, op=orphan_references):
    c = spark.createDataFrame(children, "id string, acc string, at timestamp_ntz, key string, parent string")
    p = spark.createDataFrame(parents, "acc string, at timestamp_ntz, since string")
    d = spark.createDataFrame(deleted, "parent string, key string").withColumn("key", accession_key(F.col("key")))
    child = Child("facts", "acc", "acc", c, F.col("id"), accession_key(F.col("acc")), F.col("at"), (F.lit(2020), F.lit("Q1")))
    return op([Parent("acc", p, accession_key(F.col("acc")), F.col("at"))], [child], d)


def states(df):
    return sorted((r.record_id, r.ref_state) for r in df.collect())


def test_states_and_spellings(spark):
    children = [("a", "1-2 3", T1, "x", "y"), ("b", "12-9", T1, "x", "y"), ("c", "777", T1, "x", "y"), ("d", " ", T1, "x", "y"), ("e", None, T1, "x", "y"), ("f", "123", T0, "x", "y"), ("g", "123", None, "x", "y"), ("h", "55", T0, "x", "y")]
    parents = [("123", T2, "s"), ("1-23", T1, "s"), (None, T0, "s"), ("", T0, "s"), ("55", None, "s")]
    assert states(run(spark, children, parents, [("acc", "1-29"), ("acc", "123")])) == [("b", "deleted"), ("c", "missing"), ("f", "late")]


def test_repeated_records_and_hot_key(spark):
    children = [(f"r{i}", "hot", T1, "x", "y") for i in range(500)] + [("r0", "hot", T1, "x", "y")]
    rows = run(spark, children, [("cold", T0, "s")], [])
    assert rows.count() == 501
    counted = run(spark, children, [("cold", T0, "s")], [], orphan_counts).collect()
    assert [(r.fiscal_year, r.fiscal_period, r.ref_state, r.n_records, r.n_keys) for r in counted] == [(2020, "Q1", "missing", 501, 1)]


def test_empty_tables(spark):
    assert states(run(spark, [], [], [])) == []
    assert states(run(spark, [], [("1", T0, "s")], [("acc", "2")])) == []


def test_cik_spellings(spark):
    df = spark.createDataFrame([("0001002",), ("1002",), ("0",), (" ",), (None,)], "k string")
    assert [r[0] for r in df.select(cik_key(F.col("k"))).collect()] == ["1002", "1002", "0", None, None]
