from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.functions.numbers import extract_numbers, match_number, unsigned_values
from factloom.operators import verification as vf


@pytest.fixture(scope="module")
def numbers_in(spark):
    return lambda text: spark.createDataFrame([(text,)], "t string").select(extract_numbers("t")).first()[0]


@pytest.mark.parametrize("text, want", [("$96.995 billion", 96.995e9), ("$(96.9) million", -96.9e6), ("25%", 25), (".25", 0.25), ("1,234.56", 1234.56), ("3 Tesla", 3e12), ("4 min", 4e6), ("12 bn", 12e9)])
def test_values(numbers_in, text, want):
    assert numbers_in(text)[0]["value"] == pytest.approx(want)


def test_flags(numbers_in):
    assert numbers_in("25%")[0]["is_percent"] and numbers_in("(5) and 6")[0]["is_negative"] and not numbers_in("(5 and 6)")[1]["is_negative"]
    assert numbers_in(None) == [] and numbers_in("none") == []


def test_brackets(numbers_in):
    signs = lambda t: [n["value"] for n in numbers_in(t)]
    assert signs("(1,234.5) and ($ 12) and (abc 7) and ( abc 8)") == [-1234.5, -12, -7, 8]
    assert signs("loss (12.5)\u00a0million, 3 %") == [-12.5e6, 3] and signs("(12.34.5) (1") == [12.34, 0.5, 1]
    assert numbers_in("net (4) bn ")[0]["raw"] == "4) bn" and numbers_in("5 % of")[0]["is_percent"]


def test_native(spark, numbers_in):
    text = "Sales of $1,234.5 million, (7) thousand and 12% or .5bn"
    got = spark.createDataFrame([(text,)], "t string").select(unsigned_values(F.col("t"))).first()[0]
    assert got == pytest.approx([abs(n["value"]) for n in numbers_in(text)])


@pytest.mark.parametrize(
    "target, values, tolerance, want",
    [(100, [100.4], 0.5, (True, 100.4)), (100, [105.0], 0.5, (False, 105.0)), (0, [1.0, 0.0], 0.5, (True, 0.0)), (0, [1.0], 0.5, (False, None)), (99, [50.0, 100.0, 150.0], 2, (True, 100.0)), (5, [], 0.5, (False, None))],
)
def test_match(spark, target, values, tolerance, want):
    df = spark.createDataFrame([(float(target), values)], "t double, v array<double>")
    m = df.select(match_number(F.col("t"), F.col("v"), tolerance).alias("m")).first().m
    assert (m.matched, m.value) == want


def test_verdicts(spark):
    rows = [
        ("exact", True, 5e6, "about 5 million", None), ("near", True, 100.0, "it was 100.4", None), ("off", True, 100.0, "it was 105", None), ("novalue", True, None, "x", None),
        ("gone", True, 1.0, None, "filing_missing"), ("prose", False, None, "same", None),
    ]
    df = spark.createDataFrame(rows, "id string, is_numeric boolean, numeric_value double, cited_text string, problem string")
    got = {r.id: r.verdict for r in vf.verify_claims(df, F.lit(0.6)).collect()}
    assert {k: v.method for k, v in got.items()} == {"exact": "numeric_exact", "near": "numeric_tolerance", "off": "numeric_mismatch", "novalue": "no_numeric_value", "gone": "filing_missing", "prose": "semantic_similarity"}
    assert got["exact"].confidence == 1 and got["near"].confidence == pytest.approx(0.2) and got["off"].matched_value == 105


def test_faithfulness(spark):
    kind = "c array<struct<text:string,is_numeric:boolean,citations:array<string>>>"
    df = spark.createDataFrame([([("a", True, ["x"]), ("b", True, []), ("c", False, [])],), ([],), ([("c", False, [])],)], kind)
    assert [r[0] for r in df.select(vf.faithfulness(F.col("c"))).collect()] == [0.5, 1.0, 1.0]
    assert df.select(vf.uncited_numeric(F.col("c"))).first()[0] == ["b"]


def test_accuracy(spark):
    df = spark.createDataFrame([(None, [1.0]), (100.0, []), (100.0, [90.0, 100.2]), (0.5, [0.503]), (100.0, [90.0, 95.0])], "g double, v array<double>")
    got = [r[0] for r in df.select(vf.numeric_accuracy(F.col("g"), F.col("v"))).collect()]
    assert [g.matched for g in got] == [None, False, True, True, False] and got[4].error_pct == pytest.approx(5)
