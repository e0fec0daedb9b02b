from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import calc

L = F.lit


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_known_values(spark):
    assert one(spark, calc.yoy_growth(L(96.9), L(60.9))) == pytest.approx(59.1133, abs=0.01)
    assert one(spark, calc.yoy_growth(L(40.0), L(100.0))) == pytest.approx(-60)
    assert one(spark, calc.yoy_growth(L(-50.0), L(-100.0))) == pytest.approx(-50)
    assert one(spark, calc.cagr(L(100), L(144), L(2))) == pytest.approx(20)
    assert one(spark, calc.cagr(L(100), L(200), L(4))) == pytest.approx(18.9207, abs=0.001)
    assert one(spark, calc.margin(L(25), L(200))) == 12.5
    for bad in (calc.ratio(L(1), L(0)), calc.cagr(L(-1), L(2), L(1)), calc.cagr(L(1), L(2), L(0)), calc.yoy_growth(L(1), L(0))):
        assert one(spark, bad) is None
    with pytest.raises(Exception, match="division by zero"):
        one(spark, calc.ratio(L(1), L(0), strict=True))


def test_lists(spark):
    v = F.array(L(4.0), L(1.0), L(3.0), L(2.0))
    assert [one(spark, calc.list_operation(n, v)) for n in ("sum", "mean", "median", "min", "max")] == [10, 2.5, 2.5, 1, 4]
    assert one(spark, calc.list_operation("median", F.array().cast("array<double>"))) is None


def test_shown(spark):
    assert one(spark, calc.shown("margin", L(12.5))) == "12.5000%"
    assert one(spark, calc.shown("ratio", L(0.5))) == "0.500000"


@pytest.mark.parametrize("text, want", [("2 + 3 * 4", 14), ("(2 + 3) * 4", 20), ("7 % -3", -2), ("-7 // 2", -4), ("2 ** 3 ** 2", 512), ("1 / 0", None), ("-3 - -2", -1), ("5 % 0", None), ("(-8) ** 0.5", None)])
def test_expressions(spark, text, want):
    assert one(spark, calc.expression(text)) == want


@pytest.mark.parametrize("text", ["abs(1)", "x", "1 < 2", "True", "'a'", "__import__('os')", "1; 2", "", "[1]"])
def test_refused(spark, text):
    with pytest.raises(ValueError):
        calc.expression(text)


@settings(max_examples=25, deadline=None)
@given(st.integers(-50, 50), st.integers(-9, 9).filter(bool), st.sampled_from(["+", "-", "*", "/", "//", "%"]))
def test_like_python(spark, a, b, op):
    assert one(spark, calc.expression(f"({a}) {op} ({b})")) == pytest.approx(eval(f"{a} {op} ({b})"))  # noqa: S307


def test_formulas(spark):
    df = spark.createDataFrame([(110.0, 100.0, 2, [1.0, 2.0])], "a double, b double, n int, v array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(
        calc.formula("yoy_growth", [a, b], calc.yoy_growth(a, b)), calc.formula("subtract", [a, b], a - b), calc.formula("ratio", [a, b], a / b),
        calc.formula("cagr", [b, a, F.col("n")], F.lit(4.8809)), calc.formula("sum", [F.col("v")], F.lit(3.0)),
    ).first()
    assert tuple(got) == ("(110.0 - 100.0) / 100.0 * 100 = 10.0000%", "110.0 - 100.0 = 10.0", "110.0 / 100.0 = 1.100000", "(((110.0 / 100.0) ^ (1 / 2)) - 1) * 100 = 4.8809%", "sum([1.0, 2.0]) = 3.0")
