from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import evaluation as ev
from factloom.operators.quantiles import exact_median, order_statistics


def test_latency(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (100, 200, 300, 400, 1000, 0, -5)], "tier int, latency_ms double")
    r = ev.latency_percentiles(df, ["tier"]).first()
    assert (r.n, r.p50_ms, r.p95_ms, r.mean_ms) == (5, 300, 1000, 400)


def test_order_statistics(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.choice([rnd.randrange(10), rnd.randrange(5000)])) for k in ("a", "b", None) for _ in range(700)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {r.k: r for r in order_statistics(df, ["k"], "v", {"first": F.lit(0), "mid": F.floor(F.col("n") * 0.5), "last": F.lit(10**9)}).collect()}
    for k in ("a", "b", None):
        v = sorted(x for kk, x in rows if kk == k)
        assert (got[k].n, got[k].first, got[k].mid, got[k]["last"]) == (len(v), v[0], v[len(v) // 2], v[-1])
    assert set(got) == {"a", "b", None}
    assert exact_median(df.where("k = 'a'").limit(0), ["k"], "v").count() == 0


@pytest.mark.parametrize("pairs, want", [([(1, 1), (2, 2), (0, 0)], 1.0), ([(0, 1), (0, 1)], 0.0), ([(2, 2), (2, 2)], 1.0)])
def test_kappa(spark, pairs, want):
    df = spark.createDataFrame(pairs, "a int, b int")
    assert ev.cohens_kappa(df, "a", "b", (0, 1, 2, 3)).first().kappa == pytest.approx(want)


def test_kappa_outside_and_empty(spark):
    df = spark.createDataFrame([(-1, -1), (1, 1), (0, 1), (None, 1)], "a int, b int")
    r = ev.cohens_kappa(df, "a", "b", (0, 1)).first()
    assert (r.n, r.p_o) == (3, pytest.approx(2 / 3)) and r.p_e == pytest.approx(2 / 9)
    assert ev.cohens_kappa(df.limit(0), "a", "b", (0, 1)).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([(0.9,), (0.6,), (0.41,), (0.2,), (0.0,), (-0.1,)], "k double")
    assert [r[0] for r in df.select(ev.agreement_label(F.col("k"))).collect()] == ["almost perfect", "substantial", "moderate", "fair", "slight", "poor"]


def test_failure_modes(spark):
    cols = "has boolean, err array<string>, m boolean, gold boolean, nn int, nc int, tools array<string>"
    rows = [
        (False, [], None, True, 0, 0, []), (True, ["x"], None, True, 0, 0, []), (True, [], True, True, 1, 1, []), (True, [], False, True, 1, 1, []), (True, [], False, True, 0, 1, ["xbrl_sql"]),
        (True, [], False, True, 1, 1, ["xbrl_sql", "calculator"]), (True, [], False, True, 1, 1, ["xbrl_sql"]), (True, [], None, False, 0, 0, ["filing_retriever"]),
        (True, [], None, False, 0, 2, ["filing_retriever"]), (True, [], None, False, 0, 1, []), (True, [], None, False, 0, 1, ["calculator"]),
    ]
    df = spark.createDataFrame(rows, cols)
    c = F.col
    got = [r[0] for r in df.select(ev.classify_failure(c("has"), c("err"), c("m"), c("gold"), c("nn"), c("nc"), c("tools"))).collect()]
    assert got == ["planning_failure", "tool_error", "correct", "table_parsing_error", "hallucination", "arithmetic_error", "hallucination", "hallucination", "correct", "planning_failure", "retrieval_miss"]


def test_summaries(spark):
    df = spark.createDataFrame([(1, True, 1.0, "correct"), (1, False, 0.25, "hallucination"), (2, None, None, "correct")], "tier int, numerical_match boolean, faithfulness double, failure_mode string")
    rows = {r.tier: r for r in ev.overall_rollup(df).collect()}
    assert rows[1].accuracy == 0.5 and rows[1].faithfulness == 0.625 and rows[2].accuracy == 0 and rows[None].n == 3
    h = {(r.tier, r.failure_mode): (r.n, r.pct) for r in ev.failure_histogram(df, ["tier"]).collect()}
    assert h[1, "correct"] == (1, 50.0) and h[2, "tool_error"] == (0, 0.0) and len(h) == 2 * len(ev.MODES)
