from __future__ import annotations

import datetime as dt
import random

from factloom.operators.intervals import continuous_periods, period_gaps

D = dt.date
SCHEMA = "k string, s date, e date, period_no int, gap_start string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)


def periods(spark, rows):
    return sorted((r.k, r.period_start, r.period_end, r.n_spans) for r in continuous_periods(frame(spark, rows), ["k"], "s", "e").collect())


def gaps(spark, rows):
    return sorted((r.k, r.gap_start, r.gap_end, r.n_days) for r in period_gaps(frame(spark, rows), ["k"], "s", "e").collect())


def test_overlap_nesting_adjoining_and_gap(spark):
    rows = [("a", D(2020, 1, 1), D(2020, 12, 31)), ("a", D(2020, 3, 1), D(2020, 4, 1)), ("a", D(2021, 1, 1), D(2021, 1, 31)), ("a", D(2021, 3, 1), D(2021, 3, 1))]
    assert periods(spark, rows) == [("a", D(2020, 1, 1), D(2021, 1, 31), 3), ("a", D(2021, 3, 1), D(2021, 3, 1), 1)]
    assert gaps(spark, rows) == [("a", D(2021, 2, 1), D(2021, 2, 28), 28)]


def test_nulls_reversed_repeated_and_empty(spark):
    rows = [("a", None, D(2020, 1, 1)), ("a", D(2020, 1, 1), None), (None, D(2020, 1, 1), D(2020, 1, 2)), ("a", D(2020, 2, 2), D(2020, 2, 1))]
    assert periods(spark, rows) == [] and gaps(spark, rows) == []
    twice = [("a", D(2020, 1, 1), D(2020, 1, 5))] * 3
    assert periods(spark, twice) == [("a", D(2020, 1, 1), D(2020, 1, 5), 3)] and gaps(spark, twice) == []
    assert periods(spark, []) == [] and gaps(spark, []) == []


def test_placeholder_days(spark):
    rows = [("a", D(1, 1, 1), D(1, 1, 1)), ("a", D(9999, 12, 30), D(9999, 12, 31))]
    assert gaps(spark, rows) == [("a", D(1, 1, 2), D(9999, 12, 29), (D(9999, 12, 29) - D(1, 1, 2)).days + 1)]


def test_against_day_sets(spark):
    rnd, base, rows = random.Random(5), D(2020, 1, 1), []
    for k in "abc":
        for _ in range(25):
            a = rnd.randrange(300)
            rows.append((k, base + dt.timedelta(a), base + dt.timedelta(a + rnd.randrange(-2, 9))))
    want = []
    for k in "abc":
        days = {(r[1] - base).days + i for r in rows if r[0] == k for i in range((r[2] - r[1]).days + 1)}
        holes = [d for d in range(min(days), max(days)) if d not in days]
        for h in holes:
            if h - 1 not in holes:
                end = h
                while end + 1 in holes:
                    end += 1
                want.append((k, base + dt.timedelta(h), base + dt.timedelta(end), end - h + 1))
    assert gaps(spark, rows) == sorted(want)
