from __future__ import annotations

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from factloom.llm.survivors import best_representatives

SCHEMA = "k string, id string, value double, at timestamp_ntz, tag string, unit string, grp string, field string, state string"
FIELDS = ("tag", "unit")


def day(n):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


def run(spark, rows):
    df = spark.createDataFrame([(*r[:2], None if r[2] is None else float(r[2]), *r[3:], "x", "y", "z") for r in rows], SCHEMA)
    out, precedence = best_representatives(df, [F.col("k")], "id", "value", "at", FIELDS, FIELDS, [F.col("k")])
    return {r.k: r for r in out.collect()}, sorted((r.field, r.before, r.after, r.support, r.against) for r in precedence.collect())


def test_order_of_preference(spark):
    rows = [
        ("null", "a", None, day(9), "t", "u"), ("null", "b", 1, day(1), None, None),
        ("full", "a", 1, day(9), None, "u"), ("full", "b", 2, day(1), "t", "u"),
        ("new", "a", 1, day(1), "t", "u"), ("new", "b", 2, day(2), "t", "u"),
        ("tie", "b", 1, day(1), "t", "u"), ("tie", "a", 2, day(1), "t", "u"),
        ("one", "a", 1, day(1), "t", "u"),
    ]
    got, _ = run(spark, rows)
    assert {k: r.survivor_id for k, r in got.items()} == {"null": "b", "full": "b", "new": "b", "tie": "a"}
    assert (got["null"].tag, got["null"].val) == ("t", 1) and got["full"].val == 1 and got["full"].tag == "t" and got["full"].n_records == 2


def test_precedence_is_learned_by_majority(spark):
    rows = []
    for i in range(5):
        old, new = ("A", "B") if i else ("B", "A")
        rows += [(f"g{i}", f"{i}a", 1, day(1), old, "u"), (f"g{i}", f"{i}b", 1, day(2), new, "u")]
    _, precedence = run(spark, rows)
    assert precedence == [(0, "A", "B", 4, 1)]


def learned(n=3):
    return [(f"l{i}", f"l{i}{v}", 1, day(j), v, "u") for i in range(n) for j, v in enumerate("ABC")]


def test_missing_times(spark):
    rows = learned() + [
        ("after", "1", 1, day(5), "B", "u"), ("after", "2", 2, None, "C", "u"),  # C is known to follow B
        ("before", "1", 1, day(5), "B", "u"), ("before", "2", 2, None, "A", "u"),  # A comes before B
        ("same", "9", 1, day(5), "B", "u"), ("same", "3", 2, None, "B", "u"),  # shares B's time; least id
        ("none", "1", 1, None, "A", "u"), ("none", "2", 2, None, "C", "u"), ("none", "3", 3, None, "B", "u"),  # topologically latest
        ("blank", "2", 1, None, None, None), ("blank", "1", 1, None, None, None),  # nothing known; least id
    ]
    got, _ = run(spark, rows)
    assert {k: got[k].survivor_id for k in ("after", "before", "same", "none", "blank")} == {"after": "2", "before": "1", "same": "3", "none": "2", "blank": "1"}
    assert got["none"].tag == "C" and got["after"].val == 2


def test_cycle_does_not_hang(spark):
    rows = [(f"{a}{b}", f"{a}{b}{i}", 1, day(i), x, "u") for a, b in ("AB", "BC", "CA") for i, x in enumerate((a, b))]
    rows += [("cycle", str(i), 1, None, x, "u") for i, x in enumerate("CAB")]
    assert run(spark, rows)[0]["cycle"].survivor_id == "0"


def test_hot_group_repeated_rows_and_empty(spark):
    rows = [("hot", f"{i:04d}", i, day(i % 700), "t", "u") for i in range(1500)] + [("hot", "0699", 699, day(699), "t", "u")]
    got, _ = run(spark, rows)
    assert got["hot"].survivor_id == "0699" and got["hot"].n_records == 1501
    assert run(spark, []) == ({}, [])


def test_returning_values_are_steps(spark):
    hours = [dt.datetime(2020, 1, 1, h, m) for h, m in ((1, 0), (1, 30), (1, 45), (3, 0), (9, 0), (9, 1))]
    rows = [("g", str(i), 1, at, v, "u") for i, (at, v) in enumerate(zip(hours, "ABAABA"))]  # A-B, B-A, A-B, B-A within hours and across them
    rows += [("h", str(i), 1, day(i), v, "u") for i, v in enumerate("CDC")] + [("i", str(i), 1, day(i), v, "u") for i, v in enumerate("CD")]
    assert run(spark, rows)[1] == [(0, "C", "D", 2, 1)]


def test_steps_from_every_value_of_a_time(spark):
    rows = [("g", "1", 1, day(1), "A", "u"), ("g", "2", 1, day(1), "B", "u"), ("g", "3", 1, day(2), "A", "u"), ("g", "4", 1, day(2), "C", "u")]
    assert run(spark, rows)[1] == [(0, "A", "C", 1, 0), (0, "B", "A", 1, 0), (0, "B", "C", 1, 0)]


def test_steps_against_a_loop(spark):
    rnd = random.Random(5)
    rows = [(f"g{rnd.randrange(6)}", f"{i:04d}", 1, dt.datetime(2020, 1, 1) + dt.timedelta(minutes=20 * rnd.randrange(90)), rnd.choice(["A", "B", "C", None]), rnd.choice("uv")) for i in range(300)]
    count = Counter()
    for g in {r[0] for r in rows}:
        for f in (0, 1):
            at = {}
            for r in rows:
                if r[0] == g and r[4 + f] is not None:
                    at.setdefault(r[3], set()).add(r[4 + f])
            times = sorted(at)
            count.update((f, a, b) for s, t in zip(times, times[1:]) for a in at[s] for b in at[t] if a != b)
    assert run(spark, rows)[1] == sorted((f, a, b, n, count[f, b, a]) for (f, a, b), n in count.items() if n > count[f, b, a])


def order(prefix, *values, tag=True, n=3):
    """Groups that teach an order of the values of one field."""
    return [(f"{prefix}{i}", f"{prefix}{i}{v}", 1, day(j), v if tag else "t", "u" if tag else v) for i in range(n) for j, v in enumerate(values)]


def test_order_is_closed_transitively(spark):
    rows = order("a", "P", "Q") + order("b", "Q", "R") + order("c", "R", "S")
    rows += [
        ("gap", "1", 1, None, "P", "u"), ("gap", "2", 2, None, "R", "u"),  # Q lies between but isn't there
        ("far", "1", 1, None, "P", "u"), ("far", "2", 2, None, "S", "u"),
        ("mixed", "1", 1, day(4), "Q", "u"), ("mixed", "2", 2, None, "S", "u"), ("mixed", "3", 3, None, "R", "u"), ("mixed", "4", 4, None, "P", "u"),
        ("newer", "1", 1, day(4), "S", "u"), ("newer", "2", 2, None, "P", "u"),
        ("chain", "1", 1, day(4), "P", "u"), ("chain", "2", 2, day(6), "Q", "u"), ("chain", "3", 3, None, "R", "u"),
    ]
    got, _ = run(spark, rows)
    assert {k: got[k].survivor_id for k in ("gap", "far", "mixed", "newer", "chain")} == {"gap": "2", "far": "2", "mixed": "2", "newer": "1", "chain": "3"}
    assert got["mixed"].tag == "S" and got["newer"].tag == "S"


def test_each_field_by_its_own_order(spark):
    rows = order("a", "A", "B") + order("b", "Y", "X", tag=False)
    rows += [("both", "1", 1, None, "A", "X"), ("both", "2", 2, None, "B", "Y")]
    rows += [("older", "1", 1, day(3), "B", "X"), ("older", "0", 2, None, "A", "X")]  # shares the unit, but its tag is known to be older
    rows += [("null", "1", 1, day(3), "B", "Y"), ("null", "2", 2, None, None, "X")]
    got, _ = run(spark, rows)
    assert (got["both"].tag, got["both"].unit) == ("B", "X")
    assert got["older"].survivor_id == "1" and got["older"].tag == "B"
    assert (got["null"].tag, got["null"].unit) == ("B", "X")


def test_unrelated_values_and_part_cycles(spark):
    rows = order("a", "A", "B") + order("b", "B", "C") + order("c", "C", "A") + order("d", "C", "D")
    rows += [("out", "1", 1, None, "A", "u"), ("out", "2", 2, None, "D", "u")]  # D follows the cycle
    rows += [("new", "2", 1, day(2), "A", "u"), ("new", "1", 2, None, "Z", "u")]  # nothing is known of Z; the unit is shared
    got, _ = run(spark, rows)
    assert got["out"].survivor_id == "2" and got["new"].tag == "A" and got["new"].survivor_id == "1"
