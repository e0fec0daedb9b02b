from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from factloom.streaming import events as st


def test_event_lines(spark):
    df = spark.createDataFrame([("plan", {"a": "1"}, "t", 0, 1.0), ("done", {}, "t", 0, 2.0), ("plan", {}, "t", 0, 3.0), ("odd", {}, "t", 0, 1.5)], st.EVENT)
    line = st.event_line(*[F.col(c) for c in ("type", "data", "trace_id", "iteration", "timestamp")])
    lines = df.select(F.trim(line, F.lit("\n")).alias("value")).unionByName(spark.createDataFrame([("data: {broken",), (": ping",), (None,)], "value string"))
    parsed = st.parse_event_lines(lines)
    assert parsed.count() == 3
    assert sorted(r.timestamp for r in st.until_done(parsed).collect()) == [1.0, 2.0]


def test_ingest_is_repeatable(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = "k string, v int"
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], schema).coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    st.ingest_new(stream(), ["k"], out, state)
    st.ingest_new(stream(), ["k"], out, state)
    spark.createDataFrame([("b", 9), ("c", 4)], schema).coalesce(1).write.mode("append").parquet(src)
    st.ingest_new(stream(), ["k"], out, state)
    st.ingest_new(stream(), ["k"], out, str(tmp_path / "fresh-state"))
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 3), ("c", 4)]


def test_windows_as_batch(spark):
    t = dt.datetime(2024, 1, 1, 10, 30)
    df = spark.createDataFrame([(t, "a", 1.0), (t + dt.timedelta(minutes=20), "a", 2.0), (t + dt.timedelta(hours=1), "a", 4.0)], "ts timestamp_ntz, k string, value double")
    assert sorted((r.n, r.total) for r in st.windowed_counts(df, "ts", ["k"]).collect()) == [(1, 4.0), (2, 3.0)]
