from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import presentation as show
from factloom.operators import vectors
from factloom.operators.documents import html_to_text
from factloom.plans.ablation import STEPS, clamp_score
from factloom.sources import files, sinks


def test_files(spark, tmp_path):
    (tmp_path / "a.htm").write_text("<p>One</p>")
    (tmp_path / "b.json").write_text('{"us-gaap": {}}')
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps({"id": str(i), "tier": i % 4 + 1, "question": "q"}) for i in range(5)) + "\n")
    row = files.raw_files(spark, str(tmp_path)).select("sha256", html_to_text("text").alias("t")).first()
    assert row.t == "One" and len(row.sha256) == 64
    assert files.json_documents(spark, str(tmp_path / "b.json")).first().json == '{"us-gaap": {}}'
    assert files.json_lines(spark, str(tmp_path / "q.jsonl"), files.QUESTIONS).count() == 5
    assert [r.id for r in files.json_lines(spark, str(tmp_path / "q.jsonl"), files.QUESTIONS, first=2).collect()] == ["0", "1"]
    assert files.raw_stream(spark, str(tmp_path)).isStreaming
    spark.range(3).write.orc(str(tmp_path / "o"))
    assert files.read_any(spark, str(tmp_path / "o"), "orc").count() == 3


def test_upsert_and_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    sinks.upsert(rows((1, "a"), (2, "b"), (2, "c"), (None, "n")), path, ["k"])
    sinks.upsert(rows((2, "z"), (3, "d"), (None, "m")), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=str) == [(1, "a"), (2, "z"), (3, "d"), (None, "m")]
    sinks.replace_atomically(spark.read.parquet(path).where("k = 1"), path)
    assert spark.read.parquet(path).count() == 1 and [p.name for p in tmp_path.iterdir()] == ["t"]
    assert sinks.pending(rows((1, "a"), (9, "b")), spark.read.parquet(path), ["k"]).collect() == [(9, "b")]
    sinks.write_json_lines(rows((1, "a")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_tables(spark):
    sinks.ensure_table(spark, "made_here", "a int, b string")
    sinks.ensure_table(spark, "made_here", "a int, b string")
    assert spark.table("made_here").columns == ["a", "b"]
    spark.sql("DROP TABLE made_here")
    with pytest.raises(ValueError):
        sinks.ensure_table(spark, "x; DROP", "a int")


def test_report():
    text = sinks.with_section("# T\n\n## A\n\nold\n\n## B\n\nkeep\n", "A", "new")
    assert "old" not in text and "## A\n\nnew\n" in text and "keep" in text
    assert sinks.with_section(text, "C", "c").endswith("## C\n\nc\n")


def test_presentation(spark):
    kind = "c array<struct<text:string,is_numeric:boolean,citations:array<string>>>, t string"
    df = spark.createDataFrame([([("a", True, ["x", "y"]), ("b", True, []), ("c", False, ["z"]), ("d", True, ["x"])], "| A | B |\n|---|---|\n| 1 |\n| 2 | 3 | 4 |\nno")], kind)
    r = df.select(show.distinct_citations(F.col("c")).alias("d"), show.cited_lines(F.col("c")).alias("l"), show.table_cells(F.col("t")).alias("t"), show.first_of(F.col("c"), 1).alias("f")).first()
    assert r.d == ["x", "y"] and r.l == "[1.1] x\n[1.2] y\n[2.1] x" and r.t == [["A", "B"], ["1", ""], ["2", "3"]] and len(r.f) == 1


def test_embed_and_scores(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, None)], "id int, t string")
    got = {r.id: r.embedding for r in vectors.embed(df, "id", "t", lambda texts: [[float(len(x)), 0.0] for x in texts], batch=1).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 0.0]}
    s = spark.createDataFrame([(5, True), (-2, True), (2, True), (1, False)], "s int, g boolean")
    assert [r[0] for r in s.select(clamp_score(F.col("s"), F.col("g"))).collect()] == [3, 0, 2, -1]
    assert len(STEPS) == 5
