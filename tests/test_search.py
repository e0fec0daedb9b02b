from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import search, vectors


def ranked(spark, rows):
    return spark.createDataFrame([(1, d, i) for i, d in enumerate(rows, 1)], "query int, doc string, rank int")


def test_fusion(spark):
    rows = {r.doc: r for r in search.fuse([ranked(spark, ["a", "b"]), ranked(spark, ["a", "c"])], ["bm25", "dense"]).collect()}
    assert rows["a"].rrf_score == pytest.approx(2 / 61) and rows["a"].rank == 1
    assert rows["b"].rank == 2 and rows["c"].rank == 3 and rows["c"].bm25_rank is None and rows["c"].dense_rank == 2


def test_match_all_and_bm25(spark):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "red red"), (3, None), (4, "")], "id int, t string")
    posts = search.postings(docs, "id", "t")
    terms = search.query_terms(spark.createDataFrame([(7, "The red green"), (8, "blue")], "q int, t string"), "q", "t")
    assert sorted(tuple(r) for r in search.match_all(posts, terms).collect()) == [(7, 1), (8, 1)]
    best = search.top_k(search.bm25(posts, terms), 1).collect()
    assert sorted((r.query, r.doc) for r in best) == [(7, 1), (8, 1)]


def test_cover_density(spark):
    docs = spark.createDataFrame([(1, "alpha beta gap alpha"), (2, "alpha x x x beta"), (3, "alpha only")], "id int, t string")
    posts = search.postings(docs, "id", "t", positions=True)
    terms = search.query_terms(spark.createDataFrame([(1, "alpha beta")], "q int, t string"), "q", "t")
    got = {r.doc: r.score for r in search.cover_density(posts, terms).collect()}
    assert got == pytest.approx({1: 1 / 2 + 1 / 3, 2: 1 / 5})


def test_nearest_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROW_BLOCK", 40)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    rnd = random.Random(2)
    data = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [(999, None), (None, [0.0] * 8)]
    rows = spark.createDataFrame(data, "vec_id int, embedding array<double>")
    got = vectors.nearest(rows.where("vec_id % 20 = 0"), rows, 5).collect()
    m = np.asarray([v for i, v in data[:200]])
    for q in range(0, 200, 20):
        want = sorted(range(200), key=lambda i: (-float(m[q] @ m[i]), i))[:5]
        assert [r.doc for r in sorted((r for r in got if r.query == q), key=lambda r: r.rank)] == want


def recall(found, exact):
    want = {(r.query, r.doc) for r in exact.collect()}
    return len({(r.query, r.doc) for r in found.collect()} & want) / len(want)


def test_index_finds_what_is_near(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROW_BLOCK", 50)
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(12, 16)) * 3
    data = [(i, (centres[0 if i % 3 == 0 else i % 12] + rnd.normal(size=16)).tolist()) for i in range(900)] + [(9999, None), (None, [0.0] * 16)]
    rows = spark.createDataFrame(data, "vec_id int, embedding array<double>").select("vec_id", vectors.unit(F.col("embedding")).alias("embedding"))
    queries, index = rows.where("vec_id % 50 = 0"), vectors.build_index(rows, 16)
    assert index.rows.count() == 900 and index.rows.agg(F.max("part")).first()[0] > 0
    exact = vectors.nearest(queries, rows, 10)
    assert recall(vectors.nearest_indexed(queries, index, 10, 4), exact) >= 0.9
    assert recall(vectors.nearest_indexed(queries, index, 10, 16), exact) == 1
    none = vectors.build_index(rows.limit(0))
    assert none.rows.count() == 0 and vectors.nearest_indexed(queries, none, 3).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_index_on_the_test_vectors(spark):
    from factloom.queries.search import vector_topk, vector_topk_indexed

    exact, found = ({(r.query_id, r.vec_id) for r in f(spark, "/root/testdata/sf0.01").collect()} for f in (vector_topk, vector_topk_indexed))
    assert len(exact & found) >= 0.9 * len(exact)


def test_stems_and_filters(spark):
    words = ["companies", "series", "losses", "taxes", "gas", "status", "boss", "horses", "movies"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(search.stem(F.col("w"))).collect()] == ["company", "sery", "losse", "taxe", "gas", "status", "boss", "horse", "movy"]
    chunks = spark.createDataFrame([("a", "f1", "Item 1", 5, 1), ("a", "f1", "Item 1", 7, 1), ("b", "f2", "Item 2", 1, 1), ("c", "f9", "Item 1", 1, 1)], "id string, filing_id string, section string, char_offset_start int, created_at int")
    filings = spark.createDataFrame([("f1", 1, 2020, "10-K"), ("f2", 2, 2021, "10-Q")], "id string, cik long, fiscal_year int, form string")
    companies = spark.createDataFrame([(1, "AAA"), (2, "BBB")], "cik long, ticker string")
    of = lambda **f: sorted((r.id, r.ticker, r.char_offset_start) for r in search.chunk_directory(chunks, filings, companies, **f).collect())
    assert of() == [("a", "AAA", 7), ("b", "BBB", 1)] and of(ticker="BBB") == [("b", "BBB", 1)] and of(form=["10-K"], section="Item 2") == []


def test_terms_are_dropped_at_the_text(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "red red dot"), (3, None), (4, "")], "id int, t string")
    queries = spark.createDataFrame([(7, "The red green"), (8, "blue")], "q int, t string")
    want = sorted((r.query, r.doc, round(r.score, 9)) for r in search.bm25(search.postings(docs, "id", "t"), search.query_terms(queries, "q", "t")).collect())
    for most in (100, 0):
        monkeypatch.setattr(search, "BROADCAST_TERMS", most)
        assert sorted((r.query, r.doc, r.score) for r in search.search(docs, queries, "id", "t", "q", "t", 5).collect()) == want


def test_unit_and_dot(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.unit(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_rerank(spark):
    df = spark.createDataFrame([(1, "a", 0.2), (1, "b", None), (1, "c", 0.9)], "query int, doc string, s double")
    assert [(r.doc, r.rank) for r in search.rerank(df, F.col("s"), 2).orderBy("rank").collect()] == [("c", 1), ("a", 2)]
