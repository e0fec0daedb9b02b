from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.llm import language as L

SAMPLES = "/root/testdata/sf0.001/lang_samples.parquet"
pytestmark = pytest.mark.skipif(not Path(SAMPLES).exists(), reason="no labelled texts")


@pytest.fixture(scope="module")
def held_out(spark):
    rows = [r.asDict() for r in spark.read.parquet(SAMPLES).orderBy("sample_id").collect()]
    random.Random(1).shuffle(rows)
    fit, rest = rows[: len(rows) // 2], rows[len(rows) // 2 :]
    return L.train(spark.createDataFrame([(r["text"], r["lang"]) for r in fit], "text string, lang string")), rest


def detect(spark, model, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, id string")
    return sorted(L.detect_languages(df, model).collect(), key=lambda r: (r.doc_id, r.seg_no))


def test_held_out_accuracy(spark, held_out):
    model, rest = held_out
    for change in (str, str.upper, lambda t: L._without_accents(t)):
        got = {r.doc_id: r.lang for r in detect(spark, model, [change(r["text"]) for r in rest]) if r.seg_no == 1}
        assert sum(got.get(i) == r["lang"] for i, r in enumerate(rest)) / len(rest) >= 0.97


def sentences(rest, lang, n):
    parts = [s for r in rest if r["lang"] == lang for s in [r["text"][: L.sentence_ends(r["text"])[0]].strip()]]
    return [parts[i % len(parts)] for i in range(n)]


def test_mixed(spark, held_out):
    model, rest = held_out
    de, fr, en, zh = (sentences(rest, x, 6) for x in ("de", "fr", "en", "zh"))
    texts = [
        " ".join(de[:3] + fr[:2] + en[:4]), "\n\n".join(["".join(zh[:3]), " ".join(en[:2])]), " ".join(de[:3] + fr[:1] + de[3:]), " ".join(fr[:4]) + "\n\n$1.2 million | 3,456 | $7.8 million\n\n$3.1 million | 4.2\n\n",
        " ".join(en[:2]) + " The term “Gesellschaft mit beschränkter Haftung” is used. " + " ".join(en[2:]),
    ]
    rows = detect(spark, model, texts)
    by = {i: [r for r in rows if r.doc_id == i] for i in range(len(texts))}
    assert [[r.lang for r in by[i]] for i in by] == [["de", "fr", "en"], ["zh", "en"], ["de"], ["fr"], ["en"]]
    assert [r.n_sentences for r in by[0]] == [3, 2, 4]
    for i, rs in by.items():
        assert rs[0].char_start == 0 and rs[-1].char_end == len(texts[i]) and all(a.char_end == b.char_start for a, b in zip(rs, rs[1:]))
        assert all(0.5 < r.confidence <= 1 for r in rs)


def test_odd_texts(spark, held_out):
    model, rest = held_out
    en = sentences(rest, "en", 1)[0]
    rows = detect(spark, model, [None, "", "12345 67 | 8", "...", en * 4000, "a"])
    assert [(r.doc_id, r.lang) for r in rows] == [(4, "en")]
    assert detect(spark, model, []) == []


def test_labels(spark):
    labels = ["en", "EN", " eng ", "en-US", "English", "pt_BR", "Chinese", "zho", "", " ", "und", "unknown", None, "xx"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert [r[0] for r in df.select(L.canonical_language(F.col("l"))).collect()] == ["en"] * 5 + ["pt", "zh", "zh"] + [None] * 5 + ["xx"]


def test_cases(spark, held_out):
    model, rest = held_out
    en, de = " ".join(sentences(rest, "en", 3)), " ".join(sentences(rest, "de", 3))
    df = spark.createDataFrame([(1, en, "eng"), (2, en, "de"), (3, en, None), (4, f"{en} {de}", "en"), (5, en, "und"), (5, en, "und")], "doc_id int, text string, lang string")
    assert sorted((r.doc_id, r.seg_no, r.lang) for r in L.language_cases(df, model).collect()) == [(2, 1, "en"), (3, 1, "en"), (4, 1, "en"), (4, 2, "de"), (5, 1, "en"), (5, 1, "en")]


def test_no_samples(spark):
    model = L.train(spark.createDataFrame([(None, "en"), ("", "en"), ("x", None)], "text string, lang string"))
    assert model.languages == () and L.detect_languages(spark.createDataFrame([(1, "a text")], "doc_id int, text string"), model).count() == 0


def test_short_texts_and_tables(spark, held_out):
    got = detect(spark, held_out[0], ["Umsatz", "12,400 13,900 | 2021 2022 | net 44", "7 8 9", "公司", None])
    assert [(r.doc_id, r.seg_no, r.n_segments) for r in got] == [(0, 1, 1), (1, 1, 1), (3, 1, 1)]
    assert got[2].lang == "zh" and all(0 < r.confidence <= 1 for r in got)
