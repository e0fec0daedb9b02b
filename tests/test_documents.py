from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.operators import diffs, documents

BODY = "A long enough passage about the business of the company and its markets.\n"


def test_html():
    html = "<html><head><title>x</title></head><body><script>var a='</p>';</script><p>One &amp; two</p>\n\n\n<style>b</style><p>ﬁne  day</p></body></html>"
    assert documents.plain_text(html) == "One & two\n\nfine day"
    assert documents.plain_text(None) is None and documents.plain_text("") == ""


def sections(spark, text, form):
    df = spark.createDataFrame([(1, text, form)], "id int, body string, form string")
    return sorted(documents.detect_sections(df, "id", "body", "form").collect(), key=lambda r: r.char_start)


def test_sections(spark):
    text = f"Cover\nITEM 1. Business\n{BODY}Item 1A - Risk Factors\n{BODY}Item 5. Other\n{BODY}Item 7. Short\nno\n"
    found = sections(spark, text, "10-K/A")
    assert [(s["section"], s["item_label"]) for s in found] == [("Item 1", "Business"), ("Item 1A", "Risk Factors")]
    assert all(text[s["char_start"] : s["char_end"]] == s["text"] for s in found)
    assert found[0].char_start == 5 and found[0].char_end == found[1].char_start
    assert sections(spark, "nothing here", "10-K")[0]["section"] == "Document"
    assert sections(spark, f"Item 5. Other\n{BODY}", "10-K") == []
    eight = sections(spark, f"Item 2.02 Results\n{BODY}", "8-K")
    assert eight[0]["item_label"] == "Results of Operations and Financial Condition"


def test_chunks():
    text = "\n".join(f"line {i} " + "w" * 90 for i in range(200))
    spans = documents.paragraph_chunks(text, 1000, 150)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= 1000 for a, b in spans) and all(x[1] - y[0] >= 150 for x, y in zip(spans, spans[1:]))
    assert documents.paragraph_chunks("x" * 5000, 1000, 150) == [(0, 5000)] and documents.paragraph_chunks("\n\n", 10, 2) == []
    assert documents.paragraph_chunks("a" * 900 + "\n" + "b" * 950, 1000, 150) == [(0, 900), (0, 1851)]


def test_chunks_always_share():
    text = "\n".join(["s" * 300] * 12 + ["x" * 4000] + ["t" * 300] * 3)
    spans = documents.paragraph_chunks(text)
    assert all(x[1] - y[0] >= 200 and x[1] < y[1] for x, y in zip(spans, spans[1:])) and spans[-1][1] == len(text) and len(spans) > 2


def test_section_frames(spark):
    df = spark.createDataFrame([(1, f"Item 1. Business\n{BODY}", "10-K"), (2, None, "10-K"), (3, "", None)], "id int, t string, form string")
    assert sorted((r.id, r.section) for r in documents.detect_sections(df, "id", "t", "form").collect()) == [(1, "Item 1"), (3, "Document")]
    assert {r.id for r in documents.chunk_sections(df, "id", "t").collect()} == {1}


def test_slices(spark):
    df = spark.createDataFrame([("héllo", 0, 2), ("abc", 2, 9), ("abc", -1, 2), ("abc", 2, 2), (None, 0, 1)], "t string, a int, b int")
    assert [r[0] for r in df.select(documents.slice_text(F.col("t"), F.col("a"), F.col("b"))).collect()] == ["hé", None, None, None, None]


def test_paragraphs(spark):
    same = "p" * 210
    df = spark.createDataFrame([(1, f"first paragraph of text\n\nshort\n\n{same}1\n\n{same}2\n\n  last paragraph of text ")], "id int, t string")
    rows = documents.distinct_paragraphs(df, ["id"], "t", same_start=200).orderBy("pos").collect()
    assert [(r.pos, r.paragraph[:4]) for r in rows] == [(0, "firs"), (2, "pppp"), (4, "last")]
    assert [r.pos for r in documents.distinct_paragraphs(df, ["id"], "t").orderBy("pos").collect()] == [0, 2, 3, 4]


def test_diff():
    assert diffs.paragraph_diff(list("abcd"), list("abXd")) == (["X"], ["c"], 3)
    assert diffs.paragraph_diff([], list("ab")) == (["a", "b"], [], 0)


@pytest.mark.parametrize("state, a, b", [("both", "v1", "v2"), ("only_a", "v1", "zz"), ("only_b", "zz", "v1"), ("missing", "zz", "yy")])
def test_diff_states(spark, state, a, b):
    texts = spark.createDataFrame([("v1", "first paragraph of text\n\nsecond paragraph of text"), ("v2", "first paragraph of text\n\nanother paragraph of text")], "v string, t string")
    pairs = spark.createDataFrame([(a, b)], "version_a string, version_b string")
    r = diffs.section_diffs(pairs, texts, "v", "t").first()
    assert r.state == state
    assert (len(r.added), len(r.removed), r.common) == {"both": (1, 1, 1), "only_a": (0, 2, 0), "only_b": (2, 0, 0), "missing": (0, 0, 0)}[state]
