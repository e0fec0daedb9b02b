from __future__ import annotations

import random
import re
import unicodedata

import numpy as np

from factloom.llm.leakage import _longest_run, _window_minima, contained_items, leaked_items
from factloom.llm.textarrays import word_hashes


def words(t):
    t = re.sub("[​­⁠]", "", unicodedata.normalize("NFKC", t or ""))
    return re.findall(r"[^\W_]+", re.sub(r"<[^<>]*>", " ", t).lower())


def brute(docs, items, n):
    grams = {}
    for i, p in items:
        w = words(p)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, 0, "x") for r in docs], "doc_id long, text string, id int, item string")
    return d, spark.createDataFrame([(*r, 0) for r in items], "item_id long, passage string, r int")


def test_like_brute_force(spark):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(40)] + ["the", "of", "a"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(5, 60)))) for i in range(40)]
    docs = []
    for d in range(150):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 900))]
        for _ in range(rnd.randrange(0, 3)):
            p = rnd.choice(items)[1].split()
            n = rnd.randrange(8, 20)
            at = rnd.randrange(0, max(1, len(p) - n))
            part = [rnd.choice((x, x.upper(), f"<b>{x}</b>", x[0] + "​" + x[1:], x[0] + "­" + x[1:])) for x in p[at : at + n]]
            at = rnd.randrange(0, len(w) + 1)
            w[at:at] = part
        docs.append((d, rnd.choice((" ", " ", ", ", " - ")).join(w)))
    want = brute(docs, items, 12)
    got = {(r.doc_id, r.item_id) for r in leaked_items(*frames(spark, docs, items)).collect()}
    assert got == want and len(want) > 20


def test_odd_rows(spark):
    run = " ".join(f"k{i}" for i in range(12))
    long = "pad word " * 60_000 + run
    docs = [(1, None), (2, ""), (3, run), (3, run), (4, long), (5, run.replace("k5", "zz")), (None, run), (6, " ".join(f"k{i}" for i in range(11)))]
    items = [(1, run), (1, None), (2, ""), (None, run), (3, "too short")]
    got = sorted(((r.doc_id, r.item_id, r.shared_words) for r in leaked_items(*frames(spark, docs, items)).where("doc_id IS NOT NULL AND item_id IS NOT NULL").collect()))
    assert got == [(3, 1, 12), (4, 1, 12)]
    assert leaked_items(*frames(spark, [], items)).count() == 0 and leaked_items(*frames(spark, docs, [])).count() == 0


def test_hot_item(spark):
    run = " ".join(f"k{i}" for i in range(15))
    docs = [(i, f"start {i} {run} end") for i in range(400)]
    assert leaked_items(*frames(spark, docs, [(7, run)])).where("shared_words = 15").count() == 400


def test_minima_and_words():
    h = np.random.default_rng(1).integers(0, 1 << 60, 50).astype(np.uint64)
    for w in (1, 2, 3, 5, 8):
        assert (_window_minima(h, w) == [h[i : i + w].min() for i in range(50 - w + 1)]).all()
    a, owner = word_hashes(["One two\nONE", "", "İki two", "x1 _ 二"])
    assert owner.tolist()[:3] == [0, 0, 0] and a[0] == a[2] and a[1] == a[[i for i, o in enumerate(owner) if o == 2][-1]] and (owner == 3).sum() == 2


def test_whole_items_like_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(n))) for i, n in enumerate([6, 30, 80, 300, 900])]
    docs = []
    for d in range(120):
        part = rnd.choice(items)[1].split()
        part = [w if rnd.random() > rnd.choice((0, 0.01, 0.03, 0.06)) else rnd.choice(vocab) for w in part]
        pad = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 3000))]
        at = rnd.randrange(0, len(pad) + 1)
        docs.append((d, " ".join(pad[:at] + part + pad[at:])))
    grams = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
    sets = [(i, grams(t)) for i, t in items]
    want = {(d, i): len(s & g) / len(s) for d, t in docs for g in [grams(t)] for i, s in sets if len(s & g) / len(s) >= 0.8}
    got = {(r.doc_id, r.item_id): r.containment for r in contained_items(*frames(spark, docs, items)).collect()}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) > 30 and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert contained_items(*frames(spark, [], items)).count() == 0 and contained_items(*frames(spark, docs, [(1, None), (2, "too short")])).count() == 0


def test_longest_run():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        doc, passage = rnd.integers(0, 3, 60).astype(np.uint64), rnd.integers(0, 3, 30).astype(np.uint64)
        own = {tuple(doc[i : i + n]) for n in range(4, 31) for i in range(60 - n + 1)}
        best = max((n for n in range(4, 31) for i in range(30 - n + 1) if tuple(passage[i : i + n]) in own), default=0)
        n, first = _longest_run(doc, passage, 4)
        assert n == best and (not n or tuple(passage[first : first + n]) in own)
