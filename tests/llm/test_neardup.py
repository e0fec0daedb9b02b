from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import pytest

from factloom.llm import neardup
from factloom.llm.components import connected_components
from factloom.llm.neardup import duplicate_groups, expand_pairs, near_duplicates, prefix_length


def corpus(seed=4, n=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(15, 120))]
        for v in range(rnd.randrange(1, 4)):
            rows.append((rnd.choice("st") if v else "s", f"{i:03d}-{v}", " ".join(words)))
            words = [w if rnd.random() > 0.04 else rnd.choice(vocab) for w in words]
    return rows + [("s", "copy-1", "same words " * 15), ("s", "copy-2", "Same, WORDS! " * 15), ("t", "copy-3", "same words " * 15)]


def brute(rows, k, t, least):
    sets = {}
    for s, i, text in rows:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        if len(w) >= least:
            sets[s, i] = set(zip(*(w[j:] for j in range(k))))
    return {(a[0], *sorted((a[1], b[1]))) for a, b in combinations(sets, 2) if a[0] == b[0] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


@pytest.mark.parametrize("k, t, orders", [(3, 0.6, 3), (5, 0.8, 2), (3, 0.3, 4)])
def test_all_pairs(spark, k, t, orders):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "set string, id string, text string, token string, n int")
    got = {tuple(r) for r in expand_pairs(*near_duplicates(df, k, t, 20, orders)).collect()}
    assert got == brute(rows, k, t, 20) and got


def test_split_shingles_and_shuffled_rows(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 2)  # nearly every shared shingle lies under several salts
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", -1)
    rows = corpus(12)
    df = spark.createDataFrame(rows, "set string, id string, text string")
    got = {tuple(r) for r in expand_pairs(*near_duplicates(df, 3, 0.6, 20), part=1).collect()}
    assert got == brute(rows, 3, 0.6, 20) and got


def test_groups(spark):
    rows = corpus(9)
    df = spark.createDataFrame(rows, "set string, id string, text string")
    members, links = near_duplicates(df, 3, 0.6, 20)
    groups = duplicate_groups(members, links).collect()
    of = {(r.set, r.id): r.group for r in groups}
    pairs = brute(rows, 3, 0.6, 20)
    assert all(of[s, a] == of[s, b] for s, a, b in pairs)
    parent = {k: k for k in of}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for s, a, b in pairs:
        parent[find((s, a))] = find((s, b))
    assert len(set(of.values())) == len({find(x) for x in of}) and len(of) == len(groups)
    assert next(r.copies for r in groups if r.id == "copy-1") == 2 and next(r.copies for r in groups if r.id == "copy-3") == 1


def test_odd_texts(spark):
    long = " ".join(f"long{i % 5000}" for i in range(60_000))
    rows = [("s", "a", None), ("s", "b", ""), ("s", "c", "too short"), ("s", "d", long), ("s", "e", long + " end"), ("s", "e", long), (None, "f", long), ("s", None, long)]
    df = spark.createDataFrame(rows, "set string, id string, text string")
    members, links = near_duplicates(df, 5, 0.8)
    assert members.count() == 5 and links.count() == 1
    pairs = {(r.id_a, r.id_b) for r in expand_pairs(members, links).where("set = 's'").collect()}
    assert ("d", "e") in pairs
    empty = near_duplicates(df.limit(0))
    assert empty[0].count() == 0 and empty[1].count() == 0 and duplicate_groups(*empty).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(df, threshold=0)


def test_prefix_length():
    assert prefix_length(10, 0.6) == 5 and prefix_length(5, 0.6) == 3 and prefix_length(1, 0.8) == 1


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(7, 7), (1, 0), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    parent = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in parent}
    sizes = Counter(got.values())
    assert sizes[0] == 41 and sizes[100] == 40
