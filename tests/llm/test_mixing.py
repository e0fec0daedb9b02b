from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
import pytest

from factloom.llm.mixing import _permuted, blocks, document_tokens, load_tokenizer, mix_sources, mixed_sequences, redraw, token_blocks, tokenizer_file, with_offsets

DOCS = "doc_id long, text string, source string, tokens long, block int"
TARGETS = "source string, target_share double, max_repeats int, docs int"


def make(spark):
    rows = [(i, f"alpha beta gamma delta {i} " * 12, "Big Source" if i % 2 else "big_source", 0, 0) for i in range(300)]
    rows += [(1000 + i, "small text of few tokens " * 10, " SMALL ", 0, 0) for i in range(12)]
    rows += [(2000 + i, "middle text here " * 20, "middle-one", 0, 0) for i in range(60)]
    rows += [(3000, None, "small", 0, 0), (3001, "", "small", 0, 0), (3002, "x", None, 0, 0), (3003, "x", "other", 0, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("big_source", 0.3, 2, 0), ("small", 0.3, 4, 0), ("middle_one", 0.4, 5, 0), ("absent", 0.0, 3, 0)], TARGETS)
    return docs, targets


def test_mix(spark):
    docs, targets = make(spark)
    mix, report = mix_sources(docs, targets, block_tokens=64, shard_slots=32)
    rows, rep = mix.collect(), {r.source: r for r in report.collect()}
    assert set(rep) == {"big_source", "small", "middle_one", "absent"} and rep["absent"].mixed_tokens == 0 and not rep["absent"].short
    assert [s for s in rep if rep[s].short] == ["small"] and rep["small"].share < 0.3
    used, per_slot = defaultdict(set), defaultdict(int)
    for r in rows:
        used[r.source, r.block].add(r["pass"])
        per_slot[r.shard, r.slot, r.source] += r.token_to - r.token_from
        assert 0 <= r.token_from < r.token_to
    caps = {"big_source": 2, "small": 4, "middle_one": 5}
    assert all(max(p) < caps[s] for (s, _), p in used.items())
    assert max(per_slot.values()) == 64 and sum(per_slot.values()) == sum(r.mixed_tokens for r in rep.values())
    passes = Counter((r.source, r["pass"], r.block, r.doc_id, r.token_from) for r in rows)
    assert max(passes.values()) == 1
    assert sum(r.share for r in rep.values()) == pytest.approx(1)
    again = mix_sources(docs, targets, block_tokens=64, shard_slots=32)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_blocks_hold_every_token_once(spark):
    counted = spark.createDataFrame([("s", i, n) for i, n in enumerate([5, 0, 17, 1, 9, 40])] + [("t", 9, 3)], "source string, doc_id long, tokens long")
    offsets = sorted((r.first_token, r.tokens) for r in with_offsets(counted).where("source = 's' AND tokens > 0").collect())
    assert [a for a, _ in offsets] == [sum(n for _, n in offsets[:i]) for i in range(len(offsets))]
    got = blocks(counted, 8).collect()
    size = Counter()
    for r in got:
        size[r.source, r.block] += r.token_to - r.token_from
    assert sum(v for (s, _), v in size.items() if s == "s") == 72 and sorted(v for (s, _), v in size.items() if s == "s") == [8] * 9
    assert size["t", 0] == 3


def test_sequences_are_the_texts(spark):
    docs, targets = make(spark)
    path = tokenizer_file()
    counted = document_tokens(docs, targets, path)
    rows = sorted(token_blocks(docs, counted, path, 64).where("source = 'middle_one'").collect(), key=lambda r: r.block)
    order = [r.doc_id for r in with_offsets(counted).where("source = 'middle_one'").orderBy("first_token").collect()]
    text = {r.doc_id: r.text for r in docs.collect()}
    assert load_tokenizer(path).decode([t for r in rows for t in r.tokens]) == "".join(text[i] for i in order)
    assert all(len(r.tokens) == 64 for r in rows[:-1])
    seq, mix = mixed_sequences(docs, targets, 64, 32).collect(), mix_sources(docs, targets, 64, 32)[0].collect()
    size = Counter()
    for r in mix:
        size[r.shard, r.slot, r.source] += r.token_to - r.token_from
    assert {(r.shard, r.slot, r.source): len(r.tokens) for r in seq} == dict(size)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    p = _permuted(3)
    for turn in (0, 1):
        out = p(pd.Series(["s"] * n), pd.Series([turn] * n), pd.Series(range(n)), pd.Series([n] * n))
        assert sorted(out) == list(range(n))
    if n > 50:
        assert list(out) != list(range(n))


def test_empty(spark):
    docs, targets = make(spark)
    for d, t in ((docs.limit(0), targets), (docs, targets.limit(0))):
        mix, report = mix_sources(d, t)
        assert mix.count() == 0 and report.count() == t.count()


@pytest.mark.parametrize("drawn, blocks_, want", [({"a": 30, "b": 5}, (10, 20), 15), ({"a": 30, "b": 5}, (10, 3), 1), ({"a": 1}, (3, 3), 0), ({"a": 9, "b": 1, "c": 1}, (2, 2, 50), 5)])
def test_redraw(drawn, blocks_, want):
    plan = [{"source": s, "blocks": n, "max_repeats": 2 if s == "a" and n == 2 else 1, "planned": 0.2 + k} for k, (s, n) in enumerate(zip("abc", blocks_))]
    plan = plan if want != 15 else [p | {"max_repeats": 1} for p in plan]
    caps = [p["blocks"] * p["max_repeats"] for p in plan]
    out = redraw(drawn, plan)
    over = sum(max(0, drawn.get(p["source"], 0) - c) for p, c in zip(plan, caps))
    room = [max(0, c - drawn.get(p["source"], 0)) for p, c in zip(plan, caps)]
    assert sum(out) == min(over, sum(room)) and all(0 <= x <= r for x, r in zip(out, room))


def test_every_slot_is_filled_while_there_is_room(spark):
    docs, targets = make(spark)
    mix, report = mix_sources(docs, targets, block_tokens=64, shard_slots=8)
    rep = report.collect()
    slots = {(r.shard, r.slot) for r in mix.collect()}
    shards = {}
    for shard, slot in slots:
        shards.setdefault(shard, set()).add(slot)
    assert sum(r.unfilled_slots for r in rep) == 0
    assert all(s == set(range(len(s))) for s in shards.values()) and all(len(s) == 8 for k, s in shards.items() if k < max(shards))
    tokens = {r.source: (r.source_tokens, r.max_repeats, r.mixed_tokens, r.unused_tokens) for r in rep}
    assert all(m + u == t * k for t, k, m, u in tokens.values())
