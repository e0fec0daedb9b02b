"""Near-duplicate texts by prefix filtering under several global token orders.

A text is its set of hashed word runs (shingles). If two sets have a Jaccard similarity of t or more, then under *any*
global order of the shingles their prefixes, the first ``n - ceil(t n) + 1`` of each, share one. Candidates must share a
prefix shingle under each of several orders: all put rare shingles first, by the counts of hashed buckets, and differ
in how they break ties. One set of postings serves all orders, each row marked with the orders under which its shingle is
in the prefix, so the filters of all orders are intersected while the pairs are put together. How many prefix shingles a
pair shares bounds what the rest can add, and pairs that can't reach t are dropped before any text is fetched.
What is left is verified on the whole texts. No filter can lose a pair.

1. Scan: shingles counted into a fixed number of buckets, a bounded array per task; the class (same words in the same
   order) of each text. The summed array is broadcast: its size is ``BUCKETS``, whatever the data.
2. Scan: prefix postings of one text per class, in the order of that array. Only they are shuffled, once, by shingle.
3. The texts of surviving candidates are joined to them and compared.

A shingle that may be in more than a share of all texts is split over salts by its bucket's count, so that no task gets
more than that share of one side. Copies cost one row each.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import connected_components
from factloom.llm.textarrays import mixed, runs, slices, word_hashes
from factloom.session import cut_lineage

BUCKETS, BLOCKS = 1 << 20, 64
#: A shingle's postings are split where its bucket counts more than the larger of this and a 256th of all texts.
HOT, HOT_SHARE = 4096, 256
#: Most row digests that are broadcast to pick out texts; beyond it the texts are joined by a shuffle.
BROADCAST_ROWS = 500_000
_EPS = 1e-9
#: A posting's key is 48 bits of its shingle's hash and 16 bits of its place, where the last number stands for all from there on.
_KEY_BITS, _FAR = np.uint64(((1 << 48) - 1) << 16), (1 << 16) - 1


def _salt(name: object) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(str(name).encode(), digest_size=8).digest(), np.uint64)[0]


def _shingled(batches: Iterator[pd.DataFrame], run_words: int, least_words: int) -> Iterator[tuple[pd.DataFrame, list, list]]:
    """Per slice of texts: the rows that count, the class digest of each, and its shingles as they come."""
    for batch in batches:
        texts, salts = batch["text"].tolist(), {s: _salt(s) for s in set(batch["set"])}
        salt = np.asarray([salts[s] for s in batch["set"]], np.uint64)
        for a, b in slices(texts):
            words, owner = word_hashes(texts[a:b])
            shingles, first = runs(words, owner, run_words)
            of = owner[first] if len(first) else first
            shingles = mixed(shingles + salt[a:b][of]) if len(first) else shingles
            at, upto = np.searchsorted(owner, np.arange(b - a + 1)), np.searchsorted(of, np.arange(b - a + 1))
            kept = [d for d in range(b - a) if at[d + 1] - at[d] >= least_words and upto[d + 1] > upto[d]]
            marks = [hashlib.blake2b(salt[a + d].tobytes() + words[at[d] : at[d + 1]].tobytes(), digest_size=16).digest() for d in kept]
            yield batch.iloc[[a + d for d in kept]], marks, [shingles[upto[d] : upto[d + 1]] for d in kept]


def _survey(run_words: int, least_words: int):
    """Texts with their class, and at the end of each task the counts of its shingles by bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(BUCKETS, np.int64)
        for rows, marks, sets in _shingled(batches, run_words, least_words):
            if sets:
                counts += np.bincount((np.concatenate(sets) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
            c, d = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2).T
            yield rows[["set", "id", "r1", "r2"]].assign(c=c, d=d, block=-1, counts=None)
        if counts.any():
            blocks = [zlib.compress(x.astype(np.min_scalar_type(int(x.max()))).tobytes(), 1) for x in counts.reshape(BLOCKS, -1)]
            yield pd.DataFrame({"set": None, "id": None, "r1": 0, "r2": 0, "c": 0, "d": 0, "block": range(BLOCKS), "counts": blocks})

    return run


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per block, added up as the rows stream by."""
    width, total = BUCKETS // BLOCKS, {}
    for batch in batches:
        for block, packed in zip(batch["block"], batch["counts"]):
            raw = zlib.decompress(packed)
            kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(raw) // width]
            total[block] = total.get(block, 0) + np.frombuffer(raw, kind).astype(np.int64)
    yield pd.DataFrame({"block": list(total), "counts": [x.tobytes() for x in total.values()]})


def bucket_counts(survey: DataFrame) -> np.ndarray:
    """How often a shingle of each bucket occurs in all texts: ``BUCKETS`` numbers, whatever the data."""
    rows = survey.where("block >= 0").select("block", "counts").repartition(F.col("block")).mapInPandas(_summed, "block int, counts binary").collect()
    out = np.zeros((BLOCKS, BUCKETS // BLOCKS), np.int64)
    for r in rows:
        out[r["block"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def prefix_length(n: int, threshold: float) -> int:
    """Shingles of a set of n that must be looked at so that no partner is lost."""
    return n - math.ceil(threshold * n - _EPS) + 1


def _postings(run_words: int, least_words: int, threshold: float, orders: int, counts, hot: int):
    """Prefix postings of each text: c, about, key; three numbers a row, for they are what is shuffled.

    about holds n, the size of the set, last, the level of the last prefix shingle in the first order, marks, with a bit for
    each order under which the shingle is in the prefix, and role. Of a split shingle, one row with role 1 lies under one of its
    salts and one with role 2 under each; other rows have role 3. A pair is made of roles 1 and 2. key holds the
    shingle and its place in the first order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = counts.value
        for _, digests, sets in _shingled(batches, run_words, least_words):
            parts = []
            for digest, found in zip(digests, sets):
                own = np.unique(found)
                n, often_own = len(own), often[(own & np.uint64(BUCKETS - 1)).astype(np.int64)]
                take, level = prefix_length(n, threshold), np.minimum(often_own, (1 << 31) - 1).astype(np.uint64) << np.uint64(32)
                marks = np.zeros(n, np.int8)
                for k in range(orders):
                    place = level | (mixed(own ^ np.uint64(k + 1)) >> np.uint64(32))
                    if k == 0:
                        order = np.argsort(place, kind="stable")
                        pos, last = np.empty(n, np.int64), int(8 * math.log2(often_own[order[take - 1]]))
                        pos[order] = np.minimum(np.arange(n), _FAR)
                        marks[order[:take]] = 1
                    else:
                        marks |= (place <= np.partition(place, take - 1)[take - 1]).astype(np.int8) << k
                kept = np.flatnonzero(marks)
                c = np.frombuffer(digest, np.int64)[0]
                parts.append((own[kept], pos[kept], np.full(len(kept), c), (n << 24) + (min(last, 255) << 16) + (marks[kept].astype(np.int64) << 8), often_own[kept]))
            if not parts:
                continue
            key, pos, c, about, df = (np.concatenate(x) for x in zip(*parts))
            salts = np.minimum(-(-df // hot), HOT_SHARE)
            role = np.where(salts > 1, 1, 3)
            salted = np.where(salts > 1, mixed(key + c.view(np.uint64) % np.maximum(salts, 1).astype(np.uint64) + np.uint64(1)), key)
            many = np.flatnonzero(salts > 1)
            if len(many):
                again = np.repeat(many, salts[many])
                which = np.arange(len(again)) - np.repeat(np.cumsum(salts[many]) - salts[many], salts[many])
                salted = np.concatenate([salted, mixed(key[again] + which.astype(np.uint64) + np.uint64(1))])
                pos, c, about = (np.concatenate([x, x[again]]) for x in (pos, c, about))
                role = np.concatenate([role, np.full(len(again), 2)])
            yield pd.DataFrame({"c": c, "about": about + role, "key": (salted & _KEY_BITS).view(np.int64) | pos})

    return run


def candidate_pairs(postings: DataFrame, threshold: float, orders: int) -> DataFrame:
    """(a, b) of classes that share prefix shingles under every order, and enough of them under the first.

    Sizes and, for each shared shingle, what can be shared before and after it bound the overlap; all shingles that a
    similar pair shares pass these bounds, so their number is exact for it. Beyond the prefix that ends first, the
    pair shares no more than that set has left.
    """
    bits = lambda col, low, mask: F.shiftright(col, low).bitwiseAND(F.lit(mask))
    n, last, marks, role, pos = (
        {e: x for e in "ab" for x in [bits(f"{e}.{col}", low, mask)]} for col, low, mask in (("about", 24, (1 << 38) - 1), ("about", 16, 255), ("about", 8, 127), ("about", 0, 3), ("key", 0, _FAR))
    )
    needed = F.ceil((n["a"] + n["b"]) * F.lit(threshold / (1 + threshold)) - F.lit(_EPS))
    before, after = F.least(pos["a"], pos["b"]), F.least(n["a"] - pos["a"], n["b"] - pos["b"])
    far = F.greatest(pos["a"], pos["b"]) == _FAR
    ends_first = F.when(last["a"] < last["b"], n["a"]).when(last["a"] > last["b"], n["b"]).otherwise(F.greatest(n["a"], n["b"]))
    left = F.ceil(ends_first * F.lit(threshold) - F.lit(_EPS)) - 1
    both = marks["a"].bitwiseAND(marks["b"])
    pairs = postings.alias("a").join(
        postings.alias("b"),
        (F.shiftright("a.key", 16) == F.shiftright("b.key", 16))
        & ((n["a"] < n["b"]) | ((n["a"] == n["b"]) & (F.col("a.c") < F.col("b.c"))))
        & (n["a"] >= n["b"] * threshold - _EPS)
        & (role["a"].bitwiseAND(F.shiftright(role["b"], 1)) == 1)
        & (both != 0)
        & (far | (before + after >= needed)),
    )
    return (
        pairs.select(F.col("a.c").alias("a"), F.col("b.c").alias("b"), (needed - left).cast("int").alias("least"), both.alias("marks"))
        .groupBy("a", "b")
        .agg(F.max("least").alias("least"), F.bit_or("marks").alias("marks"), F.sum(F.col("marks").bitwiseAND(F.lit(1))).alias("shared"))
        .where((F.col("marks") == (1 << orders) - 1) & (F.col("shared") >= F.col("least")))
        .select("a", "b")
    )


def _picked(texts: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``texts`` joined with ``rows`` on the row's digest: the rows are broadcast if few, else both are shuffled."""
    few = rows.count() <= BROADCAST_ROWS
    return texts.join(F.broadcast(rows) if few else rows, ["r1", "r2"], how)


def _similarity(run_words: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = dict(zip(batch["a"], batch["text_a"])) | dict(zip(batch["b"], batch["text_b"]))
            known, keys, body = {}, list(texts), list(texts.values())
            for x, y in slices(body):
                words, owner = word_hashes(body[x:y])
                shingles, first = runs(words, owner, run_words)
                upto = np.searchsorted(owner[first] if len(first) else first, np.arange(y - x + 1))
                known |= {keys[x + d]: np.unique(shingles[upto[d] : upto[d + 1]]) for d in range(y - x)}
            common = np.asarray([len(np.intersect1d(known[a], known[b], assume_unique=True)) for a, b in zip(batch["a"], batch["b"])], np.int64)
            total = np.asarray([len(known[a]) + len(known[b]) for a, b in zip(batch["a"], batch["b"])], np.int64) - common
            out = batch[["set", "name_a", "name_b"]].assign(similarity=common / np.maximum(total, 1))
            yield out[out["similarity"] >= threshold - 1e-12]

    return run


def near_duplicates(texts: DataFrame, run_words: int = 5, threshold: float = 0.8, least_words: int = 20, orders: int = 3) -> tuple[DataFrame, DataFrame]:
    """(members, links) of near-duplicate texts within each set.

    ``texts``: set, id, text. Members: set, id, class and copies for each text of at least ``least_words`` words; class is
    the least id of the set's texts with the same words in the same order (a digest where none has an id), copies how
    many they are. Links: set, a, b, similarity between classes, a < b. NULL, empty and shorter texts are no members; a
    NULL set is a set of its own. Repeated rows are members of the same class; texts of different sets are never
    linked. Very long texts are one row like any other. An empty table gives two empty results.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    if not 1 <= orders <= 7:
        raise ValueError("orders must be 1 to 7")
    row = [F.xxhash64(F.lit(i), "set", "id", "text").alias(f"r{i}") for i in (1, 2)]
    rows = texts.where("text IS NOT NULL").select("set", "id", "text", *row)
    survey = cut_lineage(rows.mapInPandas(_survey(run_words, least_words), "set string, id string, r1 long, r2 long, c long, d long, block int, counts binary"))
    placed = survey.where("block < 0")
    first = F.min(F.struct("r1", "r2"))
    classes = placed.groupBy("c", "d").agg(F.coalesce(F.min("id"), F.hex(F.min("c"))).alias("class"), F.count(F.lit(1)).alias("copies"), first.alias("first"))
    members = cut_lineage(placed.join(classes, ["c", "d"]).select("set", "id", "r1", "r2", "c", "class", "copies", (F.struct("r1", "r2") == F.col("first")).alias("is_first")))

    counts = texts.sparkSession.sparkContext.broadcast(bucket_counts(survey))
    hot = max(HOT, -(-members.count() // HOT_SHARE))
    postings = _picked(rows, members.where("NOT is_first").select("r1", "r2").distinct(), "left_anti").mapInPandas(
        _postings(run_words, least_words, threshold, orders, counts, hot), "c long, about long, key long"
    )
    pairs = cut_lineage(candidate_pairs(postings, threshold, orders))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    wanted = cut_lineage(members.where("is_first").select("r1", "r2", "c", "class").distinct().join(asked, "c"))
    found = _picked(rows, wanted, "inner").select("c", "set", "class", "text")
    x, y = found.alias("x"), found.alias("y")
    both = pairs.join(x, F.col("a") == F.col("x.c")).join(y, F.col("b") == F.col("y.c"))
    links = both.select(
        "a", "b", F.coalesce("x.set", "y.set").alias("set"), F.col("x.class").alias("name_a"), F.col("y.class").alias("name_b"), F.col("x.text").alias("text_a"), F.col("y.text").alias("text_b")
    ).mapInPandas(_similarity(run_words, threshold), "set string, name_a string, name_b string, similarity double")
    links = links.groupBy("set", F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b")).agg(F.max("similarity").alias("similarity"))
    return members.select("set", "id", "class", "copies"), cut_lineage(links)


_NO_SET = "\u0000"


def _named(df: DataFrame) -> DataFrame:
    """A NULL set under a name of its own, so that it can be joined."""
    return df.withColumn("set", F.coalesce("set", F.lit(_NO_SET)))


def expand_pairs(members: DataFrame, links: DataFrame, part: int = 1000) -> DataFrame:
    """(set, id_a, id_b), smaller id first, of all linked texts, copies included.

    The result is the sum of products of class sizes, which is what asking for pairs of copies means; use
    :func:`duplicate_groups` where they need not be listed. Of a large class every ``part`` copies are a task's
    share: the other side's rows go to each of them.
    """
    members, links = _named(members), _named(links)
    same = members.where("copies > 1").select("set", F.col("class").alias("a"), F.col("class").alias("b")).distinct()
    parts = F.ceil(F.col("copies") / part).cast("int")
    y = members.select("set", F.col("class").alias("b"), F.col("id").alias("y"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    of = members.select("set", F.col("class").alias("b"), parts.alias("parts")).distinct()
    x = members.select("set", F.col("class").alias("a"), F.col("id").alias("x"))
    pairs = links.select("set", "a", "b").unionByName(same).join(of, ["set", "b"]).join(x, ["set", "a"])
    both = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(y, ["set", "b", "part"]).where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return both.select(F.nullif("set", F.lit(_NO_SET)).alias("set"), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a <> id_b").distinct()


def duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per text: set, id, class, group (the least class linked to it, directly or through others),
    links (classes linked to its class) and copies (texts of its class)."""
    members, links = _named(members), _named(links)
    node = lambda c: F.struct("set", F.col(c).alias("class"))
    component = connected_components(links.select(node("a").alias("a"), node("b").alias("b")), "a", "b")
    component = component.select("node.set", "node.class", F.col("component.class").alias("group"))
    degree = links.select("set", F.explode(F.array("a", "b")).alias("class")).groupBy("set", "class").agg(F.count(F.lit(1)).alias("links"))
    rows = members.join(component, ["set", "class"], "left").join(degree, ["set", "class"], "left")
    return rows.select(
        F.nullif("set", F.lit(_NO_SET)).alias("set"), "id", "class", F.coalesce("group", "class").alias("group"), F.coalesce("links", F.lit(0)).alias("links"), "copies",
    )
