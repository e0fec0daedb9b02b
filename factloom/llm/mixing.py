"""Mixing sources to target weights, in blocks of tokens.

1. Documents are counted in tokens of a public tokenizer and laid end to end per source; a source is
   then a row of fixed-length blocks. Offsets come from two prefix sums, within hashed buckets of
   a source and over the buckets' totals, so no task holds a whole source.
2. The mix has as many slots as all documents together fill blocks. Slots are dealt out in shards; each shard draws its
   source counts from one multinomial over the planned shares. A source that cannot reach its target
   with every block used ``max_repeats`` times is planned with what it has, and the others share
   the rest in proportion to their targets.
3. Slots drawn beyond a source's last allowed pass are dealt, in pseudorandom order, to the sources that have room, in
   proportion to their planned shares. A slot stays unfilled only when every source is used up.
4. The i-th slot of a source is its block number ``permute(i mod N)`` in pass ``i div N``, with a
   pseudorandom permutation of its own for each pass: every block is used once before any is used again.
5. Slots are joined with the blocks by (source, index). What each block was used for, and what its allowed passes leave
   unused, gives the shares reached and the sources that can't reach theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.tokens import load_tokenizer, tokenizer_file
from factloom.session import cut_lineage

#: Hashed buckets per source for the prefix sums of documents, and slots per group for those of shards.
BUCKETS = 4096
#: Most slots that one task makes.
SLOTS_A_TASK = 1 << 20


def _count_tokens(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_tokenizer(path)
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch["text"]]
            yield pd.DataFrame({"source": batch["source"], "doc_id": batch["doc_id"], "tokens": np.asarray(counts, np.int64)})

    return run


def canonical_source(name: Column) -> Column:
    """A source's spelling without case, outer blanks, and the choice of hyphen, blank or underscore."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[-\s_]+", "_")


def document_tokens(docs: DataFrame, targets: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(source, doc_id, tokens) of documents from a target source; NULL and empty texts have no tokens."""
    listed = targets.select(canonical_source(F.col("source")).alias("source")).distinct()
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(canonical_source(F.col(source)).alias("source"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.join(listed, "source", "left_semi").mapInPandas(_count_tokens(path), f"source string, doc_id {kind}, tokens long")


def encoded_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(source, doc_id, tokens, ids) with the token ids of each document that has any."""
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(canonical_source(F.col(source)).alias("source"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text <> ''")
    return rows.mapInPandas(_encode(path), f"source string, doc_id {kind}, tokens long, ids array<int>")


def with_offsets(counted: DataFrame) -> DataFrame:
    """Adds ``first_token``, the number of tokens of the same source before the document."""
    rows = counted.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    totals = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("total"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("source", "bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(bases, ["source", "bucket"])
        .select("source", "doc_id", "tokens", (F.col("base") + F.col("inside")).alias("first_token"))
    )


def blocks(counted: DataFrame, block_tokens: int) -> DataFrame:
    """(source, block, place, doc_id, token_from, token_to): the documents' parts that make up each block.

    token_from and token_to are places within the document, place is that of the part in the block. Block b of a source holds its tokens
    b * block_tokens up to the next multiple; the last block of a source may be shorter.
    """
    start, stop = F.col("first_token"), F.col("first_token") + F.col("tokens")
    size = F.lit(block_tokens)
    pieces = with_offsets(counted.where("tokens > 0")).withColumn("block", F.explode(F.sequence(F.floor(start / size), F.floor((stop - 1) / size))))
    lo = F.greatest(start, F.col("block") * size)
    hi = F.least(stop, (F.col("block") + 1) * size)
    return pieces.select("source", "block", (lo - F.col("block") * size).alias("place"), "doc_id", (lo - start).alias("token_from"), (hi - start).alias("token_to"))


def _encode(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_tokenizer(path)
        for batch in batches:
            ids = [np.asarray(encoding.encode_ordinary(t), np.int32) for t in batch["text"]]
            yield pd.DataFrame({"source": batch["source"], "doc_id": batch["doc_id"], "tokens": [len(x) for x in ids], "ids": ids})

    return run


def blocks_with_ids(encoded: DataFrame, block_tokens: int) -> DataFrame:
    """(source, block, tokens): the token ids of each block, in order; ids must be unique here.

    The blocks of :func:`blocks` with their content; what is gathered per block is its fixed length.
    """
    parts = blocks(encoded.select("source", "doc_id", "tokens"), block_tokens).join(encoded.drop("tokens"), ["source", "doc_id"])
    part = F.struct(F.col("place"), F.slice("ids", (F.col("token_from") + 1).cast("int"), (F.col("token_to") - F.col("token_from")).cast("int")).alias("ids"))
    return parts.groupBy("source", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["ids"])).alias("tokens"))


def token_blocks(docs: DataFrame, counted: DataFrame, path: str, block_tokens: int, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """:func:`blocks_with_ids` of the documents that ``counted`` has."""
    return blocks_with_ids(encoded_documents(docs, path, doc_id, text, source).join(counted.select("source", "doc_id"), ["source", "doc_id"], "left_semi"), block_tokens)


def plan_sources(counted: DataFrame, targets: DataFrame, block_tokens: int) -> list[dict]:
    """One entry per target source: what it has, wants and can give. As many as there are sources."""
    sums = counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    rows = (
        targets.select(F.col("source").alias("name"), canonical_source(F.col("source")).alias("source"), "target_share", "max_repeats")
        .join(sums, "source", "left")
        .orderBy("source")
        .collect()
    )
    plan = [r.asDict() | {"tokens": r["tokens"] or 0, "docs": r["docs"] or 0, "target_share": float(r["target_share"] or 0), "max_repeats": int(r["max_repeats"] or 0)} for r in rows]
    total = sum(p["tokens"] for p in plan)
    slots = -(-total // block_tokens)
    for p in plan:
        p["blocks"] = -(-p["tokens"] // block_tokens)
        p["wanted_tokens"] = p["target_share"] * total
        p["slots"], p["total"] = slots, total
        p["planned"] = 0.0
    free, left = [p for p in plan], 1.0
    while free:
        weight = sum(p["target_share"] for p in free)
        full = [p for p in free if p["blocks"] * p["max_repeats"] < (left * p["target_share"] / weight if weight else 0) * slots]
        for p in full or free:
            p["planned"] = (p["blocks"] * p["max_repeats"] / slots if slots else 0.0) if full else (left * p["target_share"] / weight if weight else 0.0)
        if not full:
            break
        left = max(0.0, left - sum(p["planned"] for p in full))
        free = [p for p in free if p not in full]
    return plan


def draw_counts(spark, plan: list[dict], seed: int, shard_slots: int) -> DataFrame:
    """(shard, source, n, first_slot): multinomial source counts of each output shard, and where the source's slots begin in it."""
    names = [p["source"] for p in plan]
    shares = np.asarray([p["planned"] for p in plan], np.float64)
    slots = plan[0]["slots"] if plan else 0
    rest = max(0.0, 1.0 - shares.sum())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        odds = np.append(shares, rest)
        odds = odds / odds.sum()
        for batch in batches:
            parts = []
            for shard in batch["id"]:
                size = min(shard_slots, slots - shard * shard_slots)
                n = np.random.default_rng([seed, int(shard)]).multinomial(size, odds)[: len(names)]
                parts.append(pd.DataFrame({"shard": shard, "source": names, "n": n.astype(np.int64), "first_slot": np.cumsum(n) - n}))
            if parts:
                yield pd.concat(parts)

    return spark.range(-(-slots // shard_slots)).mapInPandas(run, "shard long, source string, n long, first_slot long")


def _permuted(seed: int):
    """Feistel permutation of [0, size) for each (source, round), walked until it falls inside."""

    def one(source: pd.Series, turn: pd.Series, index: pd.Series, size: pd.Series) -> pd.Series:
        x, n = index.to_numpy(np.uint64), size.to_numpy(np.uint64)
        if not len(x):
            return pd.Series([], dtype="int64")
        sizes, of = np.unique(n, return_inverse=True)
        half = np.asarray([max(1, (int(v - 1).bit_length() + 1) // 2) for v in sizes], np.uint64)[of]
        codes, names = pd.factorize(source)
        rounds, turns = pd.factorize(turn)
        both, of = np.unique(codes * len(turns) + rounds, return_inverse=True)
        seeds = [np.random.SeedSequence([seed, *names[k // len(turns)].encode(), int(turns[k % len(turns)])]) for k in both]
        salt = np.asarray([q.generate_state(1, np.uint64)[0] for q in seeds], np.uint64)[of]
        mask = (np.uint64(1) << half) - np.uint64(1)

        def step(v, k, h, m):
            left, right = v >> h, v & m
            for r in range(4):
                f = (right + k + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f >> np.uint64(32)) & m)
            return (left << h) | right

        out = x.copy()
        todo = np.arange(len(x))
        while len(todo):
            out[todo] = step(out[todo], salt[todo], half[todo], mask[todo])
            todo = todo[out[todo] >= n[todo]]
        return pd.Series(out.astype(np.int64))

    return one


def redraw(drawn: dict[str, int], plan: list[dict]) -> list[int]:
    """How many of the slots drawn beyond the caps each source of the plan takes over.

    In proportion to the planned shares, never more than a source has room for; as many as there are sources.
    """
    caps = [p["blocks"] * p["max_repeats"] for p in plan]
    room = [max(0, c - drawn.get(p["source"], 0)) for c, p in zip(caps, plan)]
    left = goal = min(sum(room), sum(max(0, drawn.get(p["source"], 0) - c) for c, p in zip(caps, plan)))
    out = [0] * len(plan)
    while left:
        free = [i for i in range(len(plan)) if room[i] > out[i]]
        weight = sum(plan[i]["planned"] for i in free)
        for i in free:
            share = left * plan[i]["planned"] / weight if weight else left / len(free)
            out[i] += min(room[i] - out[i], int(share))
        if goal - sum(out) == left:  # less than one slot a source: one each
            for i in sorted(free, key=lambda i: -plan[i]["planned"])[:left]:
                out[i] += 1
        left = goal - sum(out)
    return out


def mixed_slots(counts: DataFrame, plan: list[dict], seed: int) -> DataFrame:
    """(shard, slot, source, pass, block): which block fills each slot; block NULL where no source has room.

    The slots of a source are numbered through all shards by prefix sums over groups of shards. What passes through the
    driver is one number per source.
    """
    spark = counts.sparkSession
    drawn = {r["source"]: r["n"] for r in counts.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    caps = [p["blocks"] * p["max_repeats"] for p in plan]
    over = [max(0, drawn.get(p["source"], 0) - c) for p, c in zip(plan, caps)]
    taken = redraw(drawn, plan)
    sizes = spark.createDataFrame(
        [(p["source"], p["blocks"], c, sum(over[:k])) for k, (p, c) in enumerate(zip(plan, caps))], "source string, blocks long, cap long, first_over long"
    )
    rows = counts.where("n > 0").withColumn("group", F.floor(F.col("shard") / BUCKETS))
    before = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("source", "group").agg(F.sum("n").alias("total")).select("source", "group", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(bases, ["source", "group"])
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(drawn.values()) // SLOTS_A_TASK))
    slots = (
        numbered.select("shard", "source", "n", "first_slot", (F.col("base") + F.col("inside")).alias("first"))
        .repartition(tasks, "shard", "source")
        .select("shard", "source", "first_slot", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
        .join(sizes, "source")
        .select("shard", "source", (F.col("first_slot") + F.col("k")).alias("slot"), (F.col("first") + F.col("k")).alias("i"), "blocks", "cap", "first_over")
    )
    permute = F.pandas_udf(_permuted(seed), "long")
    own = slots.where("i < cap").select("shard", "slot", "source", "i", "blocks")
    if not sum(over):
        moved = own.limit(0).withColumn("filled", F.lit(True))
    else:
        at = slots.where("i >= cap").withColumn("p", permute(F.lit("redrawn"), F.lit(0), F.col("first_over") + F.col("i") - F.col("cap"), F.lit(sum(over))))
        starts = F.array(*[F.lit(sum(taken[:k])) for k in range(len(plan))])
        k = F.size(F.filter(starts, lambda x: x <= F.col("p")))
        pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("to"))
        at = at.withColumn("filled", F.col("p") < sum(taken)).withColumn("to", k)
        moved = at.select(
            "shard", "slot", F.when(F.col("filled"), pick([p["source"] for p in plan])).otherwise(F.col("source")).alias("source"),
            (F.col("p") - pick([sum(taken[:j]) for j in range(len(plan))]) + pick([drawn.get(p["source"], 0) for p in plan])).alias("i"), pick([p["blocks"] for p in plan]).alias("blocks"), "filled",
        )
    every = own.withColumn("filled", F.lit(True)).unionByName(moved).withColumn("pass", F.when(F.col("filled"), F.expr("i div nullif(blocks, 0)")))
    block = F.when(F.col("filled"), permute("source", F.coalesce("pass", F.lit(0)), F.coalesce(F.expr("i % nullif(blocks, 0)"), F.lit(0)), F.greatest("blocks", F.lit(1))))
    return every.withColumn("block", block).select("shard", "slot", "source", "pass", "block")


def mixed_sequences(docs: DataFrame, targets: DataFrame, block_tokens: int = 512, shard_slots: int = 1024, seed: int = 17, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(shard, slot, source, pass, tokens): the mix of :func:`mix_sources` as token sequences, ready to train on.

    Ids must be unique. Unfilled slots give no row.
    """
    path = tokenizer or tokenizer_file()
    listed = targets.select(canonical_source(F.col("source")).alias("_s")).distinct()
    encoded = cut_lineage(encoded_documents(docs.join(listed, canonical_source(F.col(source)) == F.col("_s"), "left_semi"), path, doc_id, text, source))
    plan = plan_sources(encoded, targets, block_tokens)
    slots = mixed_slots(draw_counts(docs.sparkSession, plan, seed, shard_slots), plan, seed).where("block IS NOT NULL")
    return slots.join(blocks_with_ids(encoded, block_tokens), ["source", "block"]).select("shard", "slot", "source", "pass", "tokens")


def mix_sources(docs: DataFrame, targets: DataFrame, block_tokens: int = 512, shard_slots: int = 1024, seed: int = 17, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(mix, report).

    Mix: shard, slot, source, pass, block, doc_id, token_from, token_to, the parts of documents that fill
    each slot (shard, slot). Report, a row per target source: source (as in the targets), target_share,
    max_repeats, docs, source_tokens, wanted_tokens, mixed_tokens, share (of the mixed tokens), unused_tokens (what the
    allowed passes of its blocks leave unused), short (used and unused together are below what is wanted), most_passes,
    unfilled_slots.

    No block, and so no part of a document, is used more than max_repeats times. Documents of other
    sources, with a NULL source, or with a NULL or empty text take no part; a source without documents
    is reported with zeros. Repeated ids are documents of their own. Targets of which spellings
    coincide must be merged beforehand.
    """
    spark = docs.sparkSession
    counted = cut_lineage(document_tokens(docs, targets, tokenizer or tokenizer_file(), doc_id, text, source))
    plan = plan_sources(counted, targets, block_tokens)
    slots = mixed_slots(draw_counts(spark, plan, seed, shard_slots), plan, seed)
    parts = blocks(counted, block_tokens)
    mix = slots.where("block IS NOT NULL").join(parts, ["source", "block"]).withColumnRenamed("doc_id", doc_id)
    mix = mix.select("shard", "slot", "source", "pass", "block", doc_id, "token_from", "token_to")
    uses = slots.where("block IS NOT NULL").groupBy("source", "block").agg(F.count(F.lit(1)).alias("uses"), (F.max("pass") + 1).alias("passes"))
    sizes = parts.groupBy("source", "block").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("size"))
    allowed = spark.createDataFrame([(p["source"], p["max_repeats"]) for p in plan], "source string, allowed long")
    used = F.coalesce("uses", F.lit(0))
    reached = (
        sizes.join(uses.hint("merge"), ["source", "block"], "left")
        .join(allowed, "source")
        .groupBy("source")
        .agg(F.sum(used * F.col("size")).alias("mixed_tokens"), F.sum((F.col("allowed") - used) * F.col("size")).alias("unused_tokens"), F.max("passes").alias("most_passes"))
    )
    unfilled = slots.where("block IS NULL").groupBy("source").agg(F.count(F.lit(1)).alias("unfilled_slots"))
    wanted = spark.createDataFrame(
        [(p["name"], p["source"], p["target_share"], p["max_repeats"], p["docs"], p["tokens"], p["wanted_tokens"]) for p in plan],
        "name string, source string, target_share double, max_repeats long, docs long, source_tokens long, wanted_tokens double",
    )
    share = F.col("mixed_tokens") / F.nullif(F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1))), F.lit(0))
    report = (
        wanted.join(reached, "source", "left")
        .join(unfilled, "source", "left")
        .fillna(0, ["mixed_tokens", "unused_tokens", "most_passes", "unfilled_slots"])
        .withColumn("share", F.coalesce(share, F.lit(0.0)))
        .withColumn("short", F.col("mixed_tokens") + F.col("unused_tokens") < F.col("wanted_tokens"))
        .drop("source")
        .withColumnRenamed("name", "source")
    )
    return mix, report
