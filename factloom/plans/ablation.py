"""Questions under several configurations of a straight pipeline, set-wise over all questions.

A configuration is the set of steps it runs. Steps that plan and reflect with a language model are named, for results of
such runs are compared here, but they are no work for Spark and are not run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.keys import accession_key
from factloom.functions.numbers import extract_numbers
from factloom.operators import evaluation as ev
from factloom.operators import search, vectors
from factloom.operators import verification as vf
from factloom.operators.facts import query_facts
from factloom.session import cut_lineage

# Fixed value: the concept of the facts step, whatever the question asks for.
FACTS_CONCEPT = "revenue"
#: Questions that are broadcast at once.
QUESTIONS_A_BLOCK = 50_000
# Names of the configurations. Each runs its own step after those of the ones above it.
STEPS = (
    ("Vanilla RAG", "lexical"),
    ("+ Hybrid retrieval", "dense and rerank"),
    ("+ XBRL tools", "facts"),
    ("+ Agentic planning", "planning"),
    ("+ Reflection loop", "reflection"),
)
RUN_HERE = ("lexical", "dense and rerank", "facts")


def steps_of(name: str) -> list[str]:
    """The steps of a configuration; ValueError for an unknown one and for one with steps that aren't run here."""
    names = [n for n, _ in STEPS]
    if name not in names:
        raise ValueError(f"unknown configuration: {name}")
    steps = [s for _, s in STEPS[: names.index(name) + 1]]
    if missing := [s for s in steps if s not in RUN_HERE]:
        raise ValueError(f"{name}: not run here: {', '.join(missing)}")
    return steps


def lexical(questions: DataFrame, chunks: DataFrame, pool: int = 20) -> DataFrame:
    """(query, doc, score, rank): the best chunks of each question by BM25."""
    return search.search(chunks, questions, "id", "text", "id", "text", pool)


def retrieve(
    questions: DataFrame, chunks: DataFrame, steps: Sequence[str], vector: Callable[[Column], Column] | None, k: int = 10, pool: int = 20, found: DataFrame | None = None
) -> DataFrame:
    """(query, doc, rank, text) of questions (id, text) over chunks (id, text) by the given steps.

    ``found``: the result of :func:`lexical`, if it is there already.
    """
    best = lexical(questions, chunks, pool) if found is None else found
    hybrid = "dense and rerank" in steps
    if hybrid:
        if vector is None:
            raise ValueError("dense retrieval needs a vector")
        dense = vectors.nearest(questions.select("id", vector(F.col("text")).alias("v")), chunks.select("id", vector(F.col("text")).alias("v")), pool, "id", "v")
        best = search.fuse([best, dense], ["bm25", "dense"]).where(F.col("rank") <= pool)
    rows = best.select("query", "doc", "rank").join(chunks.select(F.col("id").alias("doc"), "text"), "doc")
    if hybrid:
        asked = questions.select(F.col("id").alias("query"), F.col("text").alias("question"))
        scored = rows.join(asked, "query").withColumnRenamed("rank", "fused_rank")
        return search.rerank(scored, search.term_overlap(F.col("question"), F.col("text")), k).select("query", "doc", "rank", "text")
    return rows.where(F.col("rank") <= k)


def fact_claims(questions: DataFrame, facts: DataFrame, companies: DataFrame, tolerance_pct: float = 0.5) -> DataFrame:
    """id, n_facts, n_cited, least_error, hit_error: the revenue facts of each question as claims against its gold value.

    Questions may have arrays ``tickers`` and ``fiscal_years``; missing, NULL and empty ones are no filter. A fact without
    an accession number is a claim without citation. hit_error is that of the first fact within the
    tolerance, by ticker, period end and id; NULL where none is. Questions are broadcast in blocks of bounded size; facts are reduced
    to a row per question before the shuffle.
    """
    asked = questions.select("id", "gold", *[F.col(c).alias(f"_{c}") for c in ("tickers", "fiscal_years") if c in questions.columns])
    known = query_facts(facts, companies, FACTS_CONCEPT).where("value IS NOT NULL")
    known = known.select("ticker", "fiscal_year", "period_end", F.col("id").alias("fact"), F.col("value").cast("double").alias("value"), accession_key(F.col("accession_number")).isNotNull().alias("cited"))
    open_ = lambda c: (F.coalesce(F.size(c), F.lit(0)) <= 0)
    meant = F.lit(True)
    for many, one in (("_tickers", "ticker"), ("_fiscal_years", "fiscal_year")):
        if many in asked.columns:
            meant = meant & (open_(many) | F.array_contains(many, F.col(one)))
    n = -(-questions.count() // QUESTIONS_A_BLOCK) or 1
    blocks = [known.join(F.broadcast(asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k)), meant) for k in range(n)]
    pairs = reduce(DataFrame.unionByName, blocks).withColumn("error", vf.gold_error(F.col("gold"), F.col("value")))
    counts = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n_facts"), F.count_if("cited").alias("n_cited"), F.min("error").alias("least_error"))
    hits = pairs.where(F.col("error") <= tolerance_pct).groupBy("id").agg(F.min_by("error", F.struct("ticker", "period_end", "fact")).alias("hit_error"))
    return counts.join(hits, "id", "left")


def evaluate_all(
    questions: DataFrame, chunks: DataFrame, configs: Sequence[str], vector: Callable[[Column], Column], facts: DataFrame | None = None, companies: DataFrame | None = None
) -> DataFrame:
    """config, id, tier, numerical_match, error_pct, faithfulness, failure_mode of each question under each configuration.

    ``questions``: id, tier, text, gold (a number or NULL), and the filters of :func:`fact_claims`. The answer's numeric claims are
    the numbers of the best text, which cite it, then, with the facts step, a number per fact, which cites its filing.
    The facts are evidence of the same answer: as in the reference, its only tool is the retriever.
    What configurations have in common is retrieved once.
    """
    steps = {name: steps_of(name) for name in configs}
    if any("facts" in s for s in steps.values()) and (facts is None or companies is None):
        raise ValueError("the facts step needs facts and companies")
    asked = questions.select("id", "text")
    first = cut_lineage(lexical(asked, chunks))
    best: dict[bool, DataFrame] = {}
    out = None
    for name, own in steps.items():
        how = "dense and rerank" in own
        if how not in best:
            best[how] = cut_lineage(retrieve(asked, chunks, own, vector, found=first).where("rank = 1"))
        scored = _scored(questions, best[how], name, fact_claims(questions, facts, companies) if "facts" in own else None)
        out = scored if out is None else out.unionByName(scored)
    return out


def _scored(questions: DataFrame, best: DataFrame, config: str, claims: DataFrame | None) -> DataFrame:
    top = best.select(F.col("query").alias("id"), "doc", F.transform(extract_numbers("text"), lambda x: x["value"]).alias("values"))
    rows = questions.join(top, "id", "left").withColumn("acc", vf.numeric_accuracy(F.col("gold"), F.col("values")))
    if claims is None:
        rows = rows.select("*", F.lit(0).alias("n_facts"), F.lit(0).alias("n_cited"), *[F.lit(None).cast("double").alias(c) for c in ("least_error", "hit_error")])
    else:
        rows = rows.join(claims, "id", "left").fillna(0, ["n_facts", "n_cited"])
    in_text = F.when(F.col("values").isNull(), 0).otherwise(F.size("values"))
    n = in_text + F.col("n_facts")
    cited = F.when(F.col("doc").isNull(), 0).otherwise(in_text) + F.col("n_cited")
    matched = F.col("acc.matched") | (F.col("gold").isNotNull() & F.col("hit_error").isNotNull())
    error = F.when(F.col("acc.matched"), F.col("acc.error_pct")).otherwise(F.coalesce("hit_error", F.least("acc.error_pct", "least_error")))
    tools = F.array(F.lit("filing_retriever"))
    mode = ev.classify_failure(F.col("values").isNotNull() | (F.col("n_facts") > 0), F.array().cast("array<string>"), matched, F.col("gold").isNotNull(), n, n, tools)
    return rows.select(
        F.lit(config).alias("config"), "id", "tier", matched.alias("numerical_match"), error.alias("error_pct"),
        F.when(n == 0, 1.0).otherwise(cited / n).alias("faithfulness"), mode.alias("failure_mode"),
    )


def clamp_score(score: Column, has_gold: Column) -> Column:
    """A judge's score between 0 and 3; -1 where there is no gold answer."""
    return F.when(has_gold, F.greatest(F.lit(0), F.least(F.lit(3), score.cast("int")))).otherwise(-1)
