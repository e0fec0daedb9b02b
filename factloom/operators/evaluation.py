"""Evaluation analytics: accuracy, latency, failures and agreement of raters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.quantiles import order_statistics

# Failure modes, and lower bounds of kappa with their reading.
MODES = ("correct", "retrieval_miss", "table_parsing_error", "arithmetic_error", "hallucination", "tool_error", "planning_failure")
AGREEMENT = ((0.8, "almost perfect"), (0.6, "substantial"), (0.4, "moderate"), (0.2, "fair"), (0.0, "slight"))


def latency_percentiles(results: DataFrame, keys: list[str], latency: str = "latency_ms") -> DataFrame:
    """Keys, n, mean_ms, p50_ms (mean of the two middle values) and p95_ms (the value at index
    floor(0.95 n) of the ascending order) over positive latencies."""
    rows = results.where(F.col(latency) > 0)
    n = F.col("n")
    ranks = {"lo": F.floor((n - 1) / 2), "hi": F.floor(n / 2), "p95_ms": F.floor(n * 95 / 100)}
    stats = order_statistics(rows, keys, latency, ranks)
    means = rows.groupBy(*keys).agg(F.avg(latency).alias("mean_ms"))
    return stats.join(means, keys).select(*keys, "n", "mean_ms", ((F.col("lo") + F.col("hi")) / 2).alias("p50_ms"), "p95_ms")


def summary_columns() -> list[Column]:
    """Aggregates of results with numerical_match (NULL: no gold number) and faithfulness."""
    numeric = F.count("numerical_match")
    return [
        F.count(F.lit(1)).alias("n"),
        numeric.alias("n_numeric"),
        (F.count_if("numerical_match") / F.greatest(numeric, F.lit(1))).alias("accuracy"),
        F.avg("faithfulness").alias("faithfulness"),
    ]


def tier_summary(results: DataFrame) -> DataFrame:
    """One row per tier."""
    return results.groupBy("tier").agg(*summary_columns())


def overall_rollup(results: DataFrame) -> DataFrame:
    """Per tier and, with a NULL tier, over all; tiers that are NULL themselves must be filled beforehand."""
    return results.rollup("tier").agg(*summary_columns())


def failure_histogram(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Keys, failure_mode, n and pct of the group; modes that don't occur have zero rows."""
    counted = results.groupBy(*keys).agg(*[F.count_if(F.col("failure_mode") == m).alias(m) for m in MODES], F.count(F.lit(1)).alias("_all"))
    rows = counted.unpivot([*keys, "_all"], list(MODES), "failure_mode", "n")
    return rows.withColumn("pct", F.round(F.try_divide(F.col("n").cast("double"), F.col("_all").cast("double")) * 100, 6)).drop("_all")


def classify_failure(has_answer: Column, tool_errors: Column, numerical_match: Column, has_gold: Column, n_numeric: Column, n_claims: Column, tools: Column) -> Column:
    """The failure mode of one answer, by the first rule that holds."""
    used = lambda t: F.array_contains(tools, t)
    numeric = (
        F.when(numerical_match, "correct")
        .when(~used("xbrl_sql"), "table_parsing_error")
        .when(n_numeric == 0, "hallucination")
        .when(used("calculator"), "arithmetic_error")
        .otherwise("hallucination")
    )
    prose = (
        F.when(used("filing_retriever"), F.when(n_claims == 0, "hallucination").otherwise("correct"))
        .when(F.size(tools) == 0, "planning_failure")
        .otherwise("retrieval_miss")
    )
    return F.when(~has_answer, "planning_failure").when(F.size(tool_errors) > 0, "tool_error").when(has_gold, numeric).otherwise(prose)


def cohens_kappa(pairs: DataFrame, a: str, b: str, categories: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Keys, n, p_o, p_e and kappa of two raters over the given categories.

    Scores outside the categories count in n and p_o but not in p_e; kappa is 1 where p_e is 1. Pairs with a NULL
    score are left out. One pass: two counts per category.
    """
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    counts = [F.count_if(F.col(x) == c).alias(f"_{s}{i}") for i, c in enumerate(categories) for s, x in (("a", a), ("b", b))]
    agg = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("_same"), *counts)
    n = F.col("n").cast("double")
    p_e = sum((F.col(f"_a{i}") / n * (F.col(f"_b{i}") / n) for i in range(len(categories))), F.lit(0.0))
    out = agg.where("n > 0").withColumn("p_o", F.col("_same") / n).withColumn("p_e", p_e)
    kappa = F.when(F.abs(F.col("p_e") - 1) < 1e-12, 1.0).otherwise((F.col("p_o") - F.col("p_e")) / F.nullif(1 - F.col("p_e"), F.lit(0.0)))
    return out.select(*keys, "n", "p_o", "p_e", kappa.alias("kappa"))


def agreement_label(kappa: Column) -> Column:
    """The usual reading of a kappa."""
    out = F.lit("poor")
    for least, name in reversed(AGREEMENT):
        out = F.when(kappa >= least, name).otherwise(out)
    return out


def score_distribution(scores: DataFrame, raters: Sequence[str], categories: Sequence[int]) -> DataFrame:
    """score and, per rater, how often it was given; scores never given have zeros."""
    parts = [F.struct(F.lit(c).alias("score"), *[F.count_if(F.col(r) == c).alias(r) for r in raters]) for c in categories]
    return scores.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def ablation_row(config: Column, accuracy: Column, faithfulness: Column, p95_ms: Column) -> Column:
    """One line of the ablation table; N/A for a missing number."""
    pct = lambda c: F.coalesce(F.format_string("%.0f%%", c * 100), F.lit("N/A"))
    seconds = F.coalesce(F.format_string("%.1fs", p95_ms / 1000), F.lit("N/A"))
    return F.concat_ws(" | ", config, F.when(accuracy.isNull(), "N/A").otherwise(pct(accuracy)), F.when(faithfulness.isNull(), "N/A").otherwise(pct(faithfulness)), F.when(p95_ms.isNull(), "N/A").otherwise(seconds))
