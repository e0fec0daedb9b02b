"""Exact order statistics of groups of any size.

A group is never sorted in one place: its rows are counted into ranges cut at approximate quantiles, the
range that holds the wanted rank is found from the counts, and only that range is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CUTS = 64


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Keys, n and, for each name in ``ranks``, the value at that 0-based rank of the ascending order.

    A rank is a Column over ``n``, the group's number of non-NULL values; it is clamped to 0..n-1. Groups
    without a value give no row. NULL keys are a group.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    cuts = rows.groupBy(*keys).agg(
        F.approx_percentile("_v", [i / _CUTS for i in range(1, _CUTS)], 1000).alias("_cuts"), F.sum("_c").alias("n")
    )
    match = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]

    def joined(left: DataFrame, right: DataFrame, extra: list[str]) -> DataFrame:
        on = match("l", "r") or [F.lit(True)]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        return left.alias("l").join(F.broadcast(right.alias("r")) if not keys else right.alias("r"), cond).select("l.*", *[f"r.{c}" for c in extra])

    ranged = joined(rows, cuts, ["_cuts", "n"]).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    counts = ranged.groupBy(*keys, "n", "_range").agg(F.sum("_c").alias("_rc"))
    upto = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_first", F.coalesce(F.sum("_rc").over(upto), F.lit(0)))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.lit(0), F.least(rank.cast("long"), F.col("n") - 1)).alias("rank")) for name, rank in ranks.items()])
    hit = starts.withColumn("_w", F.explode(wanted)).where((F.col("_w.rank") >= F.col("_first")) & (F.col("_w.rank") < F.col("_first") + F.col("_rc")))
    hit = hit.select(*keys, "_range", "_first", F.col("_w.name").alias("_name"), F.col("_w.rank").alias("_rank"))
    on = [*match("l", "r"), F.col("l._range") == F.col("r._range")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    inside = ranged.alias("l").join(hit.alias("r"), cond).select("l.*", "r._first", "r._name", "r._rank")
    w = Window.partitionBy(*keys, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_first") + F.coalesce(F.sum("_c").over(w), F.lit(0))
    found = inside.withColumn("_at", at).where((F.col("_rank") >= F.col("_at")) & (F.col("_rank") < F.col("_at") + F.col("_c")))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Keys and the median, the mean of the two middle values for an even number."""
    out = order_statistics(df, keys, value, {"_lo": F.floor((F.col("n") - 1) / 2), "_hi": F.floor(F.col("n") / 2)})
    return out.select(*keys, ((F.col("_lo").cast("double") + F.col("_hi").cast("double")) / 2).alias(name))
