"""Differences between versions of a section, paragraph by paragraph."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.documents import distinct_paragraphs

_DIFF = T.StructType([T.StructField("added", T.ArrayType(T.StringType())), T.StructField("removed", T.ArrayType(T.StringType())), T.StructField("common", T.IntegerType())])


def paragraph_diff(old: list[str], new: list[str]) -> tuple[list[str], list[str], int]:
    """(added, removed, common): by longest matching blocks; a replacement removes and adds."""
    added: list[str] = []
    removed: list[str] = []
    common = 0
    for op, a, b, c, d in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if op == "equal":
            common += b - a
        else:
            removed += old[a:b]
            added += new[c:d]
    return added, removed, common


@F.pandas_udf(_DIFF)
def sequence_diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    rows = [paragraph_diff([] if a is None else list(a), [] if b is None else list(b)) for a, b in zip(old, new)]
    return pd.DataFrame(rows, columns=["added", "removed", "common"])


def consecutive_versions(df: DataFrame, keys: list[str], year: str, version: str) -> DataFrame:
    """Keys, year_a, year_b, version_a, version_b: each version with the one before it in its chain."""
    w = Window.partitionBy(*keys).orderBy("year_b", "version_b")
    rows = df.select(*keys, F.col(year).alias("year_b"), F.col(version).alias("version_b"))
    return rows.withColumn("year_a", F.lag("year_b").over(w)).withColumn("version_a", F.lag("version_b").over(w)).where("version_a IS NOT NULL")


def section_diffs(pairs: DataFrame, texts: DataFrame, version: str, text: str) -> DataFrame:
    """Adds added, removed (arrays of paragraphs), common and state to pairs of version_a and version_b.

    state: ``both``, ``only_b`` (all of it is added), ``only_a`` (all of it is removed) or ``missing``. Paragraphs
    are those of :func:`distinct_paragraphs`, of which those with the same first 200 characters count as one; a document's paragraphs are gathered per document.
    """
    paragraphs = distinct_paragraphs(texts.select(F.col(version).alias("_v"), F.col(text).alias("_t")), ["_v"], "_t", same_start=200)
    lists = paragraphs.groupBy("_v").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "paragraph"))), lambda x: x["paragraph"]).alias("_p"))
    there = texts.select(F.col(version).alias("_v")).distinct()
    known = there.join(lists, "_v", "left").select("_v", F.coalesce("_p", F.array().cast("array<string>")).alias("_p"))
    a, b = known.select(F.col("_v").alias("version_a"), F.col("_p").alias("_a")), known.select(F.col("_v").alias("version_b"), F.col("_p").alias("_b"))
    has_a, has_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    state = F.when(has_a & has_b, "both").when(has_b, "only_b").when(has_a, "only_a").otherwise("missing")
    return pairs.join(a, "version_a", "left").join(b, "version_b", "left").withColumn("state", state).withColumn("_d", sequence_diff("_a", "_b")).select(*pairs.columns, "state", "_d.added", "_d.removed", "_d.common")


def paragraph_set_diff(pairs: DataFrame, texts: DataFrame, version: str, text: str) -> DataFrame:
    """The order-free difference: numbers of paragraphs only in b (added), only in a (removed), and in both."""
    paragraphs = distinct_paragraphs(texts.select(F.col(version).alias("_v"), F.col(text).alias("_t")), ["_v"], "_t").select("_v", F.sha2("paragraph", 256).alias("h")).distinct()
    side = lambda end, n: pairs.select("version_a", "version_b", F.col(end).alias("_v")).join(paragraphs, "_v").select("version_a", "version_b", "h", F.lit(n).alias("side"))
    both = side("version_a", 1).unionByName(side("version_b", 2)).groupBy("version_a", "version_b", "h").agg(F.sum("side").alias("side"))
    return both.groupBy("version_a", "version_b").agg(F.count_if(F.col("side") == 2).alias("added"), F.count_if(F.col("side") == 1).alias("removed"), F.count_if(F.col("side") == 3).alias("common"))
