"""References to records that do not exist.

Parent and child keys are unioned in one tagged long form and grouped by (parent, key). A key
without a parent row is an orphan; a key whose parent came after one of its children has late
references. Children are reduced per key before the shuffle, so a hot key arrives as a few partial
rows. The table of faulty keys is written once and joined back to the child rows: broadcast if it is small, so that
child rows stay where they are, else by a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import cut_lineage

#: Most faulty keys that are broadcast.
BROADCAST_KEYS = 200_000

@dataclass(frozen=True)
class Parent:
    """A table that owns keys: ``key`` is NULL where a row owns none, ``since`` says when the row came, ``period`` are the
    (fiscal_year, fiscal_period) that children without one of their own take over."""

    name: str
    rows: DataFrame
    key: Column
    since: Column
    period: tuple[Column, Column] | None = None


@dataclass(frozen=True)
class Child:
    """A field that refers to a parent; ``period`` are (fiscal_year, fiscal_period) of the record, None if it has none."""

    table: str
    field: str
    parent: str
    rows: DataFrame
    record_id: Column
    key: Column
    since: Column
    period: tuple[Column, Column] | None


_LONG = ("parent", "key", "is_parent", "parent_since", "child_since", "is_deleted")
_PERIOD = "struct<fiscal_year: int, fiscal_period: string>"


def _period(period: tuple[Column, Column] | None) -> Column:
    return F.struct(period[0].cast("int").alias("fiscal_year"), period[1].cast("string").alias("fiscal_period")) if period else F.lit(None).cast(_PERIOD)


def _children(children: Sequence[Child]) -> DataFrame:
    parts = [
        c.rows.select(
            F.lit(c.parent).alias("parent"),
            c.key.alias("key"),
            F.lit(c.table).alias("ref_table"),
            F.lit(c.field).alias("ref_field"),
            c.record_id.cast("string").alias("record_id"),
            c.since.cast("timestamp_ntz").alias("since"),
            _period(c.period).alias("period"),
        ).where(F.col("key").isNotNull())
        for c in children
    ]
    return reduce(DataFrame.unionByName, parts)


def faulty_keys(parents: Sequence[Parent], children: Sequence[Child], deleted: DataFrame) -> DataFrame:
    """(parent, key, has_parent, parent_since, is_deleted) of keys with an orphan or a late reference.

    ``deleted`` holds (parent, key) of keys removed at some time. parent_since is NULL for orphans.
    """
    none_ts, no = F.lit(None).cast("timestamp_ntz"), F.lit(False)
    tagged = [
        p.rows.select(
            F.lit(p.name).alias("parent"), p.key.alias("key"), F.lit(True).alias("is_parent"),
            p.since.cast("timestamp_ntz").alias("parent_since"), none_ts.alias("child_since"), no.alias("is_deleted"),
        )
        for p in parents
    ]
    tagged.append(
        _children(children).select(
            "parent", "key", no.alias("is_parent"), none_ts.alias("parent_since"),
            F.coalesce("since", F.lit("9999-12-31").cast("timestamp_ntz")).alias("child_since"), no.alias("is_deleted"),
        )
    )
    tagged.append(deleted.select("parent", "key", no.alias("is_parent"), none_ts.alias("parent_since"), none_ts.alias("child_since"), F.lit(True).alias("is_deleted")))
    long = reduce(DataFrame.unionByName, tagged).where(F.col("key").isNotNull()).select(*_LONG)
    return (
        long.groupBy("parent", "key")
        .agg(
            F.max("is_parent").alias("has_parent"),
            F.min("parent_since").alias("parent_since"),
            F.min("child_since").alias("first_child"),
            F.max("is_deleted").alias("is_deleted"),
        )
        .where(F.col("first_child").isNotNull() & (~F.col("has_parent") | (F.col("first_child") < F.col("parent_since"))))
        .select("parent", "key", "has_parent", "parent_since", "is_deleted")
    )


def _faulty(parents: Sequence[Parent], children: Sequence[Child], deleted: DataFrame) -> DataFrame:
    """Child rows of faulty keys with ref_state."""
    keys = cut_lineage(faulty_keys(parents, children, deleted))
    state = (
        F.when(~F.col("has_parent"), F.when(F.col("is_deleted"), "deleted").otherwise("missing"))
        .when(F.col("since") < F.col("parent_since"), "late")
    )
    rows = _children(children).join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, ["parent", "key"])
    return rows.withColumn("ref_state", state).where("ref_state IS NOT NULL")


def _with_periods(faulty: DataFrame, parents: Sequence[Parent]) -> DataFrame:
    """Late references without a period of their own take over that of the earliest parent row of their key."""
    own = [p.rows.select(F.lit(p.name).alias("parent"), p.key.alias("key"), p.since.cast("timestamp_ntz").alias("_since"), _period(p.period).alias("_period")) for p in parents if p.period]
    if own:
        first = reduce(DataFrame.unionByName, own).groupBy("parent", "key").agg(F.min_by("_period", F.struct("_since", "_period")).alias("_period"))
        lacking = faulty.where("period IS NULL AND ref_state = 'late'").join(first, ["parent", "key"], "left").withColumn("period", F.col("_period")).drop("_period")
        faulty = faulty.where("NOT (period IS NULL AND ref_state = 'late')").unionByName(lacking)
    return faulty.withColumns({"fiscal_year": F.col("period.fiscal_year"), "fiscal_period": F.col("period.fiscal_period")})


def orphan_references(parents: Sequence[Parent], children: Sequence[Child], deleted: DataFrame, periods: bool = True) -> DataFrame:
    """One row per faulty reference: ref_table, ref_field, record_id, fiscal_year and fiscal_period (if ``periods``), ref_state.

    ref_state is ``deleted`` or ``missing`` for keys no parent row has (by whether the key is in
    ``deleted``), ``late`` where the record is older than the earliest parent row of its key.
    NULL and blank keys refer to nothing and give no row; a key that was deleted and has come back
    counts as present; a record without a time is never late, nor is any record of a parent without
    one. Repeated records give a row each. An empty table gives no row.
    """
    faulty = _faulty(parents, children, deleted)
    if not periods:
        return faulty.select("ref_table", "ref_field", "record_id", "ref_state")
    return _with_periods(faulty, parents).select("ref_table", "ref_field", "record_id", "fiscal_year", "fiscal_period", "ref_state")


def orphan_counts(parents: Sequence[Parent], children: Sequence[Child], deleted: DataFrame) -> DataFrame:
    """Keys without a parent, counted: ref_table, ref_field, fiscal_year, fiscal_period, ref_state,
    n_records, n_keys. The same cases as :func:`orphan_references`; a NULL period is a group of its own, which holds the
    orphans of a table without periods. Counted per key first, so a hot key is one row of the second grouping.
    """
    by = ["ref_table", "ref_field", "fiscal_year", "fiscal_period", "ref_state"]
    rows = _with_periods(_faulty(parents, children, deleted), parents)
    return rows.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.sum("n").alias("n_records"), F.count(F.lit(1)).alias("n_keys"))
