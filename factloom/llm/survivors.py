"""One surviving record for each group of duplicates, by currency reasoning.

Which of two values of a field is the newer one is learned from all groups whose rows carry a
timestamp: every step from one value to the next within a group counts for (before, after), and the
majority over all groups decides the direction of a pair. The learned order of a field is closed transitively; values on
a cycle are not ordered among themselves.

Values of rows without a timestamp take their place in the partial order of their group, field by field: a value that a
dated row of the group shares has that row's time, a value known to follow a dated one comes right after it, and
values with the same footing are put by how many values the closed order has before them, so the topologically
latest comes last. Each field of the record is its own latest value. The surviving row is the latest among the
most complete ones, where a row without a timestamp stands at the place of its first field that has one.

Rows are grouped by a 128 bit digest of the key, in one shuffle that counts and chooses; the rest is done only where rows
lack a timestamp. What is learned comes from the distinct (group, field,
time, value), so a value that returns counts again; a hot group is cut into hours for that. Elsewhere
(group, field, value) is reduced before it is ordered: tags, units, periods and forms of a taxonomy, not records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.keys import age, digest
from factloom.session import cut_lineage


def _keyed(df: DataFrame, keys: Sequence[Column], record_id: str, value: str, time: str, fields: Sequence[str], keep: Sequence[Column] = ()) -> DataFrame:
    """grp, id, val, at, f0..fn and the ``keep`` columns."""
    return df.select(
        digest(*keys).alias("grp"), F.col(record_id).cast("string").alias("id"), F.col(value).alias("val"), F.col(time).alias("at"),
        *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)], *keep,
    )


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows of groups of two or more."""
    return rows.join(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp"), "grp", "left_semi")


def _states(members: DataFrame, n_fields: int) -> DataFrame:
    """Distinct (grp, field, state) with the latest time it was seen at (NULL: never dated)."""
    parts = ", ".join(f"{i}, f{i}" for i in range(n_fields))
    return (
        members.selectExpr("grp", "at", f"stack({n_fields}, {parts}) AS (field, state)")
        .where("state IS NOT NULL")
        .groupBy("grp", "field", "state")
        .agg(F.max("at").alias("seen"))
    )


def _steps(members: DataFrame, n_fields: int) -> DataFrame:
    """(field, prev, state): every step of a group from a value to another one at the next time that has any.

    Of several values at one time each is a step's end. Only fields with two values or more in their group are
    unrolled. A group is ordered hour by hour, and the hours by their first and last values, so no
    window holds more of a hot group than an hour or the calendar.
    """
    dated = members.where(F.col("at").isNotNull())
    changing = [(F.min(f"f{i}") < F.max(f"f{i}")).alias(f"c{i}") for i in range(n_fields)]
    varied = dated.groupBy("grp").agg(*changing).where(" OR ".join(f"c{i}" for i in range(n_fields)))
    parts = ", ".join(f"{i}, CASE WHEN c{i} THEN f{i} END" for i in range(n_fields))
    values = dated.join(varied, "grp").selectExpr("grp", "at", f"stack({n_fields}, {parts}) AS (field, state)").where("state IS NOT NULL")
    times = values.groupBy("grp", "field", "at").agg(F.collect_set("state").alias("states")).withColumn("hour", F.date_trunc("hour", "at"))
    hours = times.groupBy("grp", "field", "hour").agg(F.min_by("states", "at").alias("states"), F.max_by("states", "at").alias("last"))
    within = times.withColumn("prev", F.lag("states").over(Window.partitionBy("grp", "field", "hour").orderBy("at")))
    across = hours.withColumn("prev", F.lag("last").over(Window.partitionBy("grp", "field").orderBy("hour")))
    pairs = within.select("field", "prev", "states").unionByName(across.select("field", "prev", "states"))
    return pairs.select("field", "states", F.explode("prev").alias("prev")).select("field", "prev", F.explode("states").alias("state")).where("prev <> state")


def learn_precedence(members: DataFrame, n_fields: int) -> DataFrame:
    """(field, before, after, support, against) learned from the steps of all groups.

    A pair whose two directions are equally frequent stays unordered and gives no row. Values that
    share a time are no step.
    """
    steps = _steps(members, n_fields)
    rising = F.col("prev") < F.col("state")
    return (
        steps.groupBy("field", F.least("prev", "state").alias("lo"), F.greatest("prev", "state").alias("hi"))
        .agg(F.sum(rising.cast("long")).alias("up"), F.sum((~rising).cast("long")).alias("down"))
        .where("up <> down")
        .select(
            "field",
            F.when(F.col("up") > F.col("down"), F.col("lo")).otherwise(F.col("hi")).alias("before"),
            F.when(F.col("up") > F.col("down"), F.col("hi")).otherwise(F.col("lo")).alias("after"),
            F.greatest("up", "down").alias("support"),
            F.least("up", "down").alias("against"),
        )
    )


def closed_order(precedence: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(field, before, after) of all values that follow another one in the learned order, directly or through others.

    Path lengths double each round. Values that follow each other both ways lie on a cycle and are not ordered.
    The table is that of a taxonomy's values which compete for the same figures.
    """
    closed, n = cut_lineage(precedence.select("field", "before", "after").distinct()), -1
    for _ in range(most_rounds):
        now = closed.count()
        if now == n:
            back = closed.select("field", F.col("before").alias("after"), F.col("after").alias("before"))
            return closed.where("before <> after").join(back, ["field", "before", "after"], "left_anti")
        n = now
        a, b = closed.select("field", "before", F.col("after").alias("via")), closed.select("field", F.col("before").alias("via"), "after")
        closed = cut_lineage(closed.unionByName(a.join(b, ["field", "via"]).select("field", "before", "after")).distinct())
    raise RuntimeError(f"the order did not close in {most_rounds} rounds")


def value_places(members: DataFrame, precedence: DataFrame, n_fields: int) -> DataFrame:
    """(grp, field, state, seen, step, level) of the values of rows without a time, as far as anything is known of them.

    seen is the latest time the value is known to be at (step 0) or after (step 1), NULL if none; level is how many values
    come before it in the closed order.
    """
    parts = ", ".join(f"{i}, f{i}" for i in range(n_fields))
    wanted = members.where("at IS NULL").selectExpr("grp", f"stack({n_fields}, {parts}) AS (field, state)").where("state IS NOT NULL").distinct()
    dated = _states(members, n_fields).where("seen IS NOT NULL")
    order = cut_lineage(closed_order(precedence))
    same = wanted.join(dated, ["grp", "field", "state"]).select("grp", "field", "state", "seen", F.lit(0).alias("step"))
    later = (
        wanted.join(order.withColumnRenamed("after", "state"), ["field", "state"])
        .join(dated.withColumnRenamed("state", "before"), ["grp", "field", "before"])
        .select("grp", "field", "state", "seen", F.lit(1).alias("step"))
    )
    anchors = same.unionByName(later).groupBy("grp", "field", "state").agg(F.max(F.struct("seen", "step")).alias("anchor"))
    known = precedence.select("field", F.explode(F.array("before", "after")).alias("state")).distinct()
    above = order.groupBy("field", F.col("after").alias("state")).agg(F.count(F.lit(1)).alias("level"))
    levels = known.join(above, ["field", "state"], "left").select("field", "state", F.coalesce("level", F.lit(0)).alias("level"))
    return (
        wanted.join(anchors, ["grp", "field", "state"], "left")
        .join(levels, ["field", "state"], "left")
        .where("anchor IS NOT NULL OR level IS NOT NULL")
        .select("grp", "field", "state", "anchor.seen", F.coalesce("anchor.step", F.lit(0)).alias("step"), F.coalesce("level", F.lit(0)).alias("level"))
    )


def _ranked(rows: DataFrame, n_fields: int, time_type: str, placed: bool) -> DataFrame:
    """Adds ``currency`` and one ``c{i}`` per field: structs that sort from the latest to the earliest place.

    Dated or placed before unplaced, then time, step and level downwards, then the id upwards, so ties fall to
    the smallest id. With ``placed``, rows have a map ``places`` from (field, value) to (seen, step, level).
    """

    def rank(seen: Column, step: Column, level: Column) -> Column:
        return F.struct(seen.isNull().alias("unplaced"), age(seen, time_type).alias("age"), (-step).alias("step"), (-level).alias("level"), F.col("id").alias("id"))

    at, none = F.col("at"), F.lit(0)
    if not placed:
        own = rank(at, none, none.cast("long"))
        return rows.select("*", own.alias("currency"), *[own.alias(f"c{i}") for i in range(n_fields)])
    place = [F.try_element_at("places", F.struct(F.lit(i).alias("field"), F.col(f"f{i}").alias("state"))) for i in range(n_fields)]
    first = F.coalesce(*place)
    ranks = [rank(p["seen"], F.coalesce(p["step"], none), F.coalesce(p["level"], F.lit(0).cast("long"))) for p in (first, *place)]
    return rows.select("*", ranks[0].alias("currency"), *[r.alias(f"c{i}") for i, r in enumerate(ranks[1:])]).drop("places")


def surviving_records(ranked: DataFrame, fields: Sequence[str], counted: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per group: survivor_id, the ``keep`` columns, val and each field, n_records.

    The survivor has a value rather than NULL, then the most non-NULL fields among ``counted``, then
    the latest place in the currency order, then the smallest id. val is taken from the latest row that has one, and each
    field is its own latest value, whichever row survives; NULL where no row has one. Repeated
    rows count as records of their own; a group of one row gives no output.
    """
    filled = sum((F.col(f"f{list(fields).index(f)}").isNotNull().cast("int") for f in counted), F.lit(0))
    choice = F.struct(F.col("val").isNull().alias("empty"), (-filled).alias("filled"), F.col("currency").alias("currency"))
    latest = lambda c, by: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(by)))
    return (
        ranked.groupBy("grp")
        .agg(
            F.min(choice).getField("currency").getField("id").alias("survivor_id"),
            *[F.first(k, ignorenulls=True).alias(k) for k in keep],
            latest("val", "currency").alias("val"),
            *[latest(f"f{i}", f"c{i}").alias(f) for i, f in enumerate(fields)],
            F.count(F.lit(1)).alias("n_records"),
        )
        .where("n_records > 1")
    )


def best_representatives(df: DataFrame, keys: Sequence[Column], record_id: str, value: str, time: str, fields: Sequence[str], counted: Sequence[str], keep: Sequence[Column] = ()) -> tuple[DataFrame, DataFrame]:
    """(one row per group of duplicates, learned precedence).

    ``keys`` say which rows are one record; NULL equals NULL in them, so leave rows without a usable
    key out beforehand. Where every row is dated, the order is that of the dates and nothing needs to be learned for the
    first result. An empty table gives two empty results.
    """
    time_type, n = dict(df.dtypes)[time], len(fields)
    rows = _keyed(df, keys, record_id, value, time, fields, keep)
    kept = rows.columns[4 + n :]
    if not df.where(F.col(time).isNull()).take(1):
        records = surviving_records(_ranked(rows, n, time_type, False), fields, counted, kept)
        return records.drop("grp"), learn_precedence(_repeated(rows), n)
    members = cut_lineage(_repeated(rows))
    precedence = cut_lineage(learn_precedence(members, n))
    place = F.struct(F.struct("field", "state").alias("key"), F.struct("seen", "step", "level").alias("value"))
    places = value_places(members, precedence, n).groupBy("grp").agg(F.map_from_entries(F.collect_list(place)).alias("places"))
    undated = members.where("at IS NULL").join(places, "grp", "left")
    ranked = _ranked(members.where("at IS NOT NULL"), n, time_type, False).unionByName(_ranked(undated, n, time_type, True))
    return surviving_records(ranked, fields, counted, kept).drop("grp"), precedence
