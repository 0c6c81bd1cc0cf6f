"""Exact percentiles of few groups of any size, by distributed selection.

Spark's exact percentile keeps all distinct values of a group in one buffer. Here a group's values never meet: a pass counts them
and takes a mergeable sketch (`percentile_approx`, whose rank error is bounded), which gives two values that the wanted place
lies between; a second pass counts exactly what lies below and between them, so the bracket is verified, not trusted. Brackets
narrow until they hold few distinct values; those are counted by value, and the place is picked by their running sum. Ties cost
nothing, as equal values are counted, not kept. Memory of a task depends on the sketch's size and on `few`, not on the data.

Groups are few (`most_groups` at most, their brackets pass the driver); for many small groups the built-in percentile is right.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorefold.sources import stage


def quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float] = (0.5,), few: int = 20_000, accuracy: int = 2_000, most_groups: int = 100_000, rounds: int = 12) -> DataFrame:
    """(by, n, q0, q1, ...): count of values and the percentiles, interpolated between neighbours; nulls do not count.

    NaN counts as the largest value. Groups without a value are left out; without `by` there is always one row."""
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    rows = stage.written(rows.groupBy(*by, "_v").agg(F.count("*").alias("_n")), "value-counts")  # equal values met once per task already
    places = [F.lit(float(p)) for p in probabilities]
    # one line per group and percentile: the places (from 0) of the two neighbours, and the bracket that is known to hold both
    sizes = rows.groupBy(*by).agg(F.sum("_n").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.count("*").alias("distinct"))
    state = sizes.select(*by, "n", "low", "high", "distinct", F.posexplode(F.array(*places)).alias("p", "at")).withColumn("below", F.lit(0).cast("bigint"))
    state = state.withColumns({"first": F.floor((F.col("n") - 1) * F.col("at")).cast("bigint"), "share": (F.col("n") - 1) * F.col("at") - F.floor((F.col("n") - 1) * F.col("at"))})
    state = stage.written(state.withColumn("last", F.least(F.col("first") + 1, F.col("n") - 1)), "quantile-brackets")
    n_groups = state.count() // max(len(probabilities), 1)
    if n_groups > most_groups:
        raise ValueError(f"{n_groups} groups: use percentile for many small groups")
    for _ in range(rounds):
        if not state.where(F.col("distinct") > few).head(1):
            break
        state = stage.written(narrowed(rows, state, by, few, accuracy), "quantile-brackets")
    inside = within(rows, state, by).select(*by, "p", "first", "last", "share", "below", "n", "_v", "_n")
    running = Window.partitionBy(*by, "p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto = inside.withColumn("_upto", F.col("below") + F.sum("_n").over(running))
    picked = upto.groupBy(*by, "p").agg(
        F.first("n").alias("n"), F.first("share").alias("share"), F.min(F.when(F.col("_upto") > F.col("first"), F.col("_v"))).alias("_a"), F.min(F.when(F.col("_upto") > F.col("last"), F.col("_v"))).alias("_b")
    )
    q = F.when((F.col("share") == 0) | (F.col("_a") == F.col("_b")), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("share"))
    out = picked.withColumn("q", q).groupBy(*by).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("p") == k, F.col("q"))).alias(f"q{k}") for k in range(len(probabilities))])
    return out if by else out.withColumn("n", F.coalesce("n", F.lit(0)))


def within(rows: DataFrame, state: DataFrame, by: Sequence[str]) -> DataFrame:
    """The counted values inside each bracket; the brackets are few rows."""
    test = (F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high"))
    for c in by:
        test = test & F.col(f"_by_{c}").eqNullSafe(F.col(c))
    return rows.withColumnsRenamed({c: f"_by_{c}" for c in by}).join(F.broadcast(state), test).drop(*[f"_by_{c}" for c in by])


def narrowed(rows: DataFrame, state: DataFrame, by: Sequence[str], few: int, accuracy: int) -> DataFrame:
    """Brackets of more than `few` distinct values, cut down by a sketch of what is inside and counted again."""
    done, wide = state.where(F.col("distinct") <= few), state.where(F.col("distinct") > few)
    keys = [*by, "p"]
    # the sketch weighs distinct values alike; places among them follow from exact counts below each candidate
    cuts = within(rows, wide, by).groupBy(*keys).agg(F.percentile_approx("_v", F.array(*[F.lit(k / 64) for k in range(65)]), F.lit(accuracy)).alias("cuts"))
    cut = wide.join(cuts, keys)
    at = F.greatest(F.array_position(F.filter("cuts", lambda c: c <= F.col("_v")), F.col("_v")), F.size(F.filter("cuts", lambda c: c < F.col("_v"))))
    slots = within(rows, cut, by).withColumn("_slot", at).groupBy(*keys, "_slot").agg(F.sum("_n").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_distinct"))
    running = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    found = slots.join(F.broadcast(wide.select(*keys, "first", "last", "below")), keys).withColumn("_upto", F.col("below") + F.sum("_n").over(running))
    # the slots that hold the two places, and all between (none, as they are neighbours)
    held = found.where((F.col("_upto") > F.col("first")) & (F.col("_upto") - F.col("_n") <= F.col("last")))
    new = held.groupBy(*keys).agg(F.min("_low").alias("low"), F.max("_high").alias("high"), F.sum("_distinct").alias("distinct"), F.min(F.col("_upto") - F.col("_n")).alias("below"))
    again = wide.drop("low", "high", "distinct", "below").join(new, keys).select(*state.columns)
    return done.unionByName(again)
