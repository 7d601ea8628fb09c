"""Cumulative snapshots: one row per key and period that carries its whole history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY, PERIOD, CLASS, SINCE, ACTIVE = "history", "period", "class", "periods_since_active", "is_active"


def collapse_period(rows: DataFrame, key: str, period: str, value: str, fields: Sequence[str]) -> DataFrame:
    """One row per key and period: the period's rows as a sorted array of structs, and the mean of value. Done
    before any join, so several rows of one period can't multiply."""
    return rows.groupBy(key, F.col(period).alias(PERIOD)).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("items"), F.avg(value).alias("mean_value"))


def cumulate_step(prev: DataFrame, today: DataFrame, key: str, period: int, banding) -> DataFrame:
    """Yesterday's snapshot and one collapsed period make the next snapshot.

    A key of both gets today's items appended; a key only of prev keeps its history and class and is
    one period longer inactive; a new key starts. banding turns mean_value into a class.
    """
    p, t = prev.alias("p"), today.where(F.col(PERIOD) == period).alias("t")
    here = F.col("t." + PERIOD).isNotNull()
    empty = F.col("t.items")
    return p.join(t, F.col(f"p.{key}") == F.col(f"t.{key}"), "full_outer").select(
        F.coalesce(f"p.{key}", f"t.{key}").alias(key),
        F.when(F.col(f"p.{HISTORY}").isNull(), empty).when(here, F.concat(f"p.{HISTORY}", "t.items")).otherwise(F.col(f"p.{HISTORY}")).alias(HISTORY),
        F.when(here, banding(F.col("t.mean_value"))).otherwise(F.col(f"p.{CLASS}")).alias(CLASS),
        F.when(here, 0).otherwise(F.col(f"p.{SINCE}") + 1).cast("int").alias(SINCE),
        here.alias(ACTIVE),
        F.lit(period).alias(PERIOD),
    )


def cumulate_backfill(collapsed: DataFrame, key: str, last: int, banding) -> DataFrame:
    """Every period's snapshot up to last in one job: each key's periods from its first on, with running
    windows over one shuffle on the key."""
    up_to = collapsed.where(F.col(PERIOD) <= last).withColumn(CLASS, banding(F.col("mean_value")))
    spine = up_to.groupBy(key).agg(F.min(PERIOD).alias("first")).select(key, F.explode(F.sequence("first", F.lit(last))).alias(PERIOD))
    w = Window.partitionBy(key).orderBy(PERIOD).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col("items").isNotNull(), F.col(PERIOD))
    return spine.join(up_to, [key, PERIOD], "left").select(
        key,
        F.flatten(F.collect_list("items").over(w)).alias(HISTORY),
        F.last(CLASS, ignorenulls=True).over(w).alias(CLASS),
        (F.col(PERIOD) - F.max(seen).over(w)).cast("int").alias(SINCE),
        seen.isNotNull().alias(ACTIVE),
        PERIOD,
    )


def snapshot_as_of(collapsed: DataFrame, key: str, as_of: int, banding) -> DataFrame:
    """The snapshot of one period, as the steps up to it would give it, in one aggregation of the keys' periods: no
    other period's histories are made."""
    periods = F.sort_array(F.collect_list(F.struct(PERIOD, "items")))
    got = collapsed.where(F.col(PERIOD) <= as_of).groupBy(key).agg(periods.alias("periods"), F.max_by("mean_value", PERIOD).alias("mean_value"), F.max(PERIOD).alias("last"))
    return got.select(
        key,
        F.flatten(F.transform("periods", lambda x: x["items"])).alias(HISTORY),
        banding(F.col("mean_value")).alias(CLASS),
        (F.lit(as_of) - F.col("last")).cast("int").alias(SINCE),
        (F.col("last") == as_of).alias(ACTIVE),
        F.lit(as_of).alias(PERIOD),
    )


def unnest_history(snapshot: DataFrame, key: str) -> DataFrame:
    """One row for each item of the history."""
    return snapshot.select(key, F.inline(HISTORY))


def ratio_last_first(snapshot: DataFrame, key: str, field: str) -> DataFrame:
    """The last item's field over the first's; a first of zero counts as 1."""
    first, last = F.col(HISTORY)[0][field], F.element_at(HISTORY, -1)[field]
    return snapshot.select(key, (last / F.when(first == 0, 1).otherwise(first)).alias("ratio"))


def last_period(df: DataFrame, column: str) -> Column:
    """A column's maximum as a scalar subquery."""
    return df.agg(F.max(column)).scalar()


def latest(df: DataFrame, column: str = PERIOD) -> DataFrame:
    """The rows of the last period there is; none of an empty table."""
    return df.where(F.col(column) == last_period(df, column))


def ever_active(snapshots: DataFrame, key: str) -> DataFrame:
    """Whether a key is active in any and in every of its periods; null flags don't count."""
    return snapshots.groupBy(key).agg(F.bool_or(ACTIVE).alias("ever_active"), F.bool_and(ACTIVE).alias("always_active"))
