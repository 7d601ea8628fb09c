"""Growth accounting, retention, and changes between two periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _daily(first: Column, active: Column, gap: Column) -> Column:
    return (
        F.when(first, "New").when(active & (gap == 1), "Retained").when(active, "Resurrected").when(gap == 1, "Churned").otherwise("Stale")
    )


def _weekly(first: Column, active: Column, gap: Column) -> Column:
    return (
        F.when(first, "New").when(active & (gap > 7), "Resurrected").when(active | (gap <= 7), "Retained").when(gap == 8, "Churned").otherwise("Stale")
    )


def growth_step(prev: DataFrame, activity: DataFrame, key: str, day: str) -> DataFrame:
    """States as of the day before and one day's activity make the states of day. gap is the number of days
    since the last active day before it."""
    d = F.lit(day).cast("date")
    today = activity.where(F.col("day") == d).select(key, "day").distinct()
    gap, active, first = F.datediff(d, "last_active"), F.col("day").isNotNull(), F.col("last_active").isNull()
    return prev.select(key, "first_active", "last_active", "dates_active").join(today, key, "full_outer").select(
        key,
        F.coalesce("first_active", "day").alias("first_active"),
        F.coalesce("day", "last_active").alias("last_active"),
        _daily(first, active, gap).alias("daily_state"),
        _weekly(first, active, gap).alias("weekly_state"),
        F.when(first, F.array("day")).when(active, F.concat("dates_active", F.array("day"))).otherwise(F.col("dates_active")).alias("dates_active"),
        d.alias("as_of"),
    )


def growth_backfill(activity: DataFrame, key: str, first_day: str, last_day: str) -> DataFrame:
    """States of all days in one job: each key's days from its first active day on. A row holds the last
    active day, not the list of all, so it stays small."""
    lo, hi = F.lit(first_day).cast("date"), F.lit(last_day).cast("date")
    days = activity.where(F.col("day").between(lo, hi)).select(key, "day").distinct()
    spine = days.groupBy(key).agg(F.min("day").alias("first_active")).select(key, "first_active", F.explode(F.sequence("first_active", hi)).alias("as_of"))
    w = Window.partitionBy(key).orderBy("as_of")
    wide = spine.join(days.withColumnRenamed("day", "as_of").withColumn("here", F.lit(True)), [key, "as_of"], "left")
    active = F.coalesce("here", F.lit(False))
    before = F.max(F.when(active, F.col("as_of"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    got = wide.select(key, "first_active", "as_of", active.alias("active"), before.alias("before"))
    gap = F.datediff("as_of", "before")
    first = F.col("before").isNull()
    return got.select(
        key, "first_active", F.when(F.col("active"), F.col("as_of")).otherwise(F.col("before")).alias("last_active"), _daily(first, F.col("active"), gap).alias("daily_state"), _weekly(first, F.col("active"), gap).alias("weekly_state"), "as_of"
    )


def retention_curve(states: DataFrame) -> DataFrame:
    """Share of keys active on each day after their first."""
    active = F.col("last_active") == F.col("as_of")
    return (
        states.groupBy(F.datediff("as_of", "first_active").alias("days_since_first"))
        .agg(F.count("*").alias("keys"), F.count_if(active).alias("active"))
        .withColumn("share", F.col("active") / F.col("keys"))
    )


def state_changes(snapshot: DataFrame, key: str, period: str, active: str, last: int) -> DataFrame:
    """What became of each key between the last two periods."""
    now = snapshot.where(F.col(period) == last).select(key, F.col(active).alias("now"))
    was = snapshot.where(F.col(period) == last - 1).select(key, F.col(active).alias("was"))
    n, w = F.coalesce("now", F.lit(False)), F.col("was")
    label = (
        F.when(w.isNull(), "New").when(w & n, "Continued Playing").when(w, "Retired").when(n, "Returned from Retirement").otherwise("Stayed Retired")
    )
    return was.join(now, key, "full_outer").select(key, label.alias("change"))
