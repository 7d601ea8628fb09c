"""Funnels, cubes, rolling windows and streaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def funnel_conversion(events: DataFrame, key: str, time: str, step: str, target: str, min_events: int = 100) -> DataFrame:
    """For each step: its events that have a later one of the same key and day, how many of them the target
    followed that day, and the rate. Two maxima over (key, day) tell both, without a join of events with
    events; daily maxima combine before the shuffle."""
    rows = events.select(key, F.col(time).alias("t"), F.to_date(time).alias("day"), F.col(step).alias("step")).where(F.col(key).isNotNull()).distinct()
    w = Window.partitionBy(key, "day")
    wide = rows.withColumn("last", F.max("t").over(w)).withColumn("last_target", F.max(F.when(F.col("step") == target, F.col("t"))).over(w))
    followed = wide.where(F.col("t") < F.col("last"))
    return (
        followed.groupBy("step")
        .agg(F.count("*").alias("events"), F.count_if(F.col("last_target") > F.col("t")).alias("conversions"))
        .withColumn("rate", F.col("conversions") / F.col("events"))
        .where((F.col("conversions") > 0) & (F.col("events") > min_events))
    )


def cube(df: DataFrame, columns: Sequence[str], sets: Sequence[Sequence[str]], measures: Sequence[Column], missing: str = "unknown", overall: str = "(overall)") -> DataFrame:
    """Measures over grouping sets. level names the set, told by grouping() and not by null; a null value is
    missing, a column outside the set is overall. Additive measures of the finest grain can be summed before."""
    filled = df.select("*", *[F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(f"g_{c}") for c in columns])
    names = [f"g_{c}" for c in columns]
    level = F.concat_ws("__", *[F.when(F.grouping(n) == 0, c) for n, c in zip(names, columns, strict=True)])
    out = filled.groupingSets([[f"g_{c}" for c in s] for s in sets], *names).agg(level.alias("level"), *measures)
    return out.select(
        F.when(F.col("level") == "", "overall").otherwise(F.col("level")).alias("level"), *[F.coalesce(n, F.lit(overall)).alias(c) for n, c in zip(names, columns, strict=True)], *out.columns[len(names) + 1 :]
    )


def leaders(cubed: DataFrame, level: str, who: Sequence[str], measure: str, n: int = 1) -> DataFrame:
    """The n first of a level by a measure, ties by name."""
    return cubed.where(F.col("level") == level).orderBy(F.col(measure).desc(), *who).limit(n).select(*who, measure)


def traffic_windows(daily: DataFrame, keys: Sequence[str], day: str = "day", hits: str = "hits", min_total: int = 0, by: str = "rows") -> DataFrame:
    """Trends of daily counts of keys: totals, running sum, the last 7 and the 7 before, shares. by: rows counts days that
    have a row, days counts days of the calendar, so that a week is one where days are missing; a week without any row is null.

    daily has one row per keys and day, so a window partition is as long as there are days. All windows
    work on one shuffle by keys.
    """
    w = Window.partitionBy(*keys)
    o = w.orderBy(day)
    month = Window.partitionBy(*keys, "month_start")
    h = F.col(hits)
    numbered = w.orderBy(F.datediff(day, F.lit("1970-01-01").cast("date")))
    last = {"rows": o.rowsBetween, "days": numbered.rangeBetween}[by]
    got = daily.withColumn("month_start", F.trunc(day, "month")).select(
        *keys, day, "month_start", hits,
        F.sum(h).over(month).alias("month_total"), F.sum(h).over(w).alias("total"), F.sum(h).over(o.rangeBetween(Window.unboundedPreceding, 0)).alias("running"),
        F.sum(h).over(last(-6, 0)).alias("rolling_7"), F.sum(h).over(last(-13, -7)).alias("rolling_7_before"),
    )
    return got.where(F.col("total") > min_total).withColumns({"month_share": h / F.col("month_total"), "total_share": h / F.col("total")})


def best_stretch(games: DataFrame, team: str, order: Sequence[str], win: str, n: int = 90) -> DataFrame:
    """The most wins of each team in n games in a row. games has one row per team and game."""
    w = Window.partitionBy(team).orderBy(*order).rowsBetween(1 - n, 0)
    return games.withColumn("wins", F.sum(F.col(win).cast("int")).over(w)).groupBy(team).agg(F.max("wins").alias("best_wins"))


def longest_streak(rows: DataFrame, key: str, order: Sequence[str], hit: Column) -> DataFrame:
    """The longest run of rows in order for which hit holds; a null hit breaks it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    good = F.coalesce(hit, F.lit(False))
    marked = rows.select(key, good.alias("good"), F.sum((~good).cast("int")).over(w).alias("island"))
    return marked.groupBy(key, "island").agg(F.count_if("good").alias("n")).groupBy(key).agg(F.max("n").alias("longest_streak"))


def top_n(df: DataFrame, measure: str, ties: Sequence[str], n: int) -> DataFrame:
    """The n first rows, taken without a full sort."""
    return df.orderBy(F.col(measure).desc(), *ties).limit(n)
