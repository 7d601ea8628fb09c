"""Monthly metrics as arrays with one place for each day of the month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _padded(a: Column, n: Column, fill: Column) -> Column:
    """a cut or filled to n places."""
    return F.concat(F.slice(a, F.lit(1), n), F.array_repeat(fill, F.greatest(n - F.size(a), F.lit(0))))


def monthly_step(prev: DataFrame, today: DataFrame, keys: Sequence[str], value: str, day: str, fill: int | None = None, values: str = "hit_array") -> DataFrame:
    """Arrays up to the day before and one day's values make the arrays up to day.

    A place comes from the date, never from the order of loads: skipped days are filled with fill, and a
    day that is loaded again replaces its place. first_found is the earlier of what is known.
    """
    d = F.lit(day).cast("date")
    n = F.dayofmonth(d)
    none = F.lit(fill).cast("long")
    p = prev.select(*keys, F.col(values).alias("old"), F.col("first_found").alias("found"))
    t = today.select(*keys, F.col(value).cast("long").alias("new"))
    old = F.coalesce("old", F.array().cast("array<long>"))
    return p.join(t, list(keys), "full_outer").select(
        *keys,
        F.trunc(d, "month").alias("month_start"),
        F.concat(_padded(old, n - 1, none), F.array(F.coalesce("new", none))).alias(values),
        F.least("found", F.when(F.col("new").isNotNull(), d)).alias("first_found"),
    )


def monthly_arrays(daily: DataFrame, keys: Sequence[str], value: str, month_start: str, last: str, fill: int | None = None, values: str = "hit_array") -> DataFrame:
    """The arrays up to the day last in one aggregation of daily rows (keys, day, value)."""
    m, d = F.lit(month_start).cast("date"), F.lit(last).cast("date")
    by_day = F.map_from_entries(F.collect_list(F.struct("day", F.col(value).cast("long").alias("v"))))
    return (
        daily.where(F.col("day").between(m, d))
        .groupBy(*keys)
        .agg(by_day.alias("by_day"), F.min("day").alias("first_found"))
        .select(*keys, m.alias("month_start"), F.transform(F.sequence(m, d), lambda x: F.coalesce(F.col("by_day")[x], F.lit(fill).cast("long"))).alias(values), "first_found")
    )


def first_days(arrays: DataFrame, by: Sequence[str], values: str = "hit_array") -> DataFrame:
    """Sums of the first three places; short and empty arrays count 0."""
    names = ("num_hits_first_day", "num_hits_second_day", "num_hits_third_day")
    return arrays.groupBy(*by).agg(*[F.sum(F.coalesce(F.get(values, F.lit(i)), F.lit(0))).cast("long").alias(n) for i, n in enumerate(names)])


def daily_series(arrays: DataFrame, by: Sequence[str], values: str = "metric_array") -> DataFrame:
    """Sums by place as rows: by, day and value. by holds month_start."""
    each = arrays.select(*by, F.posexplode(values).alias("i", "v"))
    return each.groupBy(*by, "i").agg(F.sum("v").alias("value")).select(*by, F.date_add("month_start", F.col("i")).alias("day"), "value")


def length_histogram(arrays: DataFrame, values: str) -> DataFrame:
    return arrays.groupBy(F.size(values).alias("length")).agg(F.count("*").alias("rows"))


def host_month(events: DataFrame, host: str, visitor: str, time: str, month_start: str, last: str) -> DataFrame:
    """Hits and distinct visitors of each host and day of a month, as two arrays filled with zeros."""
    m, d = F.lit(month_start).cast("date"), F.lit(last).cast("date")
    daily = events.withColumn("day", F.to_date(time)).where(F.col("day").between(m, d)).groupBy(host, "day").agg(F.count("*").alias("hits"), F.count_distinct(visitor).alias("visitors"))
    a = daily.groupBy(host).agg(F.map_from_entries(F.collect_list(F.struct("day", F.struct("hits", "visitors")))).alias("by_day"))
    place = lambda f: F.transform(F.sequence(m, d), lambda x: F.coalesce(F.col("by_day")[x][f], F.lit(0)))
    return a.select(host, m.alias("month_start"), place("hits").alias("hit_array"), place("visitors").alias("unique_visitors"))


def host_month_step(prev: DataFrame, events: DataFrame, host: str, visitor: str, time: str, day: str) -> DataFrame:
    """host_month() up to the day before and one day's events make it up to day: both arrays get the day's place, which
    comes from the date. Days without a load are zeros, a day that is loaded again replaces its place, and what prev has of
    other months is left out."""
    d = F.lit(day).cast("date")
    n, month = F.dayofmonth(d), F.trunc(d, "month")
    today = events.where(F.to_date(time) == d).groupBy(F.col(host).alias("today")).agg(F.count("*").alias("hits"), F.count_distinct(visitor).alias("visitors"))
    p = prev.where(F.col("month_start") == month).select(host, F.col("hit_array").alias("old_hits"), F.col("unique_visitors").alias("old_visitors"))
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")
    place = lambda old, new: F.concat(_padded(F.coalesce(old, none), n - 1, zero), F.array(F.coalesce(new, zero)))
    wide = p.join(today, F.col(host).eqNullSafe(F.col("today")), "full_outer")
    return wide.select(F.coalesce(host, "today").alias(host), month.alias("month_start"), place("old_hits", "hits").alias("hit_array"), place("old_visitors", "visitors").alias("unique_visitors"))


#: Logarithm of the number of registers of a sketch: its standard error is 0.8 %, its size 16 KB at most.
REGISTERS = 14


def daily_sketches(events: DataFrame, keys: Sequence[str], visitor: str, time: str) -> DataFrame:
    """Hits of each key and day and a sketch of its visitors. Sketches of days merge to those of any longer time without
    the events, which distinct counts don't."""
    rows = events.select(*keys, F.to_date(time).alias("day"), F.col(visitor).alias("visitor"))
    return rows.groupBy(*keys, "day").agg(F.count("*").alias("hits"), F.hll_sketch_agg("visitor", F.lit(REGISTERS)).alias("sketch"))


def merged_sketches(daily: DataFrame, by: Sequence[Column | str]) -> DataFrame:
    """Hits and estimated distinct visitors by coarser keys, from daily_sketches()."""
    return daily.groupBy(*by).agg(F.sum("hits").alias("hits"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("visitors"))
