"""Lists of active days, and days as bits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import bits_of_days, days_ago_mask, month_bits

DATES = "dates_active"


def datelist_step(prev: DataFrame, activity: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """The lists as of the day before and one day's activity make the lists as of day. A day that is in
    the list already isn't added again, so a repeated load changes nothing."""
    today = activity.where(F.col("day") == F.lit(day).cast("date")).select(*keys, F.col("day").alias("today")).distinct()
    return prev.select(*keys, DATES).join(today, list(keys), "full_outer").select(
        *keys,
        F.when(F.col(DATES).isNull(), F.array("today")).when(F.col("today").isNull(), F.col(DATES)).otherwise(F.array_union(DATES, F.array("today"))).alias(DATES),
        F.lit(day).cast("date").alias("as_of"),
    )


def datelist_snapshot(activity: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """The lists as of day in one aggregation."""
    return (
        activity.where(F.col("day") <= F.lit(day).cast("date"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("day")).alias(DATES))
        .withColumn("as_of", F.lit(day).cast("date"))
    )


def datelist_map(activity: DataFrame, key: str, by: str, day: str) -> DataFrame:
    """For each key a map from by to its list as of day."""
    per = datelist_snapshot(activity, [key, by], day)
    return per.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(by, DATES)))).alias("dates_by"))


def merged_maps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two tables of such maps as one."""
    none = F.array().cast("array<date>")
    both = F.map_zip_with("x", "y", lambda _, p, q: F.array_sort(F.array_union(F.coalesce(p, none), F.coalesce(q, none))))
    return (
        a.select(key, F.col("dates_by").alias("x")).join(b.select(key, F.col("dates_by").alias("y")), key, "full_outer")
        .select(key, F.when(F.col("x").isNull(), F.col("y")).when(F.col("y").isNull(), F.col("x")).otherwise(both).alias("dates_by"))
    )


def datelist_int_recent(lists: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Bits with the as-of day on top."""
    d = F.lit(day).cast("date")
    return lists.select(*keys, bits_of_days(F.col(DATES), d).alias("bits"), d.alias("as_of"))


def datelist_int_month(lists: DataFrame, keys: Sequence[str], month_start: str) -> DataFrame:
    """Bits with the first of the month on top, stamped at the month's end."""
    d = F.lit(month_start).cast("date")
    return lists.select(*keys, month_bits(F.col(DATES), d).alias("bits"), F.last_day(d).alias("as_of"))


def activity_flags(bits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Who was active in the last 32 days, the last 7 and the 7 before, and on how many days."""
    b = F.col("bits")
    week, before = b.bitwiseAND(days_ago_mask(0, 6)), b.bitwiseAND(days_ago_mask(7, 13))
    return bits.select(
        *keys, F.bit_count(b).alias("l32"), (F.bit_count(b) > 0).alias("monthly_active"), F.bit_count(week).alias("l7"), (F.bit_count(week) > 0).alias("weekly_active"), (F.bit_count(before) > 0).alias("active_week_before")
    )


def date_spine(spark, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
