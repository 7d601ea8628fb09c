"""Questions over facts and dimensions, each at its own grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes in memory up to which a dimension is broadcast; beyond that the join shuffles. The optimizer's estimate comes
#: from compressed files, whose rows take several times as much.
BROADCAST_BYTES, EXPANDED = 64 << 20, 4


def sized_broadcast(dim: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """dim marked for a broadcast if its estimated size, EXPANDED times, is within limit, else as it is."""
    size = dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(dim) if EXPANDED * int(str(size)) <= limit else dim


def join_dim(fact: DataFrame, dim: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    return fact.join(sized_broadcast(dim), on, how)


def average_per_key(fact: DataFrame, key: str, value: str, name: str = "average") -> DataFrame:
    return fact.groupBy(key).agg(F.avg(value).alias(name))


def most_frequent(rows: DataFrame, by: str, what: str, n: int = 1) -> DataFrame:
    """The n values of by with the most distinct what."""
    return rows.groupBy(by).agg(F.count_distinct(what).alias("n")).orderBy(F.col("n").desc(), by).limit(n)


def user_device_rollup(events: DataFrame, user: str, device: str, host: str) -> DataFrame:
    """For each user and device its events and hosts, then for each user the devices and its busiest one; the
    second aggregation works on the first, not on the events again."""
    pairs = events.where(F.col(user).isNotNull() & F.col(device).isNotNull()).groupBy(user, device).agg(F.count("*").alias("events"), F.collect_set(host).alias("hosts"))
    return pairs.groupBy(user).agg(F.max("events").alias("most_events"), F.count("*").alias("devices"), F.sum("events").alias("events"), F.size(F.array_distinct(F.flatten(F.collect_list("hosts")))).alias("hosts"))


def device_users(events: DataFrame, user: str, device: str) -> DataFrame:
    pairs = events.where(F.col(user).isNotNull() & F.col(device).isNotNull()).select(user, device).distinct()
    return pairs.groupBy(device).agg(F.count("*").alias("users"))


def events_with_device(events: DataFrame, devices: DataFrame, device: str, referrer: str, browser: str) -> DataFrame:
    """Events with their device; a missing referrer is named, browsers are in upper case."""
    wide = events.where(F.col(device).isNotNull()).join(devices, device)
    return wide.withColumns({referrer: F.coalesce(referrer, F.lit("unknown")), browser: F.upper(browser)})
