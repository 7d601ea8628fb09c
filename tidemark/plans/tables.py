"""The driver's tables in the jobs' roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Yearly mean price above which a customer is of a class, from high to low.
BANDS = ((300_000.0, "star"), (250_000.0, "good"), (200_000.0, "average"))
LOWEST = "bad"
WORST_TO_BEST = ("bad", "average", "good", "star")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web events: host and url are the event's type, device_id the number in props."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.col("event_type").alias("host"), F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("long").alias("device_id"), "value")


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("device_id"), F.col("p_brand").alias("browser_type"), F.col("p_type").alias("os_type"), F.col("p_size").cast("string").alias("device_type"))


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a customer's items of a year."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("player"), F.year("o_orderdate").alias("season"), "o_orderkey", F.col("o_totalprice").alias("points"))


def game_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as players' rows of a game: order, supplier as team, part as player; repeated rows once."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_suppkey").alias("team"), F.col("l_partkey").alias("player"), "l_linenumber", F.col("l_quantity").cast("long").alias("points"), F.when(F.col("l_returnflag") == "R", -1).when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("plus_minus"))
    first = F.min_by(F.struct("team", "points", "plus_minus"), F.struct("l_linenumber", "team", "points", "plus_minus")).alias("x")
    return li.groupBy("game", "player").agg(first).select("game", "player", "x.*")
