"""Times six jobs against plans of the shape that the reference uses for them, on equal results; prints one JSON line.

local[4], BENCH_SF_DIR (default /root/testdata/sf0.1), one warm-up, then the median of BASELINE_RUNS (default 5) runs, each
into the noop sink; DuckDB's SQL twin on the same files beside it where there is one.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

import duckdb
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cumulative
from tidemark.plans import queries, tables
from tidemark.plans.oracles import ORACLE_SQL

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = int(os.environ.get("BASELINE_RUNS", "5"))


def funnel(s: SparkSession, d: str) -> DataFrame:
    """Every event joined with all later ones of its user and day."""
    e = tables.events(s, d).where("user_id IS NOT NULL").select("user_id", "ts", F.col("host").alias("step")).distinct().withColumn("day", F.to_date("ts"))
    a, b = e.alias("a"), e.alias("b")
    later = a.join(b, F.expr("a.user_id = b.user_id AND a.day = b.day AND b.ts > a.ts"))
    each = later.groupBy("a.user_id", "a.ts", "a.step").agg(F.count_distinct(F.expr("CASE WHEN b.step = 'signup' THEN b.step END")).alias("hit"))
    got = each.groupBy("step").agg(F.count("*").alias("events"), F.sum("hit").alias("conversions"))
    return got.where("conversions > 0 AND events > 20").withColumn("rate", F.round(F.col("conversions") / F.col("events"), 6))


def date_bits(s: SparkSession, d: str) -> DataFrame:
    """Every user with every day of the window, then a sum of powers of two."""
    lists = queries._lists(s, d)
    last = F.lit(queries.LAST).cast("date")
    days = s.range(1).select(F.explode(F.sequence(F.date_sub(last, 31), last)).alias("day"))
    back = F.datediff(last, F.col("day"))
    power = F.when(F.array_contains("dates_active", F.col("day")), F.pow(F.lit(2.0), 31 - back).cast("long")).otherwise(F.lit(0).cast("long"))
    return lists.crossJoin(days).groupBy("user_id").agg(F.sum(power).alias("bits")).withColumn("as_of", last)


def cumulative_load(s: SparkSession, d: str) -> DataFrame:
    """One full outer join for each period, each on the result of the one before; all periods together."""
    c = queries._collapsed(s, d)
    first = c.agg(F.min("period")).first()[0]
    now = cumulative.cumulate_backfill(c, "player", first, queries._band)
    out = now
    for year in range(first + 1, 1999):
        now = cumulative.cumulate_step(now, c, "player", year, queries._band)
        out = out.unionByName(now)
    return queries._snapshot(out)


def star(s: SparkSession, d: str) -> DataFrame:
    """All tables joined at the finest grain before the one question is asked."""
    li, o, c, n = (tables.read(s, d, x) for x in ("lineitem", "orders", "customer", "nation"))
    wide = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return wide.where("l_returnflag = 'R'").groupBy("n_name").agg(F.count_distinct("o_orderkey").alias("n")).orderBy(F.col("n").desc(), "n_name").limit(1)


def one_period(s: SparkSession, d: str) -> DataFrame:
    """A full outer join for each period up to the one that is wanted."""
    c = queries._collapsed(s, d)
    first = c.agg(F.min("period")).first()[0]
    now = cumulative.snapshot_as_of(c, "player", first, queries._band)
    for year in range(first + 1, 2000):
        now = cumulative.cumulate_step(now, c, "player", year, queries._band)
    return queries._snapshot(now)


def lookup(s: SparkSession, d: str) -> DataFrame:
    """Each event's number looked up on its own, one call of a Python function a row."""
    rows = [tuple(r) for r in queries._all_ranges(s, d).orderBy("ip_from", "ip_to", "country", "state").collect()]

    @F.udf("string")
    def place(n: int | None) -> str:
        for low, high, country, state in rows:
            if n is not None and low <= n <= high:
                return json.dumps({"country": country, "state": state}, separators=(",", ":"))
        return "{}"

    return queries._numbers(s, d).select("event_id", "number", place("number").alias("geodata"))


PAIRS = {
    "funnel": (funnel, queries.funnel_conversion),
    "date list bits": (date_bits, queries.datelist_int_recent),
    "cumulative load": (cumulative_load, queries.cumulate_seasons_backfill),
    "star join": (star, queries.top_map_for_medal),
    "one period's snapshot": (one_period, queries.cumulate_seasons_as_of),
    "location lookup": (lookup, queries.geo_index),
}


def timed(run) -> float:
    took = []
    for _ in range(1 + RUNS):
        t = time.perf_counter()
        run()
        took.append(time.perf_counter() - t)
    return round(median(took[1:]), 3)


def main() -> None:
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET threads = 4; SET TimeZone = 'UTC'")
    for t in ("events", "orders", "customer", "lineitem", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    out = {}
    for name, (theirs, ours) in PAIRS.items():
        a, b = (f(spark, SF_DIR) for f in (theirs, ours))
        same = a.select(b.columns).exceptAll(b).isEmpty() and b.exceptAll(a.select(b.columns)).isEmpty()
        plain = lambda f: lambda: f(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        out[name] = {"equal": same, "reference_shape": timed(plain(theirs)), "ours": timed(plain(ours)), "duckdb": timed(lambda q=ORACLE_SQL[ours.__name__]: con.execute(q).fetchall())}
    print(json.dumps({"metric": "median seconds", "runs": RUNS, "pairs": out}))
    spark.stop()


if __name__ == "__main__":
    main()
