"""Labels from patterns, and places from ranges of numbers."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import first_like


def classify(df: DataFrame, column: str, patterns: Sequence[tuple[str, str]], name: str) -> DataFrame:
    """Adds the label of the first pattern that matches, else the value itself."""
    return df.withColumn(name, first_like(F.col(column), patterns))


def ip_number(ip: str):
    """A dotted address as a number; null where it is not one."""
    parts = F.split(ip, r"\.")
    n = F.lit(0).cast("long")
    good = F.size(parts) == 4
    for i in range(4):
        p = F.get(parts, F.lit(i)).try_cast("long")
        good = good & p.between(0, 255)
        n = n * 256 + p
    return F.when(good, n)


#: Bits by which the levels of ranges differ. A range lies at the lowest level whose cells are as long as it is, so it meets
#: two cells at most; numbers of 64 bits have sixteen levels, and tables mostly a few of them.
STEP = 4
#: Ranges and bytes of places up to which a table is an index that every task holds.
INDEX_ROWS, INDEX_BYTES = 1 << 20, 64 << 20


def _place(hit: Column) -> Column:
    return F.coalesce(F.to_json(hit, {"ignoreNullFields": "false"}), F.lit("{}"))


def _known(ranges: DataFrame, low: str, high: str, fields: Sequence[str]) -> DataFrame:
    """lo, hi and place of ranges that hold something."""
    return ranges.select(F.col(low).cast("long").alias("lo"), F.col(high).cast("long").alias("hi"), F.struct(*fields).alias("place")).where("lo <= hi")


def range_lookup(df: DataFrame, ranges: DataFrame, number: str, low: str, high: str, fields: Sequence[str], name: str = "geodata") -> DataFrame:
    """Adds the fields of the range (low to high, both included) that holds number, as JSON; {} where none does or number
    is null. Where ranges overlap the lowest start wins, then the lowest end, then the least place.

    For tables of any size: an equi-join for each level of lengths there is, on the number's upper bits. A cell holds its ranges
    as an array, without those that an earlier one covers whole, so a join never adds rows. Null numbers are spread over many keys.
    """
    known = _known(ranges, low, high, fields)
    bits = F.length(F.bin(F.col("hi") - F.col("lo")))
    level = (F.ceil((bits - F.when(F.col("hi") == F.col("lo"), 1).otherwise(0)) / STEP) * STEP).cast("int")
    known = known.withColumn("level", level)
    wide = df.withColumns({"lookup_spread": F.when(F.col(number).isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(4096)) + 1).otherwise(0), "lookup_hit": F.lit(None).cast(f"struct<lo:long,hi:long,place:{known.schema['place'].dataType.simpleString()}>")})
    levels = [r.level for r in known.select("level").distinct().orderBy("level").collect()]  # 17 at most
    for n in levels:
        cut = known.where(F.col("level") == n).select(F.explode(F.array_distinct(F.array(F.shiftright("lo", n), F.shiftright("hi", n)))).alias("lookup_cell"), F.struct("lo", "hi", "place").alias("c"))
        before = Window.partitionBy("lookup_cell").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
        open_ = cut.withColumn("reach", F.max("c.hi").over(before)).where("reach IS NULL OR c.hi > reach")
        cells = open_.groupBy("lookup_cell").agg(F.sort_array(F.collect_list("c")).alias("lookup_cells")).withColumn("lookup_spread", F.lit(0).cast("long"))
        wide = wide.withColumn("lookup_cell", F.coalesce(F.shiftright(F.col(number).cast("long"), n), F.lit(0))).join(cells, ["lookup_cell", "lookup_spread"], "left")
        here = F.get(F.filter("lookup_cells", lambda c: F.col(number).cast("long").between(c["lo"], c["hi"])), F.lit(0))
        wide = wide.withColumn("lookup_hit", F.least("lookup_hit", here)).drop("lookup_cell", "lookup_cells")
    return wide.withColumn(name, _place(F.col("lookup_hit")["place"])).drop("lookup_spread", "lookup_hit")


def segments(rows: Sequence[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of stretches of numbers and which of the ranges (low, high, place; sorted) wins there, -1 for none. The stretch
    of a start goes on to the next one."""
    starts, winner = [], []
    open_: list[int] = []  # ranges that hold the place reached, the first of them on top
    points = sorted({x for lo, hi, _ in rows for x in (lo, hi + 1)})
    k = 0
    for x in points:
        while k < len(rows) and rows[k][0] <= x:
            heapq.heappush(open_, k)
            k += 1
        while open_ and rows[open_[0]][1] < x:
            heapq.heappop(open_)
        now = open_[0] if open_ else -1
        if not winner or winner[-1] != now:
            starts.append(x)
            winner.append(now)
    return np.array(starts, np.int64), np.array(winner, np.int64)


def index_lookup(df: DataFrame, ranges: DataFrame, number: str, low: str, high: str, fields: Sequence[str], name: str = "geodata") -> DataFrame:
    """range_lookup() by an index that every task holds: the winner of each stretch of numbers, found by binary search.
    df is neither shuffled nor sorted. A table of more than INDEX_ROWS ranges or INDEX_BYTES of places goes to range_lookup()."""
    spark = df.sparkSession
    known = _known(ranges, low, high, fields).select("lo", "hi", _place(F.col("place")).alias("json"), F.col("place"))
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("json")), F.lit(0)).alias("bytes")).first()
    if size.n > INDEX_ROWS or size.bytes > INDEX_BYTES:
        return range_lookup(df, ranges, number, low, high, fields, name)
    rows = [(r.lo, r.hi, r.json) for r in known.orderBy("lo", "hi", "place").select("lo", "hi", "json").collect()]
    index = spark.sparkContext.broadcast((*segments(rows), np.array([*(r[2] for r in rows), "{}"], object)))

    @F.arrow_udf("string")
    def place(n: pa.Array) -> pa.Array:
        starts, winner, places = index.value
        at = np.searchsorted(starts, n.fill_null(0).to_numpy(zero_copy_only=False), "right") - 1
        own = np.where(n.is_valid().to_numpy(zero_copy_only=False) & (at >= 0), winner[at] if len(winner) else -1, -1)
        return pa.array(places[own], pa.string())

    return df.withColumn(name, place(F.col(number).cast("long")))
