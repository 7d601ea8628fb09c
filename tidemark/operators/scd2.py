"""Type-2 history: a row for each span of periods in which the tracked attributes stay the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "start_period", "end_period"


def _equal(columns: Sequence[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def scd2_backfill(df: DataFrame, key: str, period: str, tracked: Sequence[str], upto: int | None = None, split_gaps: bool = False) -> DataFrame:
    """History of all periods up to upto. A span ends where a tracked attribute changes (null equals
    null), and with split_gaps also where a period is missing. Both windows share one shuffle on the key."""
    rows = df if upto is None else df.where(F.col(period) <= upto)
    w = Window.partitionBy(key).orderBy(period)
    now, before = F.struct(*tracked), F.lag(F.struct(*tracked)).over(w)
    new = (F.row_number().over(w) == 1) | ~now.eqNullSafe(before)
    if split_gaps:
        new = new | (F.col(period) != F.lag(period).over(w) + 1)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.select(key, period, *tracked, new.cast("int").alias("new"))
    spans = marked.withColumn("span", F.sum("new").over(running))
    return spans.groupBy(key, *tracked, "span").agg(F.min(period).alias(START), F.max(period).alias(END)).drop("span")


def scd2_incremental(scd: DataFrame, this_period: DataFrame, key: str, tracked: Sequence[str], prev: int, cur: int) -> DataFrame:
    """History up to prev and the rows of period cur make the history up to cur.

    Spans that ended before prev pass through; an open one (it ends at prev) is extended where nothing
    changed, else it stays as it is and a new one opens; a key that is missing in cur keeps its closed span.
    """
    columns = [key, *tracked, START, END]
    closed = scd.where(F.col(END) < prev).select(columns)
    o, t = scd.where(F.col(END) == prev).withColumn("there", F.lit(1)).alias("o"), this_period.withColumn("there", F.lit(1)).alias("t")
    old = F.struct(F.col(f"o.{key}").alias(key), *[F.col(f"o.{c}").alias(c) for c in tracked], F.col(f"o.{START}").alias(START), F.col(f"o.{END}").alias(END))
    fresh = F.struct(F.col(f"t.{key}").alias(key), *[F.col(f"t.{c}").alias(c) for c in tracked], F.lit(cur).alias(START), F.lit(cur).alias(END))
    longer = F.struct(F.col(f"o.{key}").alias(key), *[F.col(f"o.{c}").alias(c) for c in tracked], F.col(f"o.{START}").alias(START), F.lit(cur).alias(END))
    rows = (
        F.when(F.col("t.there").isNull(), F.array(old))
        .when(F.col("o.there").isNull(), F.array(fresh))
        .when(_equal(tracked, "o", "t"), F.array(longer))
        .otherwise(F.array(old, fresh))
    )
    moved = o.join(t, F.col(f"o.{key}") == F.col(f"t.{key}"), "full_outer").select(F.inline(rows))
    return closed.unionByName(moved)


def new_keys(this_period: DataFrame, scd: DataFrame, key: str) -> DataFrame:
    """Rows of keys without any history."""
    return this_period.join(scd.select(key), key, "left_anti")
