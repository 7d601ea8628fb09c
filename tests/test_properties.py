"""Folding the steps over periods equals the one-job forms."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.functions import banded
from tidemark.operators import arrays, cumulative, datelist, growth, scd2

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
ROWS = st.lists(st.tuples(st.integers(0, 3), st.integers(1, 5), st.sampled_from([5.0, 15.0, 25.0])), min_size=1, max_size=14)
DAYS = st.lists(st.tuples(st.integers(0, 3), st.integers(1, 12)), min_size=1, max_size=20)


def band(x):
    return banded(x, ((20.0, "high"), (10.0, "mid")), "low")


def rows_of(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


@SETTINGS
@given(ROWS)
def test_cumulative(spark, rows):
    df = spark.createDataFrame(rows, "k int, p int, v double")
    c = cumulative.collapse_period(df, "k", "p", "v", ["p", "v"])
    now = cumulative.cumulate_backfill(c, "k", 2, band).where("period = 2")
    for p in (3, 4):
        now = cumulative.cumulate_step(now, c, "k", p, band)
    assert rows_of(now) == rows_of(cumulative.cumulate_backfill(c, "k", 4, band).where("period = 4"))
    alone = cumulative.snapshot_as_of(c, "k", 4, band)
    assert rows_of(now) == rows_of(alone) and "Window" not in alone._jdf.queryExecution().executedPlan().toString()


@SETTINGS
@given(ROWS)
def test_history(spark, rows):
    df = spark.createDataFrame(sorted({(k, p): (k, p, "abc"[int(v // 10)] if v > 6 else None) for k, p, v in rows}.values(), key=repr), "k int, p int, c string")
    now = scd2.scd2_backfill(df, "k", "p", ["c"], 2, split_gaps=True)
    for p in (3, 4, 5):
        now = scd2.scd2_incremental(now, df.where(f"p = {p}").select("k", "c"), "k", ["c"], p - 1, p)
    whole = scd2.scd2_backfill(df, "k", "p", ["c"], split_gaps=True)
    assert rows_of(now) == rows_of(whole)
    spans = sorted((r.k, r.start_period, r.end_period, str(r.c)) for r in whole.collect())
    for a, b in zip(spans, spans[1:]):
        if a[0] == b[0]:
            assert a[2] < b[1] and (a[2] + 1 < b[1] or a[3] != b[3])


@SETTINGS
@given(DAYS)
def test_dates_and_growth(spark, days):
    a = spark.createDataFrame([(k, dt.date(2024, 1, d)) for k, d in days], "u int, day date")
    lists = datelist.datelist_snapshot(a, ["u"], "2024-01-09")
    for d in ("2024-01-10", "2024-01-11"):
        lists = datelist.datelist_step(lists, a, ["u"], d)
    assert rows_of(lists) == rows_of(datelist.datelist_snapshot(a, ["u"], "2024-01-11"))
    first = datelist.datelist_snapshot(a, ["u"], "2024-01-09").selectExpr("u", "array_min(dates_active) AS first_active", "array_max(dates_active) AS last_active", "dates_active")
    now = first
    for d in ("2024-01-10", "2024-01-11"):
        now = growth.growth_step(now, a, "u", d)
    whole = growth.growth_backfill(a, "u", "2024-01-01", "2024-01-11").where("as_of = DATE'2024-01-11'")
    assert rows_of(now.drop("dates_active")) == rows_of(whole)


@SETTINGS
@given(DAYS)
def test_host_months(spark, days):
    """Day by day over the end of a month, with days without a load and a day loaded twice."""
    e = spark.createDataFrame([(f"h{k % 2}" if k else None, k, dt.datetime(2024, 1, 24 + d) if d < 8 else dt.datetime(2024, 2, d - 7)) for k, d in days], "host string, visitor int, ts timestamp")
    now = arrays.host_month(e, "host", "visitor", "ts", "2024-01-01", "2024-01-29")
    for d in ("2024-01-31", "2024-01-31"):
        now = arrays.host_month_step(now, e, "host", "visitor", "ts", d)
    whole = arrays.host_month(e.where("ts <> TIMESTAMP'2024-01-30'"), "host", "visitor", "ts", "2024-01-01", "2024-01-31")
    assert rows_of(now) == rows_of(whole)
    for d in ("2024-02-01", "2024-02-02"):
        now = arrays.host_month_step(now, e, "host", "visitor", "ts", d)
    assert rows_of(now) == rows_of(arrays.host_month(e, "host", "visitor", "ts", "2024-02-01", "2024-02-02"))


@SETTINGS
@given(DAYS, DAYS)
def test_maps(spark, x, y):
    def table(days):
        return datelist.datelist_map(spark.createDataFrame([(k % 2, f"b{k}", dt.date(2024, 1, d)) for k, d in days], "u int, b string, day date"), "u", "b", "2024-01-31")

    plain = lambda df: sorted((r.u, sorted(r.dates_by.items())) for r in df.collect())
    assert plain(datelist.merged_maps(table(x), table(y), "u")) == plain(table(x + y))
