"""Hand-made cases of the jobs, and edge rows."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F
from pyspark.testing import assertDataFrameEqual

from tidemark.functions import banded, bits_text, first_like, has_token, minutes_played
from tidemark.operators import analysis, arrays, cumulative, datelist, dedupe, enrich, facts, graph, growth, scd2, starjoin
from tidemark.sources import writers

DAY = dt.date


def test_history_of_a_class(spark):
    """Unordered input, a class that comes back, and a key of one period."""
    rows = [("ore", 12, "grey"), ("ore", 10, "red"), ("ore", 11, "red"), ("ore", 13, "red"), ("ore", 14, "red"), ("tin", 14, None)]
    got = scd2.scd2_backfill(spark.createDataFrame(rows, "metal string, year int, class string"), "metal", "year", ["class"])
    want = [("ore", "red", 10, 11), ("ore", "grey", 12, 12), ("ore", "red", 13, 14), ("tin", None, 14, 14)]
    assertDataFrameEqual(got, spark.createDataFrame(want, "metal string, class string, start_period int, end_period int"))


def test_monthly_sums_of_first_days(spark):
    """Null hits, arrays shorter than three days, two keys and a month of one key."""
    rows = [("n", "2031-07-01", [5, None, 2, 40]), ("n", "2031-07-01", [7]), ("s", "2031-07-01", [None, 9]), ("s", "2031-08-01", [])]
    got = arrays.first_days(spark.createDataFrame(rows, "side string, month_start string, hit_array array<long>"), ["side", "month_start"])
    assert sorted(map(tuple, got.collect())) == [("n", "2031-07-01", 12, 0, 2), ("s", "2031-07-01", 0, 9, 0), ("s", "2031-08-01", 0, 0, 0)]


def test_vertex_of_repeated_rows(spark):
    """The row that the order puts last describes the vertex; null properties stay null."""
    rows = [(7, "b", None, 3), (7, "a", "x", 9), (7, "c", "y", 1), (8, None, "z", 2)]
    df = spark.createDataFrame(rows, "id long, label string, place string, since int")
    props = {"label": F.col("label"), "where": F.col("place"), "since": F.col("since")}
    got = {r.identifier: r for r in graph.vertices(df, "id", "mine", props, [F.col("since")], descending=True).collect()}
    assert {r.type for r in got.values()} == {"mine"}
    assert got[7].properties == {"label": "a", "where": "x", "since": "9"} and got[8].properties == {"label": None, "where": "z", "since": "2"}


def test_history_edges(spark):
    rows = [("a", 1, None, True), ("a", 2, None, True), ("a", 3, None, False), ("b", 1, "x", True), ("b", 3, "x", True), ("c", 1, "x", True), ("c", 2, "y", True), ("c", 3, "x", True)]
    df = spark.createDataFrame(rows, "k string, p int, c string, on boolean")
    spans = lambda d: sorted((r.k, r.start_period, r.end_period) for r in d.collect())
    assert spans(scd2.scd2_backfill(df, "k", "p", ["c", "on"])) == [("a", 1, 2), ("a", 3, 3), ("b", 1, 3), ("c", 1, 1), ("c", 2, 2), ("c", 3, 3)]
    assert spans(scd2.scd2_backfill(df, "k", "p", ["c", "on"], split_gaps=True)).count(("b", 1, 1)) == 1
    two = scd2.scd2_backfill(df, "k", "p", ["c", "on"], 2, split_gaps=True)
    now = df.where("p = 3").select("k", "c", "on").where("k <> 'a'")
    got = spans(scd2.scd2_incremental(two, now, "k", ["c", "on"], 2, 3))
    assert got == [("a", 1, 2), ("b", 1, 1), ("b", 3, 3), ("c", 1, 1), ("c", 2, 2), ("c", 3, 3)]  # a's key is missing: its span stays
    assert [r.k for r in scd2.new_keys(df.where("k <> 'a'").select("k"), df.where("k = 'b'"), "k").distinct().collect()] == ["c"]


def test_cumulative_edges(spark):
    rows = [("a", 1, 10.0), ("a", 1, 30.0), ("b", 2, 5.0), ("a", 3, 0.0)]
    df = spark.createDataFrame(rows, "k string, p int, v double")
    c = cumulative.collapse_period(df, "k", "p", "v", ["p", "v"])
    band = lambda x: banded(x, ((15.0, "high"),), "low")
    one = cumulative.cumulate_backfill(c, "k", 1, band)
    two = cumulative.cumulate_step(one, c, "k", 2, band)
    got = {r.k: r for r in two.collect()}
    assert (got["a"]["class"], got["a"].is_active, got["a"].periods_since_active, len(got["a"].history)) == ("high", False, 1, 2)
    assert (got["b"]["class"], got["b"].is_active) == ("low", True)
    ratios = {r.k: r.ratio for r in cumulative.ratio_last_first(cumulative.cumulate_backfill(c, "k", 3, band).where("period = 3"), "k", "v").collect()}
    assert ratios == {"a": 0.0, "b": 1.0}
    assert cumulative.unnest_history(two, "k").count() == 3


def test_bits(spark):
    rows = [("now", [DAY(2024, 1, 31)]), ("old", [DAY(2023, 12, 31), DAY(2023, 12, 30)]), ("none", []), ("twice", [DAY(2024, 1, 30), DAY(2024, 1, 30)])]
    df = spark.createDataFrame(rows, "k string, dates_active array<date>")
    got = {r.k: r.b for r in datelist.datelist_int_recent(df, ["k"], "2024-01-31").select("k", bits_text(F.col("bits")).alias("b")).collect()}
    assert got == {"now": "1" + "0" * 31, "old": "0" * 31 + "1", "none": "0" * 32, "twice": "01" + "0" * 30}
    month = {r.k: r.bits for r in datelist.datelist_int_month(df, ["k"], "2024-01-01").collect()}
    assert month == {"now": 2, "old": 0, "none": 0, "twice": 4}
    flags = {r.k: r for r in datelist.activity_flags(datelist.datelist_int_recent(df, ["k"], "2024-02-08"), ["k"]).collect()}
    assert flags["now"].active_week_before and not flags["now"].weekly_active and flags["twice"].l32 == 1


def test_monthly_arrays_edges(spark):
    daily = spark.createDataFrame([("a", DAY(2024, 1, 1), 2), ("a", DAY(2024, 1, 4), 3), ("b", DAY(2024, 1, 3), 1)], "k string, day date, n long")
    one = arrays.monthly_arrays(daily, ["k"], "n", "2024-01-01", "2024-01-02")
    day = lambda d: daily.where(F.col("day") == F.lit(d).cast("date"))
    four = arrays.monthly_step(one, day("2024-01-04"), ["k"], "n", "2024-01-04")  # the third is skipped
    again = arrays.monthly_step(four, day("2024-01-04"), ["k"], "n", "2024-01-04")  # the fourth twice
    for df in (four, again):
        assert {r.k: (r.hit_array, r.first_found) for r in df.collect()} == {"a": ([2, None, None, 3], DAY(2024, 1, 1))}
    assert {r.k: r.hit_array for r in arrays.monthly_step(one, day("2024-01-03"), ["k"], "n", "2024-01-03", 0).collect()} == {"a": [2, None, 0], "b": [0, 0, 1]}
    leap = arrays.monthly_arrays(spark.createDataFrame([("a", DAY(2024, 2, 29), 1)], "k string, day date, n long"), ["k"], "n", "2024-02-01", "2024-02-29", 0)
    assert leap.first().hit_array == [0] * 28 + [1]


def test_funnel_edges(spark):
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [(1, t(1, 1), "home"), (1, t(1, 1), "home"), (1, t(1, 2), "signup"), (1, t(1, 3), "home"), (2, t(1, 1), "signup"), (2, t(1, 1), "home"), (3, t(1, 1), "home"), (3, t(2, 1), "signup"), (None, t(1, 1), "home"), (4, t(1, 5), "home"), (4, t(1, 6), "x")]
    got = analysis.funnel_conversion(spark.createDataFrame(rows, "u long, t timestamp, s string"), "u", "t", "s", "signup", 0).collect()
    assert [(r.step, r.events, r.conversions, r.rate) for r in got] == [("home", 2, 1, 0.5)]


def test_cube_and_streak_edges(spark):
    df = spark.createDataFrame([(None, "(overall)"), ("x", "y")], "a string, b string")
    got = {(r.level, r.a, r.b): r.n for r in analysis.cube(df, ["a", "b"], [["a", "b"], ["a"], []], [F.count("*").alias("n")]).collect()}
    assert got[("a", "unknown", "(overall)")] == 1 and got[("overall", "(overall)", "(overall)")] == 2 and got[("a__b", "unknown", "(overall)")] == 1
    s = spark.createDataFrame([("p", i, v) for i, v in enumerate([9, 11, 12, None, 13, 14, 15, 3])] + [("q", 0, 1)], "k string, o int, v int")
    assert {r.k: r.longest_streak for r in analysis.longest_streak(s, "k", ["o"], F.col("v") > 10).collect()} == {"p": 3, "q": 0}
    assert {r.k: r.best_wins for r in analysis.best_stretch(s.withColumn("w", F.col("v") > 10), "k", ["o"], "w", 3).collect()} == {"p": 3, "q": 0}


def test_pairs_edges(spark):
    rows = [(1, 10, "a", 2), (1, 11, "a", 3), (1, 12, None, 4), (2, 10, "a", 1), (2, 11, "b", 0)]
    got = {(r.subject_id, r.object_id, r.edge_type): (r.games, r.subject_points, r.object_points) for r in graph.co_occurrence(spark.createDataFrame(rows, "g int, w int, s string, p long"), "g", "w", "s", "p").collect()}
    assert got == {(11, 10, "shares_team"): (1, 3, 2), (11, 10, "plays_against"): (1, 0, 1), (12, 10, "plays_against"): (1, 4, 2), (12, 11, "plays_against"): (1, 4, 3)}


def test_pairs_of_large_events(spark):
    """Blocks of three participants give what one block gives: an event of 40, of 3 and of 4, ids as text, a null event and
    null ids, which pair with none. An event of 100,000 is dealt so that no place holds more than its block pair."""
    rnd = random.Random(1)
    rows = [(g, f"p{i:02}", rnd.choice(["a", "b", None]), rnd.randrange(9)) for g, n in ((1, 40), (2, 3), (3, 4)) for i in range(n)] + [(None, "p00", "a", 1), (None, "p01", "a", 1), (1, None, "a", 1)]
    df = spark.createDataFrame(rows, "g int, w string, s string, p long")
    whole, blocks = (sorted(map(tuple, graph.co_occurrence(df, "g", "w", "s", "p", block=b).collect())) for b in (1000, 3))
    assert whole == blocks and sum(r[3] for r in blocks) == 40 * 39 // 2 + 3 + 6
    one = spark.range(100_000).select(F.lit(1).alias("event"), F.col("id")).unionByName(spark.range(50).select((F.col("id") + 2).cast("int").alias("event"), F.col("id")))
    first, second = graph.block_pairs(one, "event", "id", 1000)
    for side in (first, second):
        most, places, n = side.groupBy("event", "low", "high").count().agg(F.max("count"), F.count("*"), F.sum("count")).first()
        assert most < 1300 and places == 100 * 101 // 2 + 50 and abs(n - 100_000 * 50.5) < 200_000
    assert first.where("event > 1").count() == second.where("event > 1 AND low = 0 AND high = 0").count() == 50


def test_weeks_of_the_calendar(spark):
    rows = [("a", DAY(2024, 1, d), n) for d, n in ((1, 5), (2, 1), (8, 2), (9, 4), (20, 3))] + [("b", DAY(2024, 1, 9), 7)]
    got = analysis.traffic_windows(spark.createDataFrame(rows, "k string, day date, hits long"), ["k"], by="days").orderBy("k", "day").collect()
    assert [(r.rolling_7, r.rolling_7_before) for r in got] == [(5, None), (6, None), (3, 5), (6, 6), (3, 6), (7, None)]


def test_contract_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, 2.0, "y"), (3, None, None)], "a int, b double, `c d` string")
    got = {tuple(r) for r in facts.contract(df, "a long NOT NULL, b double NOT NULL, e date", ["c d"]).collect()}
    assert got == {("e", "missing", "date", None, None), ("c d", "extra", None, "string", None), ("a", "type", "bigint", "int", None), ("a", "null", "not null", "null", 1), ("b", "null", "not null", "null", 2)}
    assert facts.contract(df, df.schema).count() == 0 and facts.contract(df.limit(0), df.schema, ["a"]).count() == 0


def test_frequent_keys_beyond_the_sketch(spark):
    """More keys than the sketch tracks: those that are frequent for certain come out with exact counts."""
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 5).when(F.col("id") % 100 > 0, F.col("id")).alias("k"))
    got = facts.frequent_keys(df, "k", 5, candidates=50, tracked=1000).collect()
    assert [(r.k, r.rows) for r in got] == [(1, 4001), (2, 4001), (4, 4001), (0, 4000), (3, 4000)] and all(abs(r.estimate - r.rows) <= 80 for r in got)
    per = facts.rows_per_key(spark.createDataFrame([(1,), (1,), (None,)], "k int"), "k").first()
    assert tuple(per) == (2, 1, 2, 1.5, 1) and facts.frequent_keys(df.limit(0), "k", 3).count() == 0


def test_frequent_keys_among_many_alike(spark):
    """Keys that a sketch of all rows can't tell apart, ties of more keys than candidates, and more keys asked for than these."""
    df = spark.range(40_000).select(F.when(F.col("id") >= 30, F.col("id") % 20_000).otherwise(F.lit(19_990) + F.col("id") % 3).alias("k")).unionByName(spark.range(9).select(F.lit(None).cast("long").alias("k")))
    want = [(19_990, 12), (19_991, 12), (19_992, 12)] + [(k, 2) for k in range(30, 60)]
    got = facts.frequent_keys(df, "k", 33, candidates=50, tracked=1000).collect()
    assert [(r.k, r.rows) for r in got] == want and all(r.estimate == r.rows for r in got)
    got = facts.frequent_keys(df, "k", 33, candidates=10, tracked=1000).collect()
    assert [(r.k, r.rows) for r in got] == want and [r.estimate == r.rows for r in got].count(True) == 10 and sum(r.estimate is None for r in got) == 23


def test_text(spark):
    df = spark.createDataFrame([("34:12",), ("34",), ("",), (None,), ("x:1",)], "m string")
    assert [None if r.x is None else round(r.x, 3) for r in df.select(minutes_played(F.col("m")).alias("x")).collect()] == [34.2, 34.0, None, None, None]
    c = spark.createDataFrame([("DNP - hurt",), ("NWT",), (None,)], "c string").select(*[v.alias(k) for k, v in facts.comment_flags(F.col("c")).items()], has_token(F.col("c"), "-").alias("dash")).collect()
    assert [tuple(r) for r in c] == [(True, False, False, True), (False, False, True, False), (False,) * 4]
    u = spark.createDataFrame([("www.a.com",), ("b.a.com",), ("other",), (None,)], "u string")
    assert [r.x for r in u.select(first_like(F.col("u"), (("www.%", "W"), ("%a.com", "A"))).alias("x")).collect()] == ["W", "A", "other", None]


def test_lookup_edges(spark):
    ranges = spark.createDataFrame([(0, 9, "A"), (10, 300_000, "B"), (300_005, 300_006, "C")], "lo long, hi long, country string")
    df = spark.createDataFrame([(i, n) for i, n in enumerate([0, 9, 10, 300_000, 300_001, 300_006, None])], "i int, n long")
    got = {r.i: r.geodata for r in enrich.range_lookup(df, ranges, "n", "lo", "hi", ["country"]).collect()}
    assert got == {0: '{"country":"A"}', 1: '{"country":"A"}', 2: '{"country":"B"}', 3: '{"country":"B"}', 4: "{}", 5: '{"country":"C"}', 6: "{}"}
    ips = spark.createDataFrame([("1.2.3.4",), ("256.1.1.1",), ("a.b.c.d",), (None,), ("1.2.3",)], "ip string")
    assert [r.n for r in ips.select(enrich.ip_number(F.col("ip")).alias("n")).collect()] == [16909060, None, None, None, None]


def test_star_join_edges(spark):
    e = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 6, "a"), (None, 5, "a"), (2, None, "a")], "u long, d long, h string")
    (r,) = starjoin.user_device_rollup(e, "u", "d", "h").collect()
    assert (r.u, r.most_events, r.devices, r.events, r.hosts) == (1, 2, 2, 3, 2)
    assert starjoin.device_users(e, "u", "d").count() == 2
    assert dedupe.best_class(spark.createDataFrame([(1, "star"), (1, "bad"), (2, None)], "k int, c string"), ["k"], "c", ("bad", "star")).where("best_class = 'star'").count() == 1


def test_growth_edges(spark):
    days = [1, 2, 4, 12, 13]
    a = spark.createDataFrame([(7, DAY(2024, 1, d)) for d in days], "u long, day date")
    got = {r.as_of.day: (r.daily_state, r.weekly_state) for r in growth.growth_backfill(a, "u", "2024-01-01", "2024-01-22").collect()}
    assert got[1] == ("New", "New") and got[2] == ("Retained", "Retained") and got[3] == ("Churned", "Retained") and got[4] == ("Resurrected", "Retained")
    assert got[6] == ("Stale", "Retained") and got[12] == ("Resurrected", "Resurrected") and got[20] == ("Stale", "Retained") and got[21] == ("Stale", "Churned") and got[22] == ("Stale", "Stale")


def test_upsert_and_periods(spark, tmp_path):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "c")], "k int, p int, v string")
    path = str(tmp_path / "t")
    writers.write_period(old, path, "p")
    writers.upsert_periods(spark.createDataFrame([(2, 1, "B"), (4, 1, "d")], "k int, p int, v string"), path, ["k"], "p")
    writers.write_period(spark.createDataFrame([(9, 2, "z")], "k int, p int, v string"), path, "p")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "B"), (4, "d"), (9, "z")]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "u long, ts timestamp, h string, day date")
    assert facts.daily_activity(e, ["u"], "ts").count() == 0
    assert datelist.datelist_snapshot(e, ["u"], "2024-01-01").count() == 0
    assert growth.growth_backfill(e, "u", "2024-01-01", "2024-01-05").count() == 0
    assert analysis.funnel_conversion(e, "u", "ts", "h", "signup").count() == 0
    assert facts.profile(e, "u", "ts").first()["rows"] == 0


def test_lookups_of_ranges(spark, monkeypatch):
    """Overlaps, equal ranges, ranges of one number and of all, empty and null ones, numbers below zero and null: joins and
    index against a look at every range."""
    rnd = random.Random(2)
    places = [(a, a + rnd.choice([0, 1, 15, 16, 300, 70_000, 2**40]), f"c{i % 7}", None if i % 5 == 0 else str(i)) for i, a in enumerate(rnd.randrange(-1000, 5000) for _ in range(200))]
    places += [(7, 7, "x", "a"), (7, 7, "b", "a"), (9, 8, "empty", ""), (None, 5, "null", ""), (3000, 2**62, "long", "")]
    numbers = [None] * 50 + [rnd.randrange(-1200, 6000) for _ in range(400)] + [-(2**62), 2**62, 2**40 + 100, 0, 7]
    ranges = spark.createDataFrame(places, "lo long, hi long, country string, state string")
    df = spark.createDataFrame(list(enumerate(numbers)), "i long, number long")

    def best(n):
        fit = sorted(((a, z, c, "" if s is None else "1" + s), c, s) for a, z, c, s in places if n is not None and a is not None and a <= n <= z)
        return json.dumps({"country": fit[0][1], "state": fit[0][2]}, separators=(",", ":")) if fit else "{}"

    want = {i: best(n) for i, n in enumerate(numbers)}
    for rows in (1 << 20, 3):
        monkeypatch.setattr(enrich, "INDEX_ROWS", rows)
        got = enrich.index_lookup(df, ranges, "number", "lo", "hi", ["country", "state"])
        assert {r.i: r.geodata for r in got.collect()} == want and ("Join" in got._jdf.queryExecution().executedPlan().toString()) == (rows == 3)
    for find in (enrich.index_lookup, enrich.range_lookup):
        assert {r.geodata for r in find(df, ranges.limit(0), "number", "lo", "hi", ["country", "state"]).collect()} == {"{}"}
        assert find(df.limit(0), ranges, "number", "lo", "hi", ["country", "state"]).count() == 0
