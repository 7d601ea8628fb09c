"""Every job on the driver's tables. Times leave as timestamp_ntz and doubles rounded, so results can be
compared with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import banded
from tidemark.operators import analysis, arrays, cumulative, datelist, dedupe, enrich, facts, graph, growth, layout, scd2, starjoin
from tidemark.plans import tables as t
from tidemark.sources import readers, writers
from tidemark.streaming import jobs

D, BEFORE, LAST, MONTH = "2024-01-15", "2024-01-14", "2024-01-30", "2024-01-01"
CUTS = ("2024-01-11 00:02:30", "2024-01-21 00:02:30")
REFERRERS = (("%//blog.%", "Blog"), ("https://m.%", "Mobile"), ("%.org%", "Organisation"))


def _band(c: Column) -> Column:
    return banded(c, t.BANDS, t.LOWEST)


def _joined(c, sep: str = ",") -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep, "null")


def _daily(s: SparkSession, d: str, *keys: str) -> DataFrame:
    e = t.events(s, d)
    if "browser_type" in keys:
        e = starjoin.join_dim(e, t.devices(s, d).select(F.col("device_id").alias("d"), "browser_type"), F.col("device_id") == F.col("d"))
    return facts.daily_activity(e, keys, "ts")


def _collapsed(s, d):
    return cumulative.collapse_period(t.seasons(s, d), "player", "season", "points", ["season", "o_orderkey", "points"])


def _snapshot(df: DataFrame) -> DataFrame:
    return df.select("player", F.size("history").alias("items"), _joined(F.transform("history", lambda x: x["o_orderkey"])).alias("order_keys"), "class", "periods_since_active", "is_active", "period")


def _backfill(s, d, last=2001):
    return cumulative.cumulate_backfill(_collapsed(s, d), "player", last, _band)


def _as_of(s, d, period=2001):
    return cumulative.snapshot_as_of(_collapsed(s, d), "player", period, _band)


def cumulate_seasons_as_of(s, d):
    """One period's snapshot without those before it."""
    return _snapshot(_as_of(s, d, 1999))


def cumulate_seasons_step(s, d):
    prev = _as_of(s, d, 1999)
    return _snapshot(cumulative.cumulate_step(prev, _collapsed(s, d), "player", 2000, _band))


def cumulate_seasons_backfill(s, d):
    return _snapshot(_backfill(s, d, 1998))


def unnest_history(s, d):
    return cumulative.unnest_history(_as_of(s, d), "player")


def ratio_last_first(s, d):
    return cumulative.ratio_last_first(_as_of(s, d), "player", "points").select("player", F.round("ratio", 4).alias("ratio"))


def _scd(s, d, upto):
    return scd2.scd2_backfill(_backfill(s, d).select("player", "period", "class", "is_active"), "player", "period", ["class", "is_active"], upto)


def scd2_backfill(s, d):
    return _scd(s, d, 2000)


def scd2_incremental(s, d):
    """The history up to 2000 and the snapshot of 2001, both from snapshots that are written once."""
    b = writers.staged(_backfill(s, d).select("player", "period", "class", "is_active"))
    before = scd2.scd2_backfill(b, "player", "period", ["class", "is_active"], 2000)
    return scd2.scd2_incremental(before, b.where("period = 2001").drop("period"), "player", ["class", "is_active"], 2000, 2001)


def latest_snapshot(s, d):
    """The last of two periods' snapshots in one table."""
    return cumulative.latest(_as_of(s, d, 2000).unionByName(_as_of(s, d)).select("player", "class", "periods_since_active", "is_active", "period"))


def ever_active(s, d):
    return cumulative.ever_active(_backfill(s, d), "player")


def new_keys_anti(s, d):
    c = _collapsed(s, d)
    return scd2.new_keys(c.where("period = 1996").select("player"), c.where("period = 1995"), "player")


def max_class(s, d):
    return dedupe.best_class(_backfill(s, d).where("is_active"), ["player"], "class", t.WORST_TO_BEST)


def fact_lineitems(s, d):
    li = t.read(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity").withColumn("played", F.concat_ws(":", F.col("l_quantity").cast("int"), "l_linenumber"))
    flags = {"is_urgent": facts.has_token(F.col("o_orderpriority"), "URGENT"), "is_low": facts.has_token(F.col("o_orderpriority"), "LOW")}
    dims = {"game_date": F.to_date("o_orderdate"), "game": F.col("l_orderkey"), "team": F.col("l_suppkey"), "player": F.col("l_partkey"), "is_home": F.pmod("o_custkey", F.lit(100)) == F.col("l_suppkey"), **flags}
    measures = {"minutes": F.round(facts.minutes(F.col("played")), 4), "points": F.col("l_quantity").cast("long")}
    return facts.fact_build(li, t.read(s, d, "orders"), ("l_orderkey", "o_orderkey"), ["l_orderkey", "l_suppkey", "l_partkey"], dims, measures, [F.col("l_linenumber")])


def fact_join_dim(s, d):
    dim = t.read(s, d, "supplier").select("s_suppkey", "s_name")
    return starjoin.join_dim(fact_lineitems(s, d), dim, F.col("dim_team") == F.col("s_suppkey")).groupBy("s_name").agg(F.sum("m_points").alias("points"), F.count("*").alias("rows"))


def daily_activity(s, d):
    return _daily(s, d, "user_id")


def profile_events(s, d):
    return facts.profile(t.events(s, d), "user_id", "ts").withColumns({"low": F.col("low").cast("timestamp_ntz"), "high": F.col("high").cast("timestamp_ntz")})


def contract_violations(s, d):
    return facts.contract_violations(t.read(s, d, "events"), ["event_id", "user_id", "ts", "props"])


def contract_schema(s, d):
    """Events beside a record that names a column otherwise, wants another type and lacks one."""
    e = t.read(s, d, "events").withColumn("value", F.when(F.col("event_id") % 10 > 0, F.col("value")))
    return facts.contract(e, "event_id string, user_id bigint, at timestamp_ntz, event_type string, props string, value double", ["user_id", "props", "value"])


def profile_keys(s, d):
    return facts.rows_per_key(t.events(s, d), "user_id").withColumn("mean", F.round("mean", 4))


def frequent_users(s, d):
    return facts.frequent_keys(t.events(s, d), "user_id", 10).select("user_id", "rows", (F.col("estimate") == F.col("rows")).alias("close"))


def _dates(df, *keys):
    return df.select(*keys, _joined("dates_active").alias("dates_active"), "as_of")


def _step(s, d, *keys):
    daily = _daily(s, d, *keys)
    return _dates(datelist.datelist_step(datelist.datelist_snapshot(daily, keys, BEFORE), daily, keys, D), *keys)


def datelist_users_step(s, d):
    return _step(s, d, "user_id")


def datelist_devices_step(s, d):
    return _step(s, d, "user_id", "browser_type")


def datelist_hosts_step(s, d):
    return _step(s, d, "host")


def datelist_users_snapshot(s, d):
    return _dates(datelist.datelist_snapshot(_daily(s, d, "user_id"), ["user_id"], D), "user_id")


def datelist_device_map(s, d):
    m = datelist.datelist_map(_daily(s, d, "user_id", "browser_type"), "user_id", "browser_type", D)
    each = F.transform(F.map_entries("dates_by"), lambda e: F.concat(e["key"], F.lit("="), _joined(e["value"])))
    return m.select("user_id", F.array_join(each, ";").alias("dates_by"))


def datelist_map_merged(s, d):
    """The same maps from two loads: the days before MONTH's ninth and the others."""
    daily = _daily(s, d, "user_id", "browser_type")
    early = datelist.datelist_map(daily.where("day < DATE '2024-01-09'"), "user_id", "browser_type", D)
    late = datelist.datelist_map(daily.where("day >= DATE '2024-01-09'"), "user_id", "browser_type", D)
    entries = F.sort_array(F.map_entries("dates_by"))
    each = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), _joined(e["value"])))
    return datelist.merged_maps(early, late, "user_id").select("user_id", F.array_join(each, ";").alias("dates_by"))


def ip_numbers(s, d):
    """Addresses made of the ids of events, as numbers; those with a part above 255 are none."""
    e = t.events(s, d).select("event_id", "user_id")
    ip = F.concat_ws(".", F.lit("10"), F.pmod("event_id", F.lit(256)).cast("string"), F.pmod("user_id", F.lit(300)).cast("string"), F.lit("7"))
    return e.select("event_id", ip.alias("ip")).withColumn("number", enrich.ip_number(F.col("ip")))


def _lists(s, d):
    return datelist.datelist_snapshot(_daily(s, d, "user_id"), ["user_id"], LAST)


def datelist_int_recent(s, d):
    return datelist.datelist_int_recent(_lists(s, d), ["user_id"], LAST)


def datelist_int_month(s, d):
    return datelist.datelist_int_month(_lists(s, d), ["user_id"], MONTH)


def activity_flags(s, d):
    return datelist.activity_flags(datelist_int_recent(s, d), ["user_id"])


def date_spine(s, d):
    e = _daily(s, d, "host").where("host = 'signup'")
    return datelist.date_spine(s, MONTH, "2024-02-05").join(e, "day", "left").select("day", F.coalesce("events", F.lit(0)).alias("events"))


def _months(df, *keys, values="hit_array"):
    return df.select(*keys, "month_start", _joined(values).alias(values), "first_found")


def monthly_hits_step(s, d):
    daily = _daily(s, d, "user_id")
    prev = arrays.monthly_arrays(daily, ["user_id"], "events", MONTH, BEFORE)
    today = daily.where(F.col("day") == F.lit(D).cast("date"))
    return _months(arrays.monthly_step(prev, today, ["user_id"], "events", D), "user_id")


def monthly_hits_array(s, d):
    return _months(arrays.monthly_arrays(_daily(s, d, "user_id"), ["user_id"], "events", MONTH, LAST), "user_id")


def monthly_hits_agg(s, d):
    return arrays.first_days(arrays.monthly_arrays(_daily(s, d, "user_id"), ["user_id"], "events", MONTH, LAST), ["month_start"])


def _metrics(s, d):
    daily = _daily(s, d, "user_id").withColumn("metric_name", F.lit("site_hits"))
    prev = arrays.monthly_arrays(daily, ["user_id", "metric_name"], "events", MONTH, BEFORE, 0, "metric_array")
    return arrays.monthly_step(prev, daily.where(F.col("day") == F.lit(D).cast("date")), ["user_id", "metric_name"], "events", D, 0, "metric_array")


def array_metrics_step(s, d):
    return _months(_metrics(s, d), "user_id", "metric_name", values="metric_array")


def array_metrics_daily(s, d):
    return arrays.daily_series(_metrics(s, d), ["metric_name", "month_start"])


def array_length_hist(s, d):
    return arrays.length_histogram(_metrics(s, d), "metric_array")


def host_activity_reduced(s, d):
    m = arrays.host_month(t.events(s, d), "host", "user_id", "ts", MONTH, LAST)
    return m.select("host", "month_start", _joined("hit_array").alias("hit_array"), _joined("unique_visitors").alias("unique_visitors"))


def host_activity_step(s, d):
    """The arrays up to the day before and one day's events."""
    e = t.events(s, d)
    m = arrays.host_month_step(arrays.host_month(e, "host", "user_id", "ts", MONTH, BEFORE), e, "host", "user_id", "ts", D)
    return m.select("host", "month_start", _joined("hit_array").alias("hit_array"), _joined("unique_visitors").alias("unique_visitors"))


def host_visitors_sketch(s, d):
    """Visitors of hosts by week from daily sketches that are written once, and whether they are within 5 % of a distinct count."""
    e = t.events(s, d)
    week = lambda c: F.to_date(F.date_trunc("week", c)).alias("week")
    got = arrays.merged_sketches(writers.staged(arrays.daily_sketches(e, ["host"], "user_id", "ts")), ["host", week("day")])
    exact = e.groupBy("host", week("ts")).agg(F.count_distinct("user_id").alias("exact"))
    return got.join(exact, ["host", "week"]).select("host", "week", "hits", "exact", (F.abs(F.col("visitors") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


def growth_accounting_step(s, d):
    daily = _daily(s, d, "user_id")
    prev = datelist.datelist_snapshot(daily, ["user_id"], BEFORE).select("user_id", F.array_min("dates_active").alias("first_active"), F.array_max("dates_active").alias("last_active"), "dates_active")
    got = growth.growth_step(prev, daily, "user_id", D)
    return got.select("user_id", "first_active", "last_active", "daily_state", "weekly_state", F.size("dates_active").alias("active_days"), "as_of")


def growth_accounting(s, d):
    return growth.growth_backfill(_daily(s, d, "user_id"), "user_id", MONTH, LAST)


def retention_curve(s, d):
    return growth.retention_curve(growth_accounting(s, d)).withColumn("share", F.round("share", 6))


def state_changes(s, d):
    return growth.state_changes(_backfill(s, d), "player", "period", "is_active", 2001)


def funnel_conversion(s, d):
    return analysis.funnel_conversion(t.events(s, d), "user_id", "ts", "host", "signup", 20).withColumn("rate", F.round("rate", 6))


def device_cube(s, d):
    e = starjoin.join_dim(t.events(s, d).select(F.col("device_id").alias("d")), t.devices(s, d), F.col("device_id") == F.col("d"))
    c = ["browser_type", "os_type", "device_type"]
    return analysis.cube(e, c, [c, c[:1], c[1:2], c[2:]], [F.count("*").alias("hits")])


def traffic_windows(s, d):
    daily = _daily(s, d, "host", "browser_type").withColumnRenamed("events", "hits")
    got = analysis.traffic_windows(daily, ["host", "browser_type"], min_total=10)
    return got.withColumns({"month_share": F.round("month_share", 6), "total_share": F.round("total_share", 6)})


def traffic_windows_by_days(s, d):
    """Weeks of the calendar; without the days on which a host and browser had one hit."""
    daily = _daily(s, d, "host", "browser_type").withColumnRenamed("events", "hits").where("hits > 1")
    got = analysis.traffic_windows(daily, ["host", "browser_type"], by="days")
    return got.withColumns({"month_share": F.round("month_share", 6), "total_share": F.round("total_share", 6)})


def _cube(s, d):
    o = t.read(s, d, "orders").select(F.col("o_orderkey").alias("game"), F.year("o_orderdate").alias("season"))
    rows = t.game_rows(s, d).join(o, "game")
    return analysis.cube(rows, ["player", "team", "season"], [["player", "team"], ["player"], ["team"], ["player", "season"]], [F.sum("points").alias("points"), F.count("*").alias("games")])


def game_cube(s, d):
    return _cube(s, d)


def _team_games(s, d):
    return t.game_rows(s, d).groupBy("team", "game").agg((F.sum("plus_minus") > 0).alias("win"))


def game_leaders(s, d):
    c = _cube(s, d)
    wins = _team_games(s, d).groupBy("team").agg(F.count_if("win").alias("n"))
    return (
        analysis.leaders(c, "player__team", ["player", "team"], "points").select(F.lit("points for one team").alias("question"), F.concat_ws("/", "player", "team").alias("who"), F.col("points").alias("n"))
        .unionByName(analysis.leaders(c, "player", ["player"], "points").select(F.lit("points").alias("question"), F.col("player").alias("who"), F.col("points").alias("n")))
        .unionByName(analysis.top_n(wins, "n", ["team"], 1).select(F.lit("wins").alias("question"), F.col("team").cast("string").alias("who"), "n"))
    )


def best_stretch(s, d):
    return analysis.best_stretch(_team_games(s, d), "team", ["game"], "win")


def longest_streak(s, d):
    return analysis.longest_streak(t.read(s, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_totalprice") > 200_000)


def _players(rows):
    rows = rows.groupBy("player").agg(F.sum("points").alias("points"), F.count("*").alias("games"))
    return graph.vertices(rows, "player", "player", {"points": F.col("points"), "games": F.col("games")}, [F.col("player")])


def vertices_suppliers(s, d):
    v = graph.vertices(t.read(s, d, "supplier"), "s_suppkey", "team", {"name": F.col("s_name"), "nation": F.col("s_nationkey")}, [F.col("s_name")])
    return v.select("identifier", "type", F.col("properties")["name"].alias("name"), F.col("properties")["nation"].alias("nation"))


def _plays_in(rows):
    return graph.edges(rows.select("player", "game", "team", "points"), ("player", "player"), ("game", "game"), "plays_in", {"team": F.col("team"), "points": F.col("points")}, [F.col("points")], descending=True)


def edges_plays_in(s, d):
    return _plays_in(t.game_rows(s, d)).withColumns({"team": F.col("properties")["team"], "points": F.col("properties")["points"]}).drop("properties")


def edges_pairs(s, d):
    return graph.co_occurrence(t.game_rows(s, d), "game", "player", "team", "points")


def graph_points_per_game(s, d):
    rows = writers.staged(t.game_rows(s, d))
    got = graph.property_ratio(_plays_in(rows), _players(rows), "player", "points", "games")
    return got.select("subject_id", "object_id", F.round("ratio", 4).alias("ratio"))


def avg_per_player(s, d):
    return starjoin.average_per_key(t.read(s, d, "lineitem"), "l_partkey", "l_quantity").select("l_partkey", F.round("average", 4).alias("average"))


def top_playlist(s, d):
    return starjoin.most_frequent(t.read(s, d, "orders"), "o_orderpriority", "o_orderkey")


def _maps(s, d):
    c = t.read(s, d, "customer").join(starjoin.sized_broadcast(t.read(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return t.read(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")


def top_map(s, d):
    return starjoin.most_frequent(_maps(s, d), "n_name", "o_orderkey")


def top_map_for_medal(s, d):
    medal = t.read(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return starjoin.most_frequent(_maps(s, d).join(medal, "o_orderkey"), "n_name", "o_orderkey")


def user_device_rollup(s, d):
    return starjoin.user_device_rollup(t.events(s, d), "user_id", "device_id", "host")


def device_users(s, d):
    return starjoin.device_users(t.events(s, d), "user_id", "device_id")


def events_with_device(s, d):
    e = t.events(s, d).withColumn("referrer", F.when(F.col("host") != "error", F.col("host")))
    return starjoin.events_with_device(e, t.devices(s, d), "device_id", "referrer", "browser_type").select("event_id", "device_id", "referrer", "browser_type", "os_type")


def upsert_latest(s, d):
    o = t.read(s, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderkey")
    per = lambda rows: rows.groupBy("o_custkey").agg(F.max("year").alias("year"), F.count("*").alias("orders"))
    return writers.upsert(per(o.where("year < 2000")), per(o.where("year = 2000")), ["o_custkey"])


def upsert_on_disk(s, d):
    """Orders of customers and years as a table of versions: a first load, then all orders of two years anew, which
    replace some keys of two periods and add others."""
    o = t.read(s, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderkey", "o_totalprice")
    path = writers.work_folder(s)
    per = lambda rows, load: rows.groupBy("o_custkey", "year").agg(F.count("*").alias("orders"), F.max("o_orderkey").alias("last_order")).withColumn("load", F.lit(load))
    writers.upsert_version(per(o.where("o_totalprice < 150000"), 1), path, ["o_custkey", "year"], "year")
    new = per(o.where("year IN (1996, 1997) AND o_orderkey % 3 > 0"), 2)
    writers.upsert_version(new, path, ["o_custkey", "year"], "year")
    return writers.read_version(s, path, new.schema)


def bucketed_join(s, d):
    """Two tables bucketed by the order key, joined without an exchange."""
    facts_ = {"details": (t.read(s, d, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey"), "games": (t.read(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")}
    x = layout.bucketed(s, facts_, 16, writers.work_folder(s))
    return x["details"].join(x["games"], F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("rows"), F.sum("l_quantity").cast("long").alias("quantity"))


def bucketed_star(s, d):
    """Three facts bucketed by the order key, joined in a chain without an exchange of any, then small dimensions by
    broadcast: quantity by customers' nation and whether the order has a returned item."""
    li = t.read(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
    medals = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("m_orderkey")).distinct()
    facts_ = {"details": (li.drop("l_returnflag"), "l_orderkey"), "games": (t.read(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey"), "medals": (medals, "m_orderkey")}
    x = layout.bucketed(s, facts_, 16, writers.work_folder(s))
    chain = x["details"].join(x["games"], F.col("l_orderkey") == F.col("o_orderkey")).join(x["medals"], F.col("l_orderkey") == F.col("m_orderkey"), "left")
    n = t.read(s, d, "nation").select("n_nationkey", "n_name")
    teams = starjoin.join_dim(t.read(s, d, "supplier").select("s_suppkey", "s_nationkey"), n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    wide = starjoin.join_dim(chain, teams, F.col("l_suppkey") == F.col("s_suppkey"))
    return wide.groupBy("n_name", "o_orderpriority", F.col("m_orderkey").isNotNull().alias("returned")).agg(F.count("*").alias("rows"), F.sum("l_quantity").cast("long").alias("quantity"))


def broadcast_join(s, d):
    sup = t.read(s, d, "supplier")
    return starjoin.join_dim(t.read(s, d, "lineitem"), sup, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(F.count("*").alias("rows"))


def classify_referrer(s, d):
    return enrich.classify(t.read(s, d, "pages"), "url", REFERRERS, "referrer").select("page_id", "referrer")


def _ranges(s, d):
    n = t.read(s, d, "nation")
    return n.select((F.col("n_nationkey") * 6).cast("long").alias("ip_from"), (F.col("n_nationkey") * 6 + 4).cast("long").alias("ip_to"), F.col("n_name").alias("country"), F.col("n_regionkey").cast("string").alias("state"))


def _all_ranges(s, d):
    """Nations' short ranges, and a wide one for each region that overlaps them and other regions'."""
    r = t.read(s, d, "region")
    wide = r.select((F.col("r_regionkey") * 40 + 3).cast("long").alias("ip_from"), (F.col("r_regionkey") * 40 + 100_000_000 + F.col("r_regionkey")).cast("long").alias("ip_to"), F.col("r_name").alias("country"), F.lit(None).cast("string").alias("state"))
    return _ranges(s, d).unionByName(wide)


def _numbers(s, d):
    """Numbers near ranges' ends and far off, and none for one event in eleven."""
    e = t.events(s, d).select("event_id", "user_id")
    far = F.when(F.col("event_id") % 3 == 0, F.col("event_id") * 40_001).otherwise(F.col("user_id"))
    return e.withColumn("number", F.when(F.col("event_id") % 11 > 0, far))


def geo_enrich(s, d):
    return enrich.range_lookup(t.events(s, d), _ranges(s, d), "user_id", "ip_from", "ip_to", ["country", "state"]).select("event_id", "user_id", "geodata")


def geo_wide_ranges(s, d):
    """Ranges of all lengths that overlap, by joins."""
    return enrich.range_lookup(_numbers(s, d), _all_ranges(s, d), "number", "ip_from", "ip_to", ["country", "state"]).select("event_id", "number", "geodata")


def geo_index(s, d):
    """The same by an index in every task."""
    return enrich.index_lookup(_numbers(s, d), _all_ranges(s, d), "number", "ip_from", "ip_to", ["country", "state"]).select("event_id", "number", "geodata")


def dedupe_events(s, d):
    return dedupe.distinct_on(t.events(s, d).withColumn("day", F.to_date("ts")), ["user_id", "host", "day"])


def dedupe_first(s, d):
    return dedupe.keep_first(t.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey", "l_linenumber"], [F.col("l_partkey")], descending=True)


def top_n(s, d):
    return analysis.top_n(t.read(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 10)


def layout_sorted(s, d):
    return layout.sorted_for_files(t.read(s, d, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").withColumn("l_shipdate", F.to_date("l_shipdate")), ["l_shipdate", "l_orderkey"])


def layout_report(s, d):
    li = t.read(s, d, "lineitem")
    return layout.layout_report(s, {"as_read": li, "sorted": layout.sorted_for_files(li, ["l_shipdate", "l_suppkey"])}, writers.work_folder(s))


def layout_rows(s, d):
    """What each layout of the report holds; files and bytes are the report's own."""
    return layout_report(s, d).select("layout", "rows")


def stream_parse(s, d):
    e = t.events(s, d)
    raw = e.select(F.to_json(F.struct(F.col("host").alias("url"), "host", F.col("user_id").cast("string").alias("ip"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("event_time"))).alias("value"))
    return jobs.parse_events(raw).select("host", "ip", F.col("event_time"), F.col("event_timestamp").isNotNull().alias("parsed"))


def kafka_rows(s, d):
    """Counts of hosts and windows as messages for a topic."""
    return writers.kafka_rows(jobs.tumbling_counts(t.events(s, d), ["host"], "ts", "1 day").select("host", F.date_format("event_hour", "yyyy-MM-dd").alias("day"), "num_hits"))


def tumbling_host(s, d):
    return jobs.tumbling_counts(t.events(s, d), ["host"], "ts").withColumn("event_hour", F.col("event_hour").cast("timestamp_ntz"))


def tumbling_host_referrer(s, d):
    e = t.events(s, d).withColumn("referrer", F.concat(F.lit("r"), F.pmod("user_id", F.lit(3)).cast("string")))
    return jobs.tumbling_counts(e, ["host", "referrer"], "ts").withColumn("event_hour", F.col("event_hour").cast("timestamp_ntz"))


def _sessions(s, d):
    return jobs.sessions(t.events(s, d).withColumn("ip", F.pmod("user_id", F.lit(8))), ["ip", "host"], "ts")


def sessions(s, d):
    return _sessions(s, d).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")}).drop("session_duration")


def session_avg_by_host(s, d):
    return jobs.average_session(_sessions(s, d), "host").withColumn("average_events", F.round("average_events", 6))


def arrivals(s, d):
    """Events in three loads, cut within a window; one in fifty of the first ones comes only with the last load, behind
    the watermark."""
    e = t.events(s, d).select("event_id", "ts", "host", F.pmod("user_id", F.lit(8)).alias("ip"), F.concat(F.lit("r"), F.pmod("user_id", F.lit(3)).cast("string")).alias("referrer"))
    cut = [F.lit(c).cast("timestamp") for c in CUTS]
    late = (F.pmod("event_id", F.lit(50)) == 7) & (F.col("ts") < cut[0])
    return [e.where((F.col("ts") < cut[0]) & ~late), e.where(F.col("ts").between(*cut) & (F.col("ts") < cut[1])), e.where((F.col("ts") >= cut[1]) | late)]


def _streamed(s, d, loads=list, **makes):
    """What each query on the stream of arrivals has put out, each into its own folder. loads: what is made of the
    arrivals before they land."""
    folder = writers.work_folder(s)
    jobs.replay(loads(arrivals(s, d)), f"{folder}/in", {n: (m, f"{folder}/{n}") for n, m in makes.items()}, f"{folder}/checkpoints")
    out = {n: s.read.parquet(f"{folder}/{n}") for n in makes}
    return [df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"}) for df in out.values()]


def stream_tumbling_host(s, d):
    """Counts of closed windows as a stream gives them, restarted twice."""
    return _streamed(s, d, hosts=lambda e: jobs.tumbling_counts(e, ["host"], "ts"))[0]


def _messages(loads):
    """Loads as a topic has them: JSON text in a column value."""
    fields = F.struct("host", "referrer", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("event_time"))
    return [x.select(F.to_json(fields).alias("value")) for x in loads]


def stream_two_sinks(s, d):
    """JSON messages, parsed; two queries on one source with their own sinks and checkpoints."""
    count = lambda *keys: lambda e: jobs.tumbling_counts(jobs.parse_events(e), keys, "event_timestamp")
    hosts, referrers = _streamed(s, d, _messages, hosts=count("host"), referrers=count("host", "referrer"))
    return hosts.withColumn("referrer", F.lit(None).cast("string")).unionByName(referrers)


def stream_sessions(s, d):
    """Sessions that the watermark has closed, from state that two restarts carry on."""
    return _streamed(s, d, sessions=lambda e: jobs.sessions(e, ["ip", "host"], "ts"))[0].drop("session_duration")


def stream_session_avg(s, d):
    """A batch over what the stream of sessions has stored."""
    return jobs.average_session(stream_sessions(s, d), "host").withColumn("average_events", F.round("average_events", 6))


def stream_geo_enrich(s, d):
    """Every event of the stream with its place, by the index and by joins with the table; nothing waits for a watermark."""
    spread = F.pmod(F.col("event_id") * 37, F.lit(400))
    look = lambda find: lambda e: find(e.select("event_id", spread.alias("number")), _all_ranges(s, d), "number", "ip_from", "ip_to", ["country", "state"])
    index, joins = _streamed(s, d, index=look(enrich.index_lookup), joins=look(enrich.range_lookup))
    return index.join(joins.withColumnRenamed("geodata", "joined"), ["event_id", "number"], "full")


def host_month_upserted(s, d):
    """A month's table of hosts on disk that two days are loaded into, one after the other, and the last one again."""
    e, path = t.events(s, d), writers.work_folder(s)
    writers.upsert_version(arrays.host_month(e, "host", "user_id", "ts", MONTH, "2024-01-13"), path, ["host", "month_start"], "month_start")
    for day in (BEFORE, D, D):
        table = writers.read_version(s, path, "host string, month_start date, hit_array array<bigint>, unique_visitors array<bigint>")
        writers.upsert_version(arrays.host_month_step(table, e, "host", "user_id", "ts", day), path, ["host", "month_start"], "month_start")
    m = writers.read_version(s, path, table.schema)
    return m.select("host", "month_start", _joined("hit_array").alias("hit_array"), _joined("unique_visitors").alias("unique_visitors"))


def period_overwritten(s, d):
    """Orders in partitions by year, of which two are written again with other rows."""
    o = t.read(s, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), F.lit(1).alias("load"))
    path = writers.work_folder(s)
    writers.write_period(o, path, "year")
    writers.write_period(o.where("year IN (1996, 2001) AND o_orderkey % 2 = 0").withColumn("load", F.lit(2)), path, "year")
    return readers.read_parquet(s, path).select("o_orderkey", "o_custkey", "year", "load")


def table_overwritten(s, d):
    """A catalog table made from customers, overwritten by those of some nations with their columns in another order, and
    read by name."""
    c = t.read(s, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("nation"))
    name = f"customers_{uuid.uuid4().hex}"
    writers.create_table(c, name, path=f"{writers.work_folder(s)}/t")
    writers.insert_overwrite(c.where("nation < 10").select("nation", F.upper("c_name").alias("c_name"), "c_custkey"), name)
    out = readers.read_table(s, name)
    out.schema  # resolved while the catalog has it
    s.sql(f"DROP TABLE {name}")  # its files stay
    return out


def csv_orders(s, d):
    """Orders through CSV files, read with a schema that is given, and as strings that are cast."""
    path = writers.work_folder(s)
    t.read(s, d, "orders").select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"), F.col("o_custkey").cast("string").alias("customer")).write.option("header", True).csv(path)
    typed = readers.read_csv(s, path, "o_orderkey long, o_orderpriority string, day date, customer long")
    plain = readers.read_csv(s, path, "o_orderkey string, o_orderpriority string, day string, customer string")
    plain = plain.select(F.col("o_orderkey").cast("long"), "o_orderpriority", F.col("day").cast("date"), F.col("customer").cast("long"))
    one = lambda df, how: df.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.min("day").alias("first"), F.max("day").alias("last"), F.sum("customer").alias("customers")).withColumn("read", F.lit(how))
    return one(typed, "typed").unionByName(one(plain, "strings"))


QUERIES = {
    f.__name__: f
    for f in (
        activity_flags, cumulate_seasons_step, cumulate_seasons_backfill, cumulate_seasons_as_of, unnest_history, ratio_last_first, scd2_backfill, scd2_incremental, latest_snapshot, ever_active, new_keys_anti, max_class, fact_lineitems, fact_join_dim, daily_activity,
        profile_events, profile_keys, frequent_users, contract_violations, contract_schema, datelist_users_step, datelist_devices_step, datelist_hosts_step, datelist_users_snapshot, datelist_device_map, datelist_map_merged, datelist_int_recent, datelist_int_month, date_spine,
        monthly_hits_step, monthly_hits_array, monthly_hits_agg, array_metrics_step, array_metrics_daily, array_length_hist, host_activity_reduced, host_activity_step, host_visitors_sketch, growth_accounting_step, growth_accounting, retention_curve, state_changes,
        funnel_conversion, device_cube, traffic_windows, traffic_windows_by_days, game_cube, game_leaders, best_stretch, longest_streak, vertices_suppliers, edges_plays_in, edges_pairs, graph_points_per_game, avg_per_player, top_playlist, top_map,
        top_map_for_medal, user_device_rollup, device_users, events_with_device, upsert_latest, upsert_on_disk, bucketed_join, bucketed_star, broadcast_join, classify_referrer, geo_enrich, geo_wide_ranges, geo_index, ip_numbers, dedupe_events, dedupe_first, top_n, layout_sorted, layout_report, layout_rows,
        stream_tumbling_host, stream_two_sinks, stream_sessions, stream_session_avg, stream_geo_enrich, host_month_upserted, period_overwritten, table_overwritten, csv_orders,
        stream_parse, kafka_rows, tumbling_host, tumbling_host_referrer, sessions, session_avg_by_host,
    )
}
