"""The registered questions as DuckDB SQL, written from their meaning and not from the jobs' plans."""

from __future__ import annotations

from tidemark.plans.queries import CUTS, LAST, MONTH, D

_DAYS = "d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE user_id IS NOT NULL)"
_E = "e AS (SELECT event_id, user_id, event_type AS host, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS device_id FROM events)"
_EB = _E + ", eb AS (SELECT e.*, p_brand AS browser_type FROM e JOIN part ON p_partkey = device_id)"
_SEASON = """y AS (SELECT o_custkey AS player, CAST(year(o_orderdate) AS INT) AS season, avg(o_totalprice) AS mean_value FROM orders GROUP BY ALL),
yc AS (SELECT *, CASE WHEN mean_value > 300000 THEN 'star' WHEN mean_value > 250000 THEN 'good' WHEN mean_value > 200000 THEN 'average' ELSE 'bad' END AS class FROM y)"""


def _snap(last: int) -> str:
    """Every player's state in each year from the first to last."""
    return f"""{_SEASON},
f AS (SELECT player, min(season) AS first FROM y WHERE season <= {last} GROUP BY 1),
sp AS (SELECT player, CAST(unnest(range(first, {last} + 1)) AS INT) AS period FROM f),
snap AS (SELECT sp.player, period,
  (SELECT class FROM yc WHERE yc.player = sp.player AND season <= period ORDER BY season DESC LIMIT 1) AS class,
  CAST(period - (SELECT max(season) FROM y WHERE y.player = sp.player AND season <= period) AS INT) AS periods_since_active
  FROM sp)"""


def _snapshot(last: int, where: str) -> str:
    return f"""WITH {_snap(last)}
SELECT s.player, CAST((SELECT count(*) FROM orders WHERE o_custkey = s.player AND year(o_orderdate) <= period) AS INT) AS items,
  (SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY year(o_orderdate), o_orderkey) FROM orders WHERE o_custkey = s.player AND year(o_orderdate) <= period) AS order_keys,
  class, periods_since_active, periods_since_active = 0 AS is_active, period FROM snap s WHERE {where}"""


def _scd(upto: int) -> str:
    return f"""WITH {_snap(2001)}, h AS (SELECT player, period, class, periods_since_active = 0 AS is_active FROM snap WHERE period <= {upto}),
g AS (SELECT *, period - row_number() OVER (PARTITION BY player, class, is_active ORDER BY period) AS island FROM h)
SELECT player, class, is_active, CAST(min(period) AS INT) AS start_period, CAST(max(period) AS INT) AS end_period FROM g GROUP BY player, class, is_active, island"""


def _datelist(cte: str, source: str, keys: str, day: str) -> str:
    return f"""WITH {cte}, x AS (SELECT DISTINCT {keys}, CAST(ts AS DATE) AS day FROM {source})
SELECT {keys}, string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) AS dates_active, DATE '{day}' AS as_of FROM x WHERE day <= DATE '{day}' GROUP BY {keys}"""


def _month(last: str, extra: str = "", fill: str = "null", values: str = "hit_array") -> str:
    return f"""WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE user_id IS NOT NULL AND CAST(ts AS DATE) <= DATE '{last}' GROUP BY ALL),
u AS (SELECT user_id, min(day) AS first_found FROM a GROUP BY 1),
s AS (SELECT user_id, first_found, CAST(unnest(generate_series(DATE '{MONTH}', DATE '{last}', INTERVAL 1 DAY)) AS DATE) AS day FROM u)
SELECT s.user_id, {extra} DATE '{MONTH}' AS month_start, string_agg(coalesce(CAST(n AS VARCHAR), '{fill}'), ',' ORDER BY s.day) AS {values}, first_found
FROM s LEFT JOIN a ON a.user_id = s.user_id AND a.day = s.day GROUP BY s.user_id, first_found"""


def _hosts(last: str) -> str:
    return f"""WITH a AS (SELECT event_type AS host, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS v FROM events GROUP BY ALL),
s AS (SELECT DISTINCT host, CAST(unnest(generate_series(DATE '{MONTH}', DATE '{last}', INTERVAL 1 DAY)) AS DATE) AS day FROM a WHERE day <= DATE '{last}')
SELECT s.host, DATE '{MONTH}' AS month_start, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY s.day) AS hit_array, string_agg(CAST(coalesce(v, 0) AS VARCHAR), ',' ORDER BY s.day) AS unique_visitors FROM s LEFT JOIN a ON a.host = s.host AND a.day = s.day GROUP BY 1"""


_STATES = f"""{_DAYS}, f AS (SELECT user_id, min(day) AS first_active FROM d GROUP BY 1),
s AS (SELECT user_id, first_active, CAST(unnest(generate_series(first_active, DATE '{LAST}', INTERVAL 1 DAY)) AS DATE) AS as_of FROM f),
m AS (SELECT s.*, EXISTS (SELECT 1 FROM d WHERE d.user_id = s.user_id AND day = as_of) AS a, (SELECT max(day) FROM d WHERE d.user_id = s.user_id AND day < as_of) AS lp FROM s),
st AS (SELECT user_id, first_active, CASE WHEN a THEN as_of ELSE lp END AS last_active,
  CASE WHEN lp IS NULL THEN 'New' WHEN a AND as_of - lp = 1 THEN 'Retained' WHEN a THEN 'Resurrected' WHEN as_of - lp = 1 THEN 'Churned' ELSE 'Stale' END AS daily_state,
  CASE WHEN lp IS NULL THEN 'New' WHEN a AND as_of - lp > 7 THEN 'Resurrected' WHEN a OR as_of - lp <= 7 THEN 'Retained' WHEN as_of - lp = 8 THEN 'Churned' ELSE 'Stale' END AS weekly_state,
  as_of FROM m)"""
_BITS = f"""{_DAYS}, b AS (SELECT user_id, CAST(sum(CASE WHEN DATE '{LAST}' - day BETWEEN 0 AND 31 THEN CAST(1 AS BIGINT) << CAST(31 - (DATE '{LAST}' - day) AS INT) ELSE 0 END) AS BIGINT) AS bits FROM d WHERE day <= DATE '{LAST}' GROUP BY 1)"""
_WEEK, _WEEK_BEFORE = sum(1 << (31 - i) for i in range(7)), sum(1 << (31 - i) for i in range(7, 14))
_GAMES = """li AS (SELECT l_orderkey AS game, l_suppkey AS team, l_partkey AS player, l_linenumber, CAST(l_quantity AS BIGINT) AS points, CASE l_returnflag WHEN 'R' THEN -1 WHEN 'A' THEN 1 ELSE 0 END AS plus_minus FROM lineitem),
gr AS (SELECT game, player, team, points, plus_minus FROM li QUALIFY row_number() OVER (PARTITION BY game, player ORDER BY l_linenumber, team, points, plus_minus) = 1)"""
_CUBE = _GAMES + """, gs AS (SELECT CAST(player AS VARCHAR) AS player, CAST(team AS VARCHAR) AS team, CAST(year(o_orderdate) AS VARCHAR) AS season, points FROM gr JOIN orders ON o_orderkey = game),
cu AS (SELECT CASE WHEN grouping(player) = 0 AND grouping(team) = 0 THEN 'player__team' WHEN grouping(player) = 0 AND grouping(season) = 0 THEN 'player__season' WHEN grouping(player) = 0 THEN 'player' ELSE 'team' END AS level,
  coalesce(player, '(overall)') AS player, coalesce(team, '(overall)') AS team, coalesce(season, '(overall)') AS season, CAST(sum(points) AS BIGINT) AS points, count(*) AS games
  FROM gs GROUP BY GROUPING SETS ((player, team), (player), (team), (player, season)))"""
_TEAMS = _GAMES + ", tg AS (SELECT team, game, sum(plus_minus) > 0 AS win FROM gr GROUP BY ALL)"
_EDGES = _GAMES + """, ed AS (SELECT game, player, team, points FROM gr)"""


def _sessions(of: str) -> str:
    return f"""q AS (SELECT user_id % 8 AS ip, host, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS new FROM {of} WINDOW w AS (PARTITION BY user_id % 8, host ORDER BY ts)),
i AS (SELECT *, sum(new) OVER (PARTITION BY ip, host ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM q),
ss AS (SELECT ip, host, min(ts) AS session_start, max(ts) + INTERVAL 5 MINUTE AS session_end, count(*) AS event_count FROM i GROUP BY ip, host, n)"""


_SESSIONS = f"{_E}, {_sessions('e')}"
_IN_TIME = f"it AS (SELECT user_id, event_type AS host, ts, 'r' || (user_id % 3) AS referrer FROM events WHERE NOT (event_id % 50 = 7 AND ts < TIMESTAMP '{CUTS[0]}'))"
_CLOSED = "(SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL"


def _windows(*keys: str) -> str:
    counts = f"SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS event_hour, {', '.join(keys)}, count(*) AS num_hits FROM it GROUP BY ALL"
    return f"SELECT * FROM ({counts}) WHERE event_hour + INTERVAL 5 MINUTE <= {_CLOSED} 15 SECOND"


_PLACES = """r AS (SELECT n_nationkey * 6 AS lo, n_nationkey * 6 + 4 AS hi, '{"country":"' || n_name || '","state":"' || n_regionkey || '"}' AS place FROM nation
  UNION ALL SELECT r_regionkey * 40 + 3, r_regionkey * 40 + 100000000 + r_regionkey, '{"country":"' || r_name || '","state":null}' FROM region)"""
_MAPS = "mp AS (SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"

ORACLE_SQL = {
    "ip_numbers": """SELECT event_id, '10.' || (event_id % 256) || '.' || coalesce(CAST(user_id % 300 AS VARCHAR) || '.7', '7') AS ip,
  CASE WHEN user_id % 300 <= 255 THEN CAST(10 * 16777216 + (event_id % 256) * 65536 + (user_id % 300) * 256 + 7 AS BIGINT) END AS number FROM events""",
    "latest_snapshot": f"WITH {_snap(2001)} SELECT player, class, periods_since_active, periods_since_active = 0 AS is_active, period FROM snap WHERE period = (SELECT max(period) FROM snap)",
    "ever_active": f"WITH {_snap(2001)} SELECT player, bool_or(periods_since_active = 0) AS ever_active, bool_and(periods_since_active = 0) AS always_active FROM snap GROUP BY player",
    "layout_rows": "SELECT layout, count(*) AS rows FROM lineitem, (VALUES ('as_read'), ('sorted')) v(layout) GROUP BY layout",
    "activity_flags": f"WITH {_BITS} SELECT user_id, CAST(bit_count(bits) AS INT) AS l32, bits <> 0 AS monthly_active, CAST(bit_count(bits & {_WEEK}) AS INT) AS l7, (bits & {_WEEK}) <> 0 AS weekly_active, (bits & {_WEEK_BEFORE}) <> 0 AS active_week_before FROM b",
    "datelist_int_recent": f"WITH {_BITS} SELECT user_id, bits, DATE '{LAST}' AS as_of FROM b",
    "datelist_int_month": f"WITH {_DAYS} SELECT user_id, CAST(sum(CASE WHEN day >= DATE '{MONTH}' AND day < DATE '2024-02-01' THEN CAST(1 AS BIGINT) << CAST(32 - day(day) AS INT) ELSE 0 END) AS BIGINT) AS bits, DATE '2024-01-31' AS as_of FROM d WHERE day <= DATE '{LAST}' GROUP BY 1",
    "cumulate_seasons_step": _snapshot(2000, "period = 2000"),
    "cumulate_seasons_backfill": _snapshot(1998, "true"),
    "cumulate_seasons_as_of": _snapshot(1999, "period = 1999"),
    "unnest_history": "SELECT o_custkey AS player, CAST(year(o_orderdate) AS INT) AS season, o_orderkey, o_totalprice AS points FROM orders WHERE year(o_orderdate) <= 2001",
    "ratio_last_first": """WITH x AS (SELECT o_custkey AS player, first(o_totalprice ORDER BY year(o_orderdate), o_orderkey) AS a, last(o_totalprice ORDER BY year(o_orderdate), o_orderkey) AS z FROM orders GROUP BY 1)
SELECT player, round(z / CASE WHEN a = 0 THEN 1 ELSE a END, 4) AS ratio FROM x""",
    "scd2_backfill": _scd(2000),
    "scd2_incremental": _scd(2001),
    "new_keys_anti": "SELECT DISTINCT o_custkey AS player FROM orders WHERE year(o_orderdate) = 1996 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995)",
    "max_class": f"WITH {_SEASON} SELECT player, CASE max(CASE class WHEN 'star' THEN 4 WHEN 'good' THEN 3 WHEN 'average' THEN 2 ELSE 1 END) WHEN 4 THEN 'star' WHEN 3 THEN 'good' WHEN 2 THEN 'average' ELSE 'bad' END AS best_class FROM yc GROUP BY 1",
    "fact_lineitems": """WITH x AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey, l_partkey ORDER BY l_linenumber, l_quantity, l_extendedprice) = 1)
SELECT CAST(o_orderdate AS DATE) AS dim_game_date, l_orderkey AS dim_game, l_suppkey AS dim_team, l_partkey AS dim_player, o_custkey % 100 = l_suppkey AS dim_is_home,
  contains(o_orderpriority, 'URGENT') AS dim_is_urgent, contains(o_orderpriority, 'LOW') AS dim_is_low, round(floor(l_quantity) + l_linenumber / 60.0, 4) AS m_minutes, CAST(l_quantity AS BIGINT) AS m_points FROM x JOIN orders ON l_orderkey = o_orderkey""",
    "fact_join_dim": """WITH x AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey, l_partkey ORDER BY l_linenumber, l_quantity, l_extendedprice) = 1)
SELECT s_name, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS points, count(*) AS rows FROM x JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""",
    "daily_activity": "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS events FROM events WHERE user_id IS NOT NULL GROUP BY ALL",
    "profile_events": "SELECT count(*) AS rows, count(DISTINCT user_id) AS distinct_keys, min(ts) AS low, max(ts) AS high FROM events",
    "contract_violations": "SELECT count(*) FILTER (event_id IS NULL) AS event_id_nulls, count(*) FILTER (user_id IS NULL) AS user_id_nulls, count(*) FILTER (ts IS NULL) AS ts_nulls, count(*) FILTER (props IS NULL) AS props_nulls FROM events",
    "contract_schema": """SELECT 'at' AS column, 'missing' AS problem, 'timestamp_ntz' AS declared, NULL AS actual, CAST(NULL AS BIGINT) AS rows
UNION ALL (SELECT 'ts', 'extra', NULL, CASE typeof(ts) WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE typeof(ts) END, NULL FROM events LIMIT 1)
UNION ALL (SELECT 'event_id', 'type', 'string', lower(typeof(event_id)), NULL FROM events LIMIT 1)
UNION ALL SELECT 'value', 'null', 'not null', 'null', count(*) FILTER (event_id % 10 = 0 OR value IS NULL) FROM events
UNION ALL SELECT * FROM (SELECT 'user_id', 'null', 'not null', 'null', count(*) FILTER (user_id IS NULL) AS n FROM events UNION ALL SELECT 'props', 'null', 'not null', 'null', count(*) FILTER (props IS NULL) FROM events) WHERE n > 0""",
    "profile_keys": "SELECT count(*) AS keys, min(n) AS fewest, max(n) AS most, round(avg(n), 4) AS mean, count(*) FILTER (n = 1) AS single FROM (SELECT count(*) AS n FROM events GROUP BY user_id)",
    "frequent_users": "SELECT user_id, count(*) AS rows, true AS close FROM events WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "datelist_users_step": _datelist(_E, "e", "user_id", D),
    "datelist_devices_step": _datelist(_EB, "eb", "user_id, browser_type", D),
    "datelist_hosts_step": _datelist(_E, "e", "host", D),
    "datelist_users_snapshot": _datelist(_E, "e", "user_id", D),
    "datelist_device_map": f"""WITH {_EB}, x AS (SELECT DISTINCT user_id, browser_type, CAST(ts AS DATE) AS day FROM eb WHERE CAST(ts AS DATE) <= DATE '{D}'),
z AS (SELECT user_id, browser_type, string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) AS l FROM x GROUP BY ALL) SELECT user_id, string_agg(browser_type || '=' || l, ';' ORDER BY browser_type) AS dates_by FROM z GROUP BY 1""",
    "date_spine": f"""WITH s AS (SELECT CAST(unnest(generate_series(DATE '{MONTH}', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day) SELECT day, count(event_id) AS events FROM s LEFT JOIN events ON CAST(ts AS DATE) = day AND event_type = 'signup' GROUP BY 1""",
    "monthly_hits_step": _month(D),
    "monthly_hits_array": _month(LAST),
    "monthly_hits_agg": f"SELECT DATE '{MONTH}' AS month_start, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-01') AS num_hits_first_day, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-02') AS num_hits_second_day, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-03') AS num_hits_third_day FROM events",
    "array_metrics_step": _month(D, "'site_hits' AS metric_name,", "0", "metric_array"),
    "array_metrics_daily": f"SELECT 'site_hits' AS metric_name, DATE '{MONTH}' AS month_start, CAST(ts AS DATE) AS day, count(*) AS value FROM events WHERE CAST(ts AS DATE) <= DATE '{D}' GROUP BY 3",
    "array_length_hist": f"SELECT CAST(15 AS INT) AS length, count(DISTINCT user_id) AS rows FROM events WHERE CAST(ts AS DATE) <= DATE '{D}'",
    "host_activity_reduced": _hosts(LAST),
    "host_activity_step": _hosts(D),
    "host_visitors_sketch": "SELECT event_type AS host, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS hits, count(DISTINCT user_id) AS exact, true AS close FROM events GROUP BY ALL",
    "growth_accounting_step": f"WITH {_STATES} SELECT *, CAST((SELECT count(*) FROM d WHERE d.user_id = st.user_id AND day <= DATE '{D}') AS INT) AS active_days FROM st WHERE as_of = DATE '{D}'",
    "growth_accounting": f"WITH {_STATES} SELECT * FROM st",
    "retention_curve": f"WITH {_STATES} SELECT CAST(as_of - first_active AS INT) AS days_since_first, count(*) AS keys, count(*) FILTER (last_active = as_of) AS active, round(count(*) FILTER (last_active = as_of) / count(*), 6) AS share FROM st GROUP BY 1",
    "state_changes": """WITH p AS (SELECT DISTINCT o_custkey AS player, year(o_orderdate) AS y FROM orders), f AS (SELECT player, min(y) AS first FROM p GROUP BY 1),
x AS (SELECT player, first, EXISTS (SELECT 1 FROM p WHERE p.player = f.player AND y = 2000) AS was, EXISTS (SELECT 1 FROM p WHERE p.player = f.player AND y = 2001) AS now FROM f WHERE first <= 2001)
SELECT player, CASE WHEN first = 2001 THEN 'New' WHEN was AND now THEN 'Continued Playing' WHEN was THEN 'Retired' WHEN now THEN 'Returned from Retirement' ELSE 'Stayed Retired' END AS change FROM x""",
    "funnel_conversion": f"""WITH x AS (SELECT DISTINCT user_id, ts, event_type AS step FROM events WHERE user_id IS NOT NULL),
z AS (SELECT a.user_id, a.ts, a.step, max(CASE WHEN b.step = 'signup' THEN 1 ELSE 0 END) AS c FROM x a JOIN x b ON a.user_id = b.user_id AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE) AND b.ts > a.ts GROUP BY ALL)
SELECT step, count(*) AS events, CAST(sum(c) AS BIGINT) AS conversions, round(sum(c) / count(*), 6) AS rate FROM z GROUP BY 1 HAVING sum(c) > 0 AND count(*) > 20""",
    "device_cube": f"""WITH {_E} SELECT CASE WHEN grouping(p_brand) + grouping(p_type) + grouping(p_size) = 0 THEN 'browser_type__os_type__device_type' WHEN grouping(p_brand) = 0 THEN 'browser_type' WHEN grouping(p_type) = 0 THEN 'os_type' ELSE 'device_type' END AS level,
  coalesce(p_brand, '(overall)') AS browser_type, coalesce(p_type, '(overall)') AS os_type, coalesce(CAST(p_size AS VARCHAR), '(overall)') AS device_type, count(*) AS hits
FROM e JOIN part ON p_partkey = device_id GROUP BY GROUPING SETS ((p_brand, p_type, p_size), (p_brand), (p_type), (p_size))""",
    "traffic_windows": f"""WITH {_EB}, a AS (SELECT host, browser_type, CAST(ts AS DATE) AS day, count(*) AS hits FROM eb GROUP BY ALL),
w AS (SELECT *, CAST(date_trunc('month', day) AS DATE) AS month_start, CAST(sum(hits) OVER (PARTITION BY host, browser_type, date_trunc('month', day)) AS BIGINT) AS month_total, CAST(sum(hits) OVER p AS BIGINT) AS total,
  CAST(sum(hits) OVER (p ORDER BY day) AS BIGINT) AS running, CAST(sum(hits) OVER (p ORDER BY day ROWS 6 PRECEDING) AS BIGINT) AS rolling_7, CAST(sum(hits) OVER (p ORDER BY day ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING) AS BIGINT) AS rolling_7_before
  FROM a WINDOW p AS (PARTITION BY host, browser_type))
SELECT *, round(hits / month_total, 6) AS month_share, round(hits / total, 6) AS total_share FROM w WHERE total > 10""",
    "traffic_windows_by_days": f"""WITH {_EB}, a AS (SELECT host, browser_type, CAST(ts AS DATE) AS day, count(*) AS hits FROM eb GROUP BY ALL HAVING count(*) > 1)
SELECT *, round(hits / month_total, 6) AS month_share, round(hits / total, 6) AS total_share FROM (SELECT *, CAST(date_trunc('month', day) AS DATE) AS month_start,
  CAST((SELECT sum(hits) FROM a x WHERE x.host = a.host AND x.browser_type = a.browser_type AND date_trunc('month', x.day) = date_trunc('month', a.day)) AS BIGINT) AS month_total,
  CAST((SELECT sum(hits) FROM a x WHERE x.host = a.host AND x.browser_type = a.browser_type) AS BIGINT) AS total,
  CAST((SELECT sum(hits) FROM a x WHERE x.host = a.host AND x.browser_type = a.browser_type AND x.day <= a.day) AS BIGINT) AS running,
  CAST((SELECT sum(hits) FROM a x WHERE x.host = a.host AND x.browser_type = a.browser_type AND x.day BETWEEN a.day - 6 AND a.day) AS BIGINT) AS rolling_7,
  CAST((SELECT sum(hits) FROM a x WHERE x.host = a.host AND x.browser_type = a.browser_type AND x.day BETWEEN a.day - 13 AND a.day - 7) AS BIGINT) AS rolling_7_before FROM a)""",
    "game_cube": f"WITH {_CUBE} SELECT * FROM cu",
    "game_leaders": f"""WITH {_CUBE}, tg AS (SELECT team, game, sum(plus_minus) > 0 AS win FROM gr GROUP BY ALL)
(SELECT 'points for one team' AS question, player || '/' || team AS who, points AS n FROM cu WHERE level = 'player__team' ORDER BY points DESC, player, team LIMIT 1)
UNION ALL (SELECT 'points', player, points FROM cu WHERE level = 'player' ORDER BY points DESC, player LIMIT 1)
UNION ALL (SELECT 'wins', CAST(team AS VARCHAR), count(*) FROM tg WHERE win GROUP BY team ORDER BY count(*) DESC, team LIMIT 1)""",
    "best_stretch": f"WITH {_TEAMS}, r AS (SELECT team, sum(CAST(win AS INT)) OVER (PARTITION BY team ORDER BY game ROWS 89 PRECEDING) AS w FROM tg) SELECT team, CAST(max(w) AS BIGINT) AS best_wins FROM r GROUP BY 1",
    "longest_streak": """WITH x AS (SELECT o_custkey, o_totalprice > 200000 AS hit, row_number() OVER w - row_number() OVER (PARTITION BY o_custkey, o_totalprice > 200000 ORDER BY o_orderdate, o_orderkey) AS island FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
g AS (SELECT o_custkey, count(*) FILTER (hit) AS n FROM x GROUP BY o_custkey, hit, island) SELECT o_custkey, max(n) AS longest_streak FROM g GROUP BY 1""",
    "vertices_suppliers": "SELECT s_suppkey AS identifier, 'team' AS type, min(s_name) AS name, CAST(min(s_nationkey) AS VARCHAR) AS nation FROM supplier GROUP BY 1",
    "edges_plays_in": f"WITH {_EDGES} SELECT player AS subject_id, 'player' AS subject_type, game AS object_id, 'game' AS object_type, 'plays_in' AS edge_type, CAST(team AS VARCHAR) AS team, CAST(points AS VARCHAR) AS points FROM ed",
    "edges_pairs": f"""WITH {_GAMES} SELECT a.player AS subject_id, b.player AS object_id, CASE WHEN a.team = b.team THEN 'shares_team' ELSE 'plays_against' END AS edge_type, count(*) AS games, CAST(sum(a.points) AS BIGINT) AS subject_points, CAST(sum(b.points) AS BIGINT) AS object_points
FROM gr a JOIN gr b ON a.game = b.game AND a.player > b.player GROUP BY ALL""",
    "graph_points_per_game": f"WITH {_GAMES}, v AS (SELECT player, sum(points) / count(*) AS r FROM gr GROUP BY 1) SELECT gr.player AS subject_id, game AS object_id, round(r, 4) AS ratio FROM gr JOIN v ON v.player = gr.player",
    "avg_per_player": "SELECT l_partkey, round(avg(l_quantity), 4) AS average FROM lineitem GROUP BY 1",
    "top_playlist": "SELECT o_orderpriority, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "top_map": f"WITH {_MAPS} SELECT n_name, count(DISTINCT o_orderkey) AS n FROM mp GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "top_map_for_medal": f"WITH {_MAPS} SELECT n_name, count(DISTINCT o_orderkey) AS n FROM mp WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "user_device_rollup": f"WITH {_E}, p AS (SELECT user_id, device_id, count(*) AS n FROM e WHERE user_id IS NOT NULL AND device_id IS NOT NULL GROUP BY ALL) SELECT p.user_id, max(n) AS most_events, count(*) AS devices, CAST(sum(n) AS BIGINT) AS events, CAST((SELECT count(DISTINCT host) FROM e WHERE e.user_id = p.user_id AND device_id IS NOT NULL) AS INT) AS hosts FROM p GROUP BY 1",
    "device_users": f"WITH {_E} SELECT device_id, count(DISTINCT user_id) AS users FROM e WHERE device_id IS NOT NULL AND user_id IS NOT NULL GROUP BY 1",
    "events_with_device": f"WITH {_E} SELECT event_id, device_id, CASE WHEN host = 'error' THEN 'unknown' ELSE host END AS referrer, upper(p_brand) AS browser_type, p_type AS os_type FROM e JOIN part ON p_partkey = device_id",
    "upsert_latest": """WITH a AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS y FROM orders), o AS (SELECT o_custkey, max(y) AS year, count(*) AS orders FROM a WHERE y < 2000 GROUP BY 1), n AS (SELECT o_custkey, max(y) AS year, count(*) AS orders FROM a WHERE y = 2000 GROUP BY 1)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM n)""",
    "upsert_on_disk": """WITH o AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS year, o_orderkey, o_totalprice FROM orders),
a AS (SELECT o_custkey, year, count(*) AS orders, max(o_orderkey) AS last_order, 1 AS load FROM o WHERE o_totalprice < 150000 GROUP BY ALL),
b AS (SELECT o_custkey, year, count(*) AS orders, max(o_orderkey) AS last_order, 2 AS load FROM o WHERE year IN (1996, 1997) AND o_orderkey % 3 > 0 GROUP BY ALL)
SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.o_custkey = a.o_custkey AND b.year = a.year)""",
    "bucketed_join": "SELECT o_orderpriority, count(*) AS rows, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "bucketed_star": """WITH m AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT n_name, o_orderpriority, l.l_orderkey IN (FROM m) AS returned, count(*) AS rows, CAST(sum(l_quantity) AS BIGINT) AS quantity
FROM lineitem l JOIN orders ON l.l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL""",
    "broadcast_join": "SELECT s_nationkey, count(*) AS rows FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1",
    "classify_referrer": "SELECT page_id, CASE WHEN url LIKE '%//blog.%' THEN 'Blog' WHEN url LIKE 'https://m.%' THEN 'Mobile' WHEN url LIKE '%.org%' THEN 'Organisation' ELSE url END AS referrer FROM pages",
    "geo_enrich": """SELECT event_id, user_id, coalesce(CASE WHEN n_name IS NOT NULL THEN '{"country":"' || n_name || '","state":"' || n_regionkey || '"}' END, '{}') AS geodata FROM events LEFT JOIN nation ON user_id BETWEEN n_nationkey * 6 AND n_nationkey * 6 + 4""",
    "geo_wide_ranges": f"""WITH {_PLACES},
n AS (SELECT event_id, CASE WHEN event_id % 11 > 0 THEN CASE WHEN event_id % 3 = 0 THEN event_id * 40001 ELSE user_id END END AS number FROM events),
h AS (SELECT event_id, min_by(place, (lo, hi, place)) AS place FROM n JOIN r ON number BETWEEN lo AND hi GROUP BY 1)
SELECT event_id, number, coalesce(place, '{{}}') AS geodata FROM n LEFT JOIN h USING (event_id)""",
    "dedupe_events": "SELECT DISTINCT user_id, event_type AS host, CAST(ts AS DATE) AS day FROM events",
    "dedupe_first": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1",
    "top_n": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "layout_sorted": "SELECT CAST(l_shipdate AS DATE) AS l_shipdate, l_orderkey, l_linenumber, l_partkey FROM lineitem",
    "stream_tumbling_host": f"WITH {_IN_TIME} {_windows('host')}",
    "stream_two_sinks": f"WITH {_IN_TIME} {_windows('host', 'NULL AS referrer')} UNION ALL {_windows('host', 'referrer')}",
    "stream_sessions": f"""WITH {_IN_TIME}, {_sessions("it")}
SELECT * FROM ss WHERE session_end <= {_CLOSED} 5 SECOND""",
    "stream_session_avg": f"""WITH {_IN_TIME}, {_sessions("it")}
SELECT host, round(avg(event_count), 6) AS average_events FROM ss WHERE session_end <= {_CLOSED} 5 SECOND GROUP BY 1""",
    "stream_geo_enrich": f"""WITH {_PLACES}, n AS (SELECT event_id, event_id * 37 % 400 AS number FROM events),
h AS (SELECT event_id, min_by(place, (lo, hi, place)) AS place FROM n JOIN r ON number BETWEEN lo AND hi GROUP BY 1)
SELECT event_id, number, coalesce(place, '{{}}') AS geodata, coalesce(place, '{{}}') AS joined FROM n LEFT JOIN h USING (event_id)""",
    "host_month_upserted": _hosts(D),
    "table_overwritten": "SELECT c_custkey, upper(c_name) AS c_name, CAST(c_nationkey AS BIGINT) AS nation FROM customer WHERE c_nationkey < 10",
    "csv_orders": """SELECT o_orderpriority, count(*) AS orders, CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) AS last, CAST(sum(o_custkey) AS BIGINT) AS customers, read
FROM orders, (VALUES ('typed'), ('strings')) v(read) GROUP BY ALL""",
    "period_overwritten": """SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INT) AS year, CASE WHEN year(o_orderdate) IN (1996, 2001) THEN 2 ELSE 1 END AS load
FROM orders WHERE year(o_orderdate) NOT IN (1996, 2001) OR o_orderkey % 2 = 0""",
    "stream_parse": "SELECT event_type AS host, CAST(user_id AS VARCHAR) AS ip, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS event_time, true AS parsed FROM events",
    "kafka_rows": """SELECT '{"host":"' || event_type || '","day":"' || strftime(ts, '%Y-%m-%d') || '","num_hits":' || count(*) || '}' AS value FROM events GROUP BY event_type, strftime(ts, '%Y-%m-%d')""",
    "tumbling_host": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS event_hour, event_type AS host, count(*) AS num_hits FROM events GROUP BY ALL",
    "tumbling_host_referrer": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS event_hour, event_type AS host, 'r' || (user_id % 3) AS referrer, count(*) AS num_hits FROM events GROUP BY ALL",
    "sessions": f"WITH {_SESSIONS} SELECT * FROM ss",
    "session_avg_by_host": f"WITH {_SESSIONS} SELECT host, round(avg(event_count), 6) AS average_events FROM ss GROUP BY 1",
}

ORACLE_SQL["geo_index"] = ORACLE_SQL["geo_wide_ranges"]
ORACLE_SQL["datelist_map_merged"] = ORACLE_SQL["datelist_device_map"]
