"""Tables, JDBC and a stream enriched from a table."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import enrich
from tidemark.sources import readers, writers
from tidemark.streaming import jobs

SCHEMA = "k int, p string, v double"


@pytest.fixture
def name(spark, tmp_path):
    n = "t_" + tmp_path.name.replace("-", "_")
    yield n
    spark.sql(f"DROP TABLE IF EXISTS {n}")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_create_overwrite_and_read_a_table(spark, tmp_path, name):
    first = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], SCHEMA)
    writers.create_table(first, name, ["p"], str(tmp_path / "t"))
    assert rows(readers.read_table(spark, name).select("k", "p", "v")) == rows(first)
    assert spark.catalog.listColumns(name)[-1].isPartition
    again = spark.createDataFrame([("c", 7.0, 3)], "p string, v double, k int")  # other order of columns
    writers.insert_overwrite(again, name)
    assert rows(readers.read_table(spark, name).select("k", "p", "v")) == [(3, "c", 7.0)]
    writers.insert_overwrite(again, name)  # a second run changes nothing
    assert readers.read_table(spark, name).count() == 1
    writers.create_table(first, name, ["p"], str(tmp_path / "t"))
    assert rows(readers.read_table(spark, name).select("k", "p", "v")) == rows(first)


def test_staged_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = writers.staged(spark.range(100).mapInPandas(count, "id long"), str(tmp_path / "s"))
    assert df.join(df.withColumnRenamed("id", "j"), F.col("id") == F.col("j")).count() == 100 and df.count() == 100
    assert seen.value == 100


def test_upsert_leaves_nothing_behind(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.write_period(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], SCHEMA), path, "p")
    writers.upsert_periods(spark.createDataFrame([(1, "a", 9.0), (5, "a", 5.0)], SCHEMA), path, ["k"], "p")
    assert rows(spark.read.schema(SCHEMA).parquet(path).select("k", "p", "v")) == [(1, "a", 9.0), (2, "b", 2.0), (5, "a", 5.0)]
    assert [x.name for x in tmp_path.iterdir()] == ["t"]


def broken(df):
    """df, with an error once its first partition is written."""

    def fail(batches):
        yield from batches
        raise OSError("the executor is lost")

    return df.mapInPandas(fail, df.schema)


def test_upsert_is_visible_whole_or_not_at_all(spark, tmp_path):
    """A first load, a broken run, the run again, and a second writer who comes too late; a null period and a null key."""
    path = str(tmp_path / "t")
    read = lambda: rows(writers.read_version(spark, path, SCHEMA))
    first = [(1, "a", 1.0), (2, "b", 2.0), (3, None, 3.0), (None, "b", 4.0)]
    assert read() == []
    writers.upsert_version(spark.createDataFrame(first, SCHEMA), path, ["k"], "p")
    assert read() == rows(spark.createDataFrame(first, SCHEMA))
    change = spark.createDataFrame([(1, "a", 9.0), (5, "a", 5.0), (3, None, 7.0), (None, "b", 8.0)], SCHEMA)
    with pytest.raises(Exception, match="executor is lost"):
        writers.upsert_version(broken(change), path, ["k"], "p")
    assert read() == rows(spark.createDataFrame(first, SCHEMA))
    writers.upsert_version(change, path, ["k"], "p")
    after = sorted([(1, "a", 9.0), (5, "a", 5.0), (2, "b", 2.0), (3, None, 7.0), (None, "b", 4.0), (None, "b", 8.0)], key=repr)
    assert read() == after
    old = writers.manifest(spark, path)
    held = writers.read_version(spark, path, SCHEMA)
    writers.upsert_version(spark.createDataFrame([(6, "c", 6.0)], SCHEMA), path, ["k"], "p")
    assert {p: f for p, f in writers.manifest(spark, path).items() if p != "c"} == old and rows(held) == after  # other periods are not written again
    gone = writers.vacuum(spark, path)
    assert sum("_versions" in g for g in gone) == 2 and read() == sorted([*after, (6, "c", 6.0)], key=repr)
    assert {x.name for x in (tmp_path / "t").iterdir()} == {"_versions", *writers.manifest(spark, path).values()}


def test_a_slower_writer_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    writers.upsert_version(spark.createDataFrame([(1, "a", 1.0)], SCHEMA), path, ["k"], "p")
    numbers = writers._numbers(spark, path)
    writers.publish(spark, path, writers.manifest(spark, path))
    monkeypatch.setattr(writers, "_numbers", lambda *a: numbers)  # what a writer saw that began before
    with pytest.raises(RuntimeError, match="another writer"):
        writers.publish(spark, path, {})
    monkeypatch.undo()
    assert rows(writers.read_version(spark, path, SCHEMA)) == [(1, "a", 1.0)] and not [x for x in (tmp_path / "t").iterdir() if "draft" in x.name]


def test_jdbc_there_and_back(spark, tmp_path):
    """With the database that comes with Spark: batches, one of them again with other rows, one that breaks off before and
    one within the transaction, two streams in a table; a bounded read takes it in parts."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    options = readers.jdbc_options(url, "games", driver="org.apache.derby.jdbc.EmbeddedDriver")
    sink, other = writers.jdbc_batch(options), writers.jdbc_batch(options, "other")
    df = spark.createDataFrame([(i, f"g{i}", i / 2) for i in range(50)], "id int, name string, score double")
    count = lambda: {(r.stream, r.batch_id): r.n for r in readers.read_jdbc(spark, options, "id", 0, 50, 4).groupBy("stream", "batch_id").agg(F.count("*").alias("n")).collect()}
    sink(df.where("id < 20"), 0)
    sink(df.where("id >= 20"), 1)
    sink(df.where("id >= 20"), 1)
    other(df.where("id < 3"), 1)
    assert count() == {("", 0): 20, ("", 1): 30, ("other", 1): 3}
    for rest in (broken(df), df.withColumn("more", F.lit(1))):  # staged in part only; a column that the target has not
        with pytest.raises(Exception):  # noqa: B017
            sink(rest, 1)
        assert count() == {("", 0): 20, ("", 1): 30, ("other", 1): 3}
    sink(df.where("id >= 45"), 1)
    assert count() == {("", 0): 20, ("", 1): 5, ("other", 1): 3}
    got = readers.read_jdbc(spark, options, "id", 0, 50, 4)
    assert got.rdd.getNumPartitions() == 4 and rows(got.where("stream = ''").select("id", "name", "score")) == rows(df.where("id < 20 OR id >= 45"))


def test_a_stream_ends_in_a_jdbc_table_once(spark, tmp_path):
    """The checkpoint is lost after the commit of a batch: it comes again and changes nothing."""
    options = readers.jdbc_options(f"jdbc:derby:{tmp_path}/db;create=true", "hits", driver="org.apache.derby.jdbc.EmbeddedDriver")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(str(tmp_path / "in"))
    for check in ("c1", "c2"):
        stream = spark.readStream.schema("k int, v string").parquet(str(tmp_path / "in"))
        jobs.start(stream, writers.jdbc_batch(options), str(tmp_path / check)).awaitTermination()
    assert rows(readers.read_jdbc(spark, options, "k", 0, 5, 2).select("k", "v", "batch_id")) == [(1, "a", 0), (2, "b", 0)]


def test_a_stream_is_enriched_from_a_table(spark, tmp_path):
    """Stream and static ranges: each event gets its place, an unknown address {}."""
    ranges = spark.createDataFrame([("1.2.0.0", "1.2.255.255", "AA"), ("10.0.0.0", "10.0.0.9", "BB")], "a string, b string, country string")
    ranges = ranges.select(enrich.ip_number(F.col("a")).alias("lo"), enrich.ip_number(F.col("b")).alias("hi"), "country")
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    made = lambda ips: "\n".join(json.dumps({"ip": i, "host": "h", "event_time": dt.datetime(2024, 1, 1).strftime("%Y-%m-%dT%H:%M:%S.000Z")}) for i in ips) + "\n"
    want = {}
    for n, ips in enumerate((["1.2.3.4", "10.0.0.9"], ["10.0.0.10", "not one", "1.2.0.0"])):
        (source / f"f{n}.txt").write_text(made(ips))
        events = jobs.parse_events(spark.readStream.text(str(source))).withColumn("number", enrich.ip_number(F.col("ip")))
        wide = enrich.range_lookup(events, ranges, "number", "lo", "hi", ["country"])
        assert wide.isStreaming
        jobs.start(wide.select("ip", "geodata"), out, str(tmp_path / "check")).awaitTermination()
        want |= {i: {"1.2.3.4": '{"country":"AA"}', "1.2.0.0": '{"country":"AA"}', "10.0.0.9": '{"country":"BB"}'}.get(i, "{}") for i in ips}
        assert {r.ip: r.geodata for r in spark.read.parquet(out).collect()} == want
