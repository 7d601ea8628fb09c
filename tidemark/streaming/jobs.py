"""Parsing, tumbling and session windows, and queries that keep checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Web events as JSON text.
WEB_EVENT = "url string, referrer string, user_agent string, host string, ip string, headers string, event_time string"
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSX"
#: State of windows and sessions lies in RocksDB, off the heap and on disk beyond its memory; a checkpoint writes what has
#: changed, not the whole state.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def parse_events(raw: DataFrame, value: str = "value", schema: str = WEB_EVENT) -> DataFrame:
    """Fields of JSON values and event_timestamp from their ISO text; what can't be parsed is null."""
    return raw.select(F.from_json(F.col(value).cast("string"), schema).alias("e")).select("e.*").withColumn("event_timestamp", F.try_to_timestamp("event_time", F.lit(ISO)))


def watermarked(events: DataFrame, time: str, delay: str) -> DataFrame:
    """Time as a timestamp with a watermark; a batch is only cast."""
    out = events.withColumn(time, F.col(time).cast("timestamp"))
    return out.withWatermark(time, delay) if out.isStreaming else out


def tumbling_counts(events: DataFrame, keys: Sequence[str], time: str, width: str = "5 minutes", delay: str = "15 seconds") -> DataFrame:
    """Events of each key and window, by the window's start."""
    w = watermarked(events, time, delay).groupBy(F.window(time, width).alias("w"), *keys)
    return w.agg(F.count("*").alias("num_hits")).select(F.col("w.start").alias("event_hour"), *keys, "num_hits")


def sessions(events: DataFrame, keys: Sequence[str], time: str, gap: str = "5 minutes", delay: str = "5 seconds") -> DataFrame:
    """Sessions of each key: they end one gap after the last event; events exactly a gap apart share one."""
    w = watermarked(events, time, delay).groupBy(F.session_window(time, gap).alias("w"), *keys)
    out = w.agg(F.count("*").alias("event_count"))
    return out.select(
        *keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "event_count", (F.unix_timestamp("w.end") - F.unix_timestamp("w.start")).alias("session_duration")
    )


def average_session(sessions_: DataFrame, by: str, pattern: str | None = None, names: Sequence[str] = ()) -> DataFrame:
    """Mean events per session (a batch over stored sessions), of all hosts, a family or named ones."""
    rows = sessions_ if pattern is None else sessions_.where(F.col(by).like(pattern))
    rows = rows.where(F.col(by).isin(*names)) if names else rows
    return rows.groupBy(by).agg(F.avg("event_count").alias("average_events"))


@contextmanager
def configured(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """The session with these settings, and then as it was. A streaming query keeps those it was started with."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start(df: DataFrame, sink, checkpoint: str, once: bool = True, interval: str = "10 seconds", mode: str = "append", state: Mapping[str, str] = STATE) -> StreamingQuery:
    """Starts a query with its own checkpoint. sink: a folder for Parquet, or a function for foreachBatch. A
    checkpoint goes on with the state store that it was begun with."""
    out = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    out = out.trigger(availableNow=True) if once else out.trigger(processingTime=interval)
    with configured(df.sparkSession, state):
        return out.foreachBatch(sink).start() if callable(sink) else out.format("parquet").option("path", sink).start()


def replay(arrivals: Iterable[DataFrame], source: str, queries: Mapping[str, tuple[Callable[[DataFrame], DataFrame], object]], checkpoints: str, state: Mapping[str, str] = STATE) -> list[dict]:
    """Lands batches of rows in the folder source, one after the other, and after each starts every query
    anew from its own checkpoint below the folder checkpoints, until it has read all there is. queries: by name, what to make of the stream and the sink.
    The metrics of each run are returned: see progress()."""
    out = []
    for rows in arrivals:
        rows.write.mode("append").parquet(source)
        read = rows.sparkSession.readStream.schema(rows.schema)
        running = {name: start(make(read.parquet(source)), sink, f"{checkpoints}/{name}", state=state) for name, (make, sink) in queries.items()}
        for name, query in running.items():
            query.awaitTermination()
            out.append({"query": name} | progress(query))
    return out


def progress(query: StreamingQuery) -> dict:
    """Rows read, rows behind the watermark that were dropped, rows and bytes of state, and the store's own metrics,
    of the batches that the query remembers."""
    batches = query.recentProgress
    last = [o for p in batches[-1:] for o in p.stateOperators]
    return {
        "batches": len(batches),
        "rows": sum(p.numInputRows for p in batches),
        "dropped": sum(o.numRowsDroppedByWatermark for p in batches for o in p.stateOperators),
        "state_rows": sum(o.numRowsTotal for o in last),
        "state_bytes": sum(o.memoryUsedBytes for o in last),
        "store": {k: v for o in last for k, v in dict(o.customMetrics).items()},
    }
