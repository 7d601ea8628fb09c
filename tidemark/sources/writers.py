"""Writers that can be run again without changing the result."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_period(df: DataFrame, path: str, period: str) -> None:
    """Overwrites the period partitions that df has and leaves the others."""
    df.write.mode("overwrite").partitionBy(period).option("partitionOverwriteMode", "dynamic").parquet(path)


def insert_overwrite(df: DataFrame, name: str) -> None:
    """Overwrites an existing table's rows, by column name."""
    df.select(df.sparkSession.table(name).columns).write.mode("overwrite").insertInto(name)


def create_table(df: DataFrame, name: str, partition_by: Sequence[str] = (), path: str | None = None) -> None:
    out = df.write.mode("overwrite")
    out = out.partitionBy(*partition_by) if partition_by else out
    (out.option("path", path) if path else out).saveAsTable(name)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new, and rows of old whose key is not in new. Keys must be unique in new; null keys
    never match, so such rows are appended."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def upsert_periods(df: DataFrame, path: str, keys: Sequence[str], period: str) -> None:
    """Upserts df into a partitioned table on disk, rewriting only the periods that df touches. A run that breaks off
    can be run again: the table is as before, or its periods are as after, until all are. For a table that plain readers
    read; see upsert_version() for one whose changes are visible at once."""
    spark = df.sparkSession
    old = spark.read.schema(df.schema).parquet(path)
    touched = old.join(df.select(period).distinct(), period, "left_semi")
    merged = upsert(touched.select(df.columns), df, keys)
    folder = f"{path.rstrip('/')}__staged-{uuid.uuid4().hex}"
    write_period(staged(merged, folder), path, period)  # what is read can't be overwritten in place
    remove(spark, folder)


def upsert_version(df: DataFrame, path: str, keys: Sequence[str], period: str) -> None:
    """Upserts df into a table of versions(), rewriting only the periods that df touches, and makes all of it visible at
    once. A run that breaks off leaves the table as it was; run again it gives the same. Null keys never match."""
    spark = df.sparkSession
    before, now = manifest(spark, path), uuid.uuid4().hex
    touched = [r[0] for r in df.select(F.col(period).cast("string")).distinct().collect()]
    old = read_version(spark, path, df.schema, {p: f for p, f in before.items() if p in touched})
    merged = upsert(old, df, keys).withColumn("of_period", F.coalesce(F.concat(F.lit("p"), F.col(period).cast("string")), F.lit("none")))
    merged.write.partitionBy("of_period").parquet(f"{path}/{now}")
    publish(spark, path, before | {p: now for p in touched})


# A table of versions: each write puts whole periods into a folder of its own, and a manifest names for every period the
# folder that holds it. The manifest with the highest number counts; it appears by a rename, which happens wholly or not at all.


def manifest(spark: SparkSession, path: str) -> dict[str | None, str]:
    """The folder of each period (as text) in the last version; empty before the first."""
    numbers = _numbers(spark, path)
    rows = spark.read.schema("period string, folder string").json(_manifest(path, max(numbers))).collect() if numbers else []
    return {r.period: r.folder for r in rows}


def read_version(spark: SparkSession, path: str, schema, folders: Mapping[str | None, str] | None = None) -> DataFrame:
    """Rows of the last version, or of the given periods' folders. Files of older versions stay until vacuum(), so what
    has begun to read goes on."""
    folders = manifest(spark, path) if folders is None else folders
    out = spark.createDataFrame([], schema)
    for folder in sorted(set(folders.values())):
        # Rows whose periods a later version has written again don't count; the names of directories say which.
        own = [p for p, f in folders.items() if f == folder]
        rows = spark.read.schema(f"{_ddl(out)}, of_period string").parquet(f"{path}/{folder}")
        out = out.unionByName(rows.where(F.col("of_period").isin(["none" if p is None else f"p{p}" for p in own])).drop("of_period"))
    return out


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def publish(spark: SparkSession, path: str, folders: Mapping[str | None, str]) -> None:
    """Makes a version visible. Where another writer was faster this fails, and nothing has changed."""
    numbers = _numbers(spark, path)
    target, draft = _manifest(path, max(numbers, default=0) + 1), f"{path}/_draft-{uuid.uuid4().hex}"
    text = "".join(json.dumps({"period": p, "folder": f}) + "\n" for p, f in folders.items())
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.Path(target).getParent())
    with_ = fs.create(hadoop.Path(draft), False)
    try:
        with_.write(bytearray(text.encode()))
    finally:
        with_.close()
    if fs.exists(hadoop.Path(target)) or not fs.rename(hadoop.Path(draft), hadoop.Path(target)):
        fs.delete(hadoop.Path(draft), False)
        raise RuntimeError(f"another writer has published {target}")


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Removes folders that the last version does not name, and older manifests: what earlier versions and broken runs
    have left. Not while a writer or a reader of an older version runs."""
    used, numbers = set(manifest(spark, path).values()), _numbers(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(hadoop.Path(path))]
    gone = [n for n in names if n != "_versions" and n not in used] + [f"_versions/{n:020}.json" for n in numbers[:-1]]
    for n in gone:
        fs.delete(hadoop.Path(f"{path}/{n}"), True)
    return gone


def _manifest(path: str, number: int) -> str:
    return f"{path}/_versions/{number:020}.json"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{path}/_versions")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(x.getPath().getName()[:20]) for x in fs.listStatus(folder) if x.getPath().getName().endswith(".json")) if fs.exists(folder) else []


def staged(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df written once, to be read by several branches of a job without being computed for each."""
    folder = folder or f"{work_folder(df.sparkSession)}/staged"
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def jdbc_batch(options: Mapping[str, str], stream: str = ""):
    """For foreachBatch: a batch of a stream in a JDBC table, once however often it comes.

    Executors write the batch to a staging table of the stream. Then one transaction of the driver deletes what the target has of the
    stream and batch id, inserts the staged rows and commits, so a run that breaks off leaves the target as it was, a batch that is
    repeated replaces itself, and no reader sees a part of one. The target has two more columns, stream and batch_id (make an index on
    them), and is made by the first batch. Streams that share a target need names of their own.
    """
    stage = f"{options['dbtable']}_stage{'_' + stream if stream else ''}"
    types = ", ".join(x for x in ("stream VARCHAR(128)", options.get("createTableColumnTypes")) if x)
    made = {**options, "createTableColumnTypes": types}

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumns({"stream": F.lit(stream), "batch_id": F.lit(batch_id).cast("long")})
        rows.write.format("jdbc").options(**{**made, "dbtable": stage}).mode("overwrite").save()
        rows.limit(0).write.format("jdbc").options(**made).mode("append").save()  # makes the table where there is none
        with transaction(batch.sparkSession, options) as run:
            names = ", ".join(run.quoted(c) for c in rows.columns)
            run(f"DELETE FROM {options['dbtable']} WHERE {run.quoted('stream')} = ? AND {run.quoted('batch_id')} = ?", stream, batch_id)
            run(f"INSERT INTO {options['dbtable']} ({names}) SELECT {names} FROM {stage}")

    return write


class Statements:
    """Runs statements of one connection."""

    def __init__(self, connection):
        self.connection, self.quote = connection, connection.getMetaData().getIdentifierQuoteString().strip()

    def quoted(self, name: str) -> str:
        return f"{self.quote}{name}{self.quote}"

    def __call__(self, sql: str, *values: str | int) -> int:
        """Rows changed."""
        statement = self.connection.prepareStatement(sql)
        try:
            for i, v in enumerate(values, 1):
                statement.setString(i, v) if isinstance(v, str) else statement.setLong(i, v)
            return statement.executeUpdate()
        finally:
            statement.close()


@contextmanager
def transaction(spark: SparkSession, options: Mapping[str, str]) -> Iterator[Statements]:
    """A connection whose statements all take effect or none."""
    jvm = spark._jvm
    if options.get("driver"):
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    known = jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in options:
            known.setProperty(k, options[k])
    connection = jvm.java.sql.DriverManager.getConnection(options["url"], known)
    try:
        connection.setAutoCommit(False)
        yield Statements(connection)
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def table_batch(path: str):
    """For foreachBatch: a batch overwrites the partition of its id, so a repeated one changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_period(batch.withColumn("batch_id", F.lit(batch_id)), path, "batch_id")

    return write


def kafka_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON values for a topic."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def work_folder(spark: SparkSession) -> str:
    """A new folder for a query's own tables: below spark.checkpoint.dir, or a temporary one where that is
    unset (one machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")
