"""How tables lie in files: order, buckets and size."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sorted_for_files(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ranges of by in partitions, sorted within: what files need, without a total sort."""
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> None:
    """A table whose joins on key need no exchange. Rows are dealt by key first, so each bucket is one file."""
    out = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (out.option("path", path) if path else out).saveAsTable(name)


def bucketed(spark: SparkSession, tables: dict[str, tuple[DataFrame, str]], buckets: int, folder: str) -> dict[str, DataFrame]:
    """Each table written in buckets of its key below folder, by name. Joined on their keys they need no exchange. The catalog
    is left as it was: what is returned knows its buckets and files."""
    out, run = {}, uuid.uuid4().hex
    for name, (df, key) in tables.items():
        table = f"bucketed_{run}_{name}"
        write_bucketed(df, table, key, buckets, f"{folder}/{name}")
        out[name] = spark.table(table)
        out[name].schema  # resolved while the catalog has it
        spark.sql(f"DROP TABLE {table}")  # files stay, as the table names its folder
    return out


def layout_report(spark: SparkSession, layouts: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes each layout as Parquet below folder and reports its rows, files and bytes."""
    out = None
    for name, df in layouts.items():
        path = f"{folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
        one = files.agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).select(F.lit(name).alias("layout"), "files", "bytes")
        one = one.withColumn("rows", spark.read.parquet(path).agg(F.count("*")).scalar())
        out = one if out is None else out.unionByName(one)
    return out
