"""Written tables that cut lineage, and connected components over link tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where that is unset (tests on one
    machine) a temporary folder is made and set for the session; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """Bounds what a Python worker gets at once by bytes, as rows may hold very long texts: lowers the
    session's spark.sql.execution.arrow.maxBytesPerBatch where it is larger, and never raises it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key)) or 1 << 31) > size:
        spark.conf.set(key, str(size))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, row_group: int = 32 << 20, codec: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, safe when executors are lost. Row groups are
    small, as a reader may hold one whole."""
    path = new_path(df.sparkSession, name)
    df.write.option("parquet.block.size", row_group).option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Removes the files of a written table that nothing reads any more."""
    removed(spark, df.inputFiles())


def removed(spark: SparkSession, files: list[str]) -> None:
    """Removes the folders of these files."""
    for f in {x.rsplit("/", 1)[0] for x in files}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a long, b long): component is the smallest
    node that links reach. Alternating large-star and small-star rounds (Kiveris et al., 2014);
    each round is written as a table, so lineage stays one round deep.

    Self-links, repeated and null links are ignored. An empty table gives an empty result.
    """
    spark = links.sparkSession
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = written(small.where("u <> v").distinct(), "links")
        was, mark = mark, _mark(after)
        dropped(spark, edges)
        edges = after
        if mark == was:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of links: their number and two sums of hashes."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 24)), F.sum(h.bitwiseAND(0xFFFFFFF))).first())
