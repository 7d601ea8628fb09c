"""Batch and stream readers with explicit schemas."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header; the schema is given, so no pass over the file infers it."""
    return spark.read.csv(path, header=True, schema=schema)


def read_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


# The option names, the driver's class and the login module below are fixed values of Spark, the driver and the client.


def jdbc_options(url: str, table: str, user_env: str = "JDBC_USER", password_env: str = "JDBC_PASSWORD", driver: str = "org.postgresql.Driver") -> dict[str, str]:
    """Options of a JDBC table; user and password come from the environment."""
    out = {"url": url, "dbtable": table, "driver": driver}
    for option, env in (("user", user_env), ("password", password_env)):
        if env in os.environ:
            out[option] = os.environ[env]
    return out


def read_jdbc(spark: SparkSession, options: Mapping[str, str], column: str, low: int, high: int, parts: int) -> DataFrame:
    """A bounded read in parts ranges of a numeric column."""
    own = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**options, **own).load()


def kafka_options(servers: str, topic: str, group: str | None = None, key_env: str = "KAFKA_KEY", secret_env: str = "KAFKA_SECRET") -> dict[str, str]:
    """Options of a topic from the latest offsets; SASL where key and secret are in the environment."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "latest", "failOnDataLoss": "false"}
    if group:
        out["kafka.group.id"] = group
    if key_env in os.environ and secret_env in os.environ:
        login = f'org.apache.kafka.common.security.plain.PlainLoginModule required username="{os.environ[key_env]}" password="{os.environ[secret_env]}";'
        out |= {"kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": "PLAIN", "kafka.sasl.jaas.config": login}
    return out


def read_kafka(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    return spark.readStream.format("kafka").options(**options).load()
