"""Unbounded sources as streaming DataFrames."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def kafka_ready(spark: SparkSession) -> None:
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider", False, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    except Exception as e:
        raise RuntimeError("Kafka needs Spark's connector on the class path: start with --packages org.apache.spark:spark-sql-kafka-0-10_2.13:<Spark's version>") from e


def message(text: Column) -> Column:
    """Each message as a VARIANT named ``value``; one that is no JSON is an object with ``_raw``."""
    parsed = F.try_parse_json(text)
    return F.coalesce(parsed, F.parse_json(F.to_json(F.struct(text.alias("_raw"))))).alias("value")


def _typed(df: DataFrame, schema: str | None) -> DataFrame:
    if not schema:
        return df.select(message(F.col("value")))
    parsed = F.from_json("value", f"{schema}, _raw string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_raw"})
    return df.where(F.trim("value") != "").select(parsed.alias("r")).select("r.*")


def kafka(context: Any, args: Mapping[str, Any]) -> DataFrame:
    """The topic from its end on. ``schema`` (DDL) types the rows; otherwise each is one VARIANT."""
    if not args.get("groupId"):
        raise ValueError("a kafka source needs a groupId")
    kafka_ready(context.spark)
    read = context.spark.readStream.format("kafka").option("kafka.bootstrap.servers", args["bootstrap"]).option("subscribe", args["topic"]).option("kafka.group.id", args["groupId"]).option("startingOffsets", "latest")
    return _typed(read.load().select(F.col("value").cast("string").alias("value")), args.get("schema"))


def nats(context: Any, args: Mapping[str, Any]) -> DataFrame:
    from spillway.streaming.nats import Nats

    context.spark.dataSource.register(Nats)
    servers = args.get("servers")
    servers = ",".join(servers) if isinstance(servers, (list, tuple)) else servers
    read = context.spark.readStream.format("spillway-nats").option("subject", args["subject"])
    return _typed((read.option("servers", servers) if servers else read).load(), args.get("schema"))
