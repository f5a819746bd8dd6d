"""Readings of the star-schema tables as samples, sources, jobs and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.model import LADDERS
from tidemark.session import table


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, sample_idx, us, duration (to the next sample, 0 for the last), is_sync, size."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", micros("ts").alias("us"))
    order = Window.partitionBy("track").orderBy("us", "event_id")
    return (
        events.withColumnRenamed("user_id", "track")
        .withColumn("sample_idx", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("duration", F.coalesce(F.lead("us").over(order) - F.col("us"), F.lit(0)).cast("long"))
        .withColumn("is_sync", F.col("event_type") == "view")
        .withColumn("size", F.round(F.col("value") * 100).cast("long"))
        .select("track", "sample_idx", "us", "duration", "is_sync", "size", "event_id", "event_type")
    )


def media_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, width, height (even sixteen by nine frames of 51 heights)."""
    height = F.lit(240) + F.col("p_size") * 40
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), F.expr("((240 + 40 * p_size) * 16 + 4) div 9").alias("width"), height.cast("long").alias("height"))


def ladders(spark: SparkSession) -> DataFrame:
    rows = [(name, k, h, b) for name, rungs in LADDERS.items() for k, (h, b) in enumerate(rungs)]
    return spark.createDataFrame(rows, "ladder string, ord long, height long, bitrate long")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, owner, size, priority, status, updated_at (microseconds)."""
    status = F.when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderstatus") == "F", "done").otherwise("failed")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("owner"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size"),
        F.col("o_orderpriority").alias("priority"), status.alias("status"), micros("o_orderdate").alias("updated_at"),
    )


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, n (of its outputs), bytes, uploaded."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("bytes"), (F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)) == 0).alias("uploaded")
    )
