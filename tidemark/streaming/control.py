"""Running streams: bounded pulls, progress as rows, cancellation."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pulled(spark: SparkSession, schema: StructType, path: str, files: int = 8) -> DataFrame:
    """A stream of the Parquet files of path that takes so many of them at a time, however far behind it is."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that stateful processors need, while a stream is started."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def run_through(stream: DataFrame, out: str, state: str, limit: int = 600) -> StreamingQuery:
    """Everything that is there, in pulls, to Parquet files of out; a run that was stopped goes on from its checkpoint in state."""
    with keyed_state(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    if not query.awaitTermination(limit):
        query.stop()
        raise TimeoutError(f"the stream did not end in {limit} s")
    return query


def progress_rows(query: StreamingQuery) -> DataFrame:
    """batch, rows in, and phase of each progress report that a stream still has."""
    from pyspark.sql import SparkSession as Session

    rows = [(int(p["batchId"]), int(p["numInputRows"]), "done" if not query.isActive else "running") for p in query.recentProgress]
    return Session.active().createDataFrame(rows, "batch long, rows long, phase string")


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs begun inside can be ended from another thread by cancel(spark, tag)."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)
