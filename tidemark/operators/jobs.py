"""The job store: keyed upserts, conditional updates, cascades, resumption and reports over tables of jobs and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(store: DataFrame, changes: DataFrame, *keys: str, version: str = "updated_at") -> DataFrame:
    """The latest version of each key, by aggregation: a row is combined map-side and no key is sorted."""
    both = store.unionByName(changes)
    rest = [c for c in both.columns if c not in keys]
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("__row"))
    return latest.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest)).select(both.columns)


HOUR = 3_600_000_000


def resumable(jobs: DataFrame) -> DataFrame:
    """Interrupted jobs with their rank, newest first.

    Ranks are counted within each hour and go on from the jobs of later hours. Only the hours' counts are
    ordered in one place, and there are as many as the time that jobs span has hours.
    """
    open_ = jobs.filter(F.col("status") == "processing").select("job_id", "updated_at", F.floor(F.col("updated_at") / HOUR).alias("__hour"))
    later = Window.orderBy(F.col("__hour").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = open_.groupBy("__hour").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(later), F.lit(0))).drop("__n")
    within = Window.partitionBy("__hour").orderBy(F.col("updated_at").desc(), "job_id")
    return open_.join(before, "__hour").select("job_id", "updated_at", (F.row_number().over(within) + F.col("__before")).cast("long").alias("rank"))


def progress(items: DataFrame, key: str, done: Column) -> DataFrame:
    """key, done and total items, and the fraction done."""
    found = items.groupBy(key).agg(F.count_if(done).alias("processed"), F.count("*").alias("total"))
    return found.select(key, "processed", "total", (F.col("processed") / F.col("total")).alias("fraction"))


#: Columns of a stored job that its public snapshot leaves out.
PRIVATE = ("file", "handle", "controller")


def snapshot(jobs: DataFrame, *private: str) -> DataFrame:
    """Jobs as they are shown: without what only the queue may see."""
    return jobs.drop(*(private or PRIVATE))


def of_job(outputs: DataFrame, job: Column) -> DataFrame:
    """Outputs with the id of the job that they are of."""
    return outputs.withColumn("job_id", job)


def route(messages: DataFrame, handlers: DataFrame, key: str = "job_id") -> DataFrame:
    """Messages with the handlers of their job; a message that no job waits for is dropped."""
    return messages.join(handlers, key)


def mark_uploaded(outputs: DataFrame, names: DataFrame, *keys: str) -> DataFrame:
    """outputs with uploaded set where names has the key; unknown keys change nothing."""
    hit = names.select(*keys).distinct().withColumn("__hit", F.lit(True))
    return outputs.join(hit, list(keys), "left").withColumn("uploaded", F.col("uploaded") | F.coalesce("__hit", F.lit(False))).drop("__hit")


def cascade_delete(jobs: DataFrame, outputs: DataFrame, gone: DataFrame, key: str = "job_id") -> tuple[DataFrame, DataFrame]:
    return jobs.join(gone, key, "left_anti"), outputs.join(gone, key, "left_anti")


def truncated(*stores: DataFrame) -> tuple[DataFrame, ...]:
    """Stores without rows, to be written over the old ones."""
    return tuple(s.filter(F.lit(False)) for s in stores)


def matching(picked: DataFrame, stored: DataFrame, *identity: str) -> DataFrame:
    """Picked files that a stored job is of."""
    return picked.join(stored.select(*identity), list(identity), "left_semi")


def queue_report(jobs: DataFrame, status: str = "status", *, by: str) -> DataFrame:
    """Per owner, how many jobs ended how, and the first of each kind; no job's failure ends the batch."""
    return jobs.groupBy(by).agg(
        F.count_if(F.col(status) == "done").alias("succeeded"), F.count_if(F.col(status) == "failed").alias("failed"), F.count_if(F.col(status) == "processing").alias("open"),
        F.coalesce(F.min(F.when(F.col(status) == "failed", F.col("job_id"))), F.lit(-1)).cast("long").alias("first_failed"),
    )


def has_room(needed: Column, available: Column) -> Column:
    """If a quota holds the bytes and a fifth more; an unknown quota does."""
    return F.when(available.isNull(), True).otherwise(available >= F.ceil(needed * 6 / 5))


def pending(outputs: DataFrame) -> DataFrame:
    return outputs.filter(~F.col("uploaded"))
