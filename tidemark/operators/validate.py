"""Validation of configurations and samples as columns, limits that fail, and jobs whose errors are rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import ERRORS, MAX_CODEC_CONFIG, MAX_DIMENSION, MAX_PENDING, MAX_SAMPLE_BYTES, MAX_SAMPLE_ENTRY


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def config_error(timescale: Column, width: Column, height: Column, config: Column, target_s: Column) -> Column:
    """What is wrong with a segmenter's settings; null if nothing is."""
    return (
        F.when(timescale <= 0, "timescale")
        .when(~width.between(1, MAX_DIMENSION) | ~height.between(1, MAX_DIMENSION), "dimensions")
        .when(~F.octet_length(config).between(4, MAX_CODEC_CONFIG), "codec_config")
        .when(~_finite(target_s) | (target_s <= 0), "target")
    )


def sample_error(size: Column, pending: Column) -> Column:
    return F.when(size <= 0, "empty").when(size > MAX_SAMPLE_BYTES, "too_large").when(pending >= MAX_PENDING, "too_many")


def restore_error(duration_s: Column, samples_seen: Column) -> Column:
    return F.when(samples_seen > 0, "after_samples").when(~_finite(duration_s) | (duration_s < 0), "duration")


def audio_error(timescale: Column, entry_bytes: Column, started: Column) -> Column:
    """What is wrong with setting an audio track; null if nothing is."""
    return F.when(started, "audio_after_start").when(timescale <= 0, "timescale").when(~entry_bytes.between(8, MAX_SAMPLE_ENTRY) | entry_bytes.isNull(), "audio_config")


def audio_sample_error(has_audio: Column, size: Column, pending: Column) -> Column:
    return F.when(~has_audio, "no_audio").otherwise(sample_error(size, pending))


def error_text(error: Column) -> Column:
    """What an error of these functions says."""
    return F.try_element_at(F.create_map(*(x for code, text in ERRORS.items() for x in (F.lit(code), F.lit(text)))), error)


def support(spark: SparkSession) -> DataFrame:
    """What this engine can do: feature, available, and the reason where it can't."""
    rows = [
        ("remux", True, None), ("resume", True, None), ("seamless_resume", True, None),
        ("transcode", False, "decoding and encoding need a codec, which this engine doesn't have"),
    ]
    return spark.createDataFrame(rows, "feature string, available boolean, reason string")


def clean_duration(seconds: Column) -> Column:
    return F.when((seconds > 0) & _finite(seconds), seconds).otherwise(0.0)


def at_most(df: DataFrame, key: str, most: int) -> DataFrame:
    """df, which fails when read if a key has more than most rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("__n"))
    checked = counts.withColumn("__ok", F.when(F.col("__n") > most, F.raise_error(F.concat(F.lit(f"more than {most} rows of "), F.col(key).cast("string")))).otherwise(F.lit(True)))
    return df.join(checked.filter("__ok").select(key), key)


def run_jobs(jobs: DataFrame, work: Callable[[dict], object], key: str = "job_id") -> DataFrame:
    """key, status (done or failed) and error of work on each job's row; a failing job doesn't stop the others."""
    kind = jobs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for job in frame.to_dict("records"):
                try:
                    work(job)
                    rows.append((job[key], "done", None))
                except Exception as error:  # noqa: BLE001
                    rows.append((job[key], "failed", f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=[key, "status", "error"])

    return jobs.mapInPandas(run, f"`{key}` {kind}, status string, error string")


def same_ladder(job: Column, wanted: Column) -> Column:
    """If a stored job's ladder (array of height and bitrate) is the one asked for."""
    key = lambda rungs: F.array_join(F.transform(rungs, lambda r: F.concat_ws("@", r["height"], r["bitrate"])), ",")
    return key(job) == key(wanted)
