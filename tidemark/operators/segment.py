"""Segmentation of tracks and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.names import init_name, playlist_name

from .fold import by_gap, by_island, by_keyframe, fold
from .index import SPAN
from .scan import after_previous, counted


def segment_samples(samples: DataFrame, target: int, key: str = "track", order: str = "sample_idx") -> DataFrame:
    """samples with seg_idx: target ticks at least to a segment, cut at keyframes only."""
    return fold(samples, [key], [order], ["duration", "is_sync"], "seg_idx", by_keyframe(max(target, 1), "duration", "is_sync"))


def segments(samples: DataFrame, target: int, key: str = "track") -> DataFrame:
    """key, seg_idx, first_sample, n, ticks and bytes of each segment."""
    cut = segment_samples(samples, target, key)
    return cut.groupBy(key, "seg_idx").agg(
        F.min("sample_idx").alias("first_sample"), F.count("*").alias("n"), F.sum("duration").cast("long").alias("ticks"), F.sum("size").cast("long").alias("bytes"), F.min("us").alias("start_us")
    )


def from_frames(frames: DataFrame, key: str = "track", time: str = "us") -> DataFrame:
    """Samples of frames (key, time, width, height) from any source: a frame lasts to the next one; the first frame of a key says how large all are."""
    order = Window.partitionBy(key).orderBy(time)
    size = frames.groupBy(key).agg(F.min_by(F.struct("width", "height"), time).alias("__size"))
    lasting = frames.drop("width", "height").withColumns({"sample_idx": (F.row_number().over(order) - 1).cast("long"), "duration": F.coalesce(F.lead(time).over(order) - F.col(time), F.lit(0)).cast("long")})
    return lasting.join(size, key).select(*lasting.columns, F.col("__size.width").alias("width"), F.col("__size.height").alias("height"))


def progress_of(cut: DataFrame, audio: DataFrame, prefix: Column, key: str = "track") -> DataFrame:
    """key, the index of the next segment, if it has audio, and the names of its init segment and playlist."""
    heard = audio.select(key).distinct().withColumn("__audio", F.lit(True))
    known = cut.groupBy(key).agg((F.max("seg_idx") + 1).cast("long").alias("next_segment")).join(heard, key, "left")
    return known.select(key, "next_segment", F.coalesce("__audio", F.lit(False)).alias("has_audio"), init_name(prefix).alias("init"), playlist_name(prefix).alias("playlist"))


def oldest(ready: DataFrame, key: str = "track") -> DataFrame:
    """Of the segments of each key that wait, the one to take next."""
    rest = [c for c in ready.columns if c not in (key, "seg_idx")]
    first = ready.groupBy(key).agg(F.min(F.struct("seg_idx", *rest)).alias("__s"))
    return first.select(key, "__s.*")


def with_base_times(cut: DataFrame, key: str = "track") -> DataFrame:
    """Segments with the ticks before them."""
    before = Window.partitionBy(key).orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("base", F.coalesce(F.sum("ticks").over(before), F.lit(0)).cast("long"))


def resumed_segments(samples: DataFrame, done: DataFrame, target: int, key: str = "track") -> DataFrame:
    """Segments of a run that stopped after those of done: these, and the rest cut anew and numbered on.

    A segment begins with nothing pending, so cutting the samples after the last finished one gives the same cuts.
    """
    progress = done.groupBy(key).agg(F.sum("n").cast("long").alias("__skip"), F.count("*").alias("__next"))
    rest = samples.join(progress, key, "left").filter(F.col("sample_idx") >= F.coalesce("__skip", F.lit(0)))
    cut = segments(rest.drop("__skip", "__next"), target, key)
    renumbered = cut.join(progress, key, "left").withColumn("seg_idx", F.col("seg_idx") + F.coalesce("__next", F.lit(0)))
    return done.select(cut.columns).unionByName(renumbered.select(cut.columns))


def forced_keyframes(samples: DataFrame, every: int, key: str = "track", order: str = "sample_idx") -> DataFrame:
    """The samples that begin a group of pictures: the first, and each that is `every` or more after the last one."""
    marked = fold(samples, [key], [order], ["us"], "forced", by_gap(every, "us"))
    return marked.filter(F.col("forced") == 1).drop("forced")


def read_islands(ranges: DataFrame, key: str, order: str, window: int | None = None) -> DataFrame:
    """Ranges (offset, size) with the island that one read of at most window bytes fetches."""
    if window is None:  # without a cap, gaps decide alone, and a window function does
        ended = after_previous(ranges, key, order, F.col("offset") + F.col("size"), "__ended", SPAN)
        return counted(ended, key, order, F.col("__ended") != F.col("offset"), "island", SPAN).drop("__ended")
    return fold(ranges, [key], [order], ["offset", "size"], "island", by_island(window, "offset", "size"))


def finished_by_all(progress: DataFrame, key: str, rung: str, segment: str, rungs: int) -> DataFrame:
    """For each key, the segments that all rungs have finished and no earlier one lacks."""
    done = progress.select(key, rung, segment).distinct().groupBy(key, segment).agg(F.count("*").alias("n")).filter(F.col("n") == rungs)
    order = Window.partitionBy(key).orderBy(segment)
    return done.withColumn("__n", F.row_number().over(order) - 1).filter(F.col(segment) == F.col("__n")).select(key, segment)
