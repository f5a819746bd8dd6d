"""Rendition ladders: which rungs a source gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import HIGHEST_LEVEL, LEVELS, MAX_RUNGS, PROFILES


def even(n: Column) -> Column:
    """The nearest even number from 2 on, halves up, of a non-negative integer."""
    return F.greatest(F.lit(2), F.floor((n + 1) / 2) * 2).cast("long")


def level_for_frame(width: Column, height: Column, fps: Column | int = 30) -> Column:
    """The first level whose limits hold the frame and its rate."""
    blocks = F.floor((width + 15) / 16) * F.floor((height + 15) / 16)
    rate = blocks * fps
    found = F.lit(HIGHEST_LEVEL)
    for level, most, most_rate in reversed(LEVELS):
        found = F.when((blocks <= most) & (rate <= most_rate), level).otherwise(found)
    return found.cast("long")


def plan(sources: DataFrame, ladders: DataFrame, upscale: bool = False) -> DataFrame:
    """source, ladder, width, height and bitrate of each rendition.

    Ladders are a table of a few rungs (an error beyond MAX_RUNGS), which goes into every row as an array; the rest is
    aggregation by (source, ladder), which map-side combining serves.
    """
    rungs = [r.asDict() for r in ladders.select("ladder", "ord", "height", "bitrate").limit(MAX_RUNGS + 1).collect()]
    if len(rungs) > MAX_RUNGS:
        raise ValueError(f"ladders of more than {MAX_RUNGS} rungs")
    listed = F.array(*(F.struct(F.lit(r["ladder"]).alias("ladder"), *(F.lit(r[c]).cast("long").alias(c) for c in ("ord", "height", "bitrate"))) for r in rungs))
    pairs = sources.select("source", F.col("width").alias("sw"), F.col("height").alias("sh"), F.inline(listed))
    fits = F.lit(True) if upscale else F.col("height") <= F.col("sh")
    facts = pairs.groupBy("source", "ladder", "sw", "sh").agg(
        F.max(F.when(fits, F.col("height"))).alias("tallest"),
        F.min("bitrate").alias("least"),
        F.min_by(F.when(~fits, F.col("bitrate")), F.when(~fits, F.struct("height", "ord"))).alias("promoted"),
        F.max(F.when(fits, F.lit(0)).otherwise(1)).alias("dropped"),
        F.collect_list(F.when(fits, F.struct("ord", "height", "bitrate"))).alias("rungs"),
    )
    one = lambda o, h, b: F.struct(F.lit(o).cast("long").alias("ord"), h.alias("height"), b.alias("bitrate"))
    top = (F.col("dropped") == 1) & F.col("tallest").isNotNull() & (even(F.col("tallest")) < even(F.col("sh")))
    rungs = F.when(F.col("tallest").isNull(), F.array(one(0, F.col("sh"), F.col("least")))).otherwise(
        F.when(top, F.concat(F.array(one(-1, F.col("sh"), F.col("promoted"))), F.col("rungs"))).otherwise(F.col("rungs"))
    )
    exploded = facts.select("source", "ladder", "sw", "sh", F.inline(rungs))
    best = exploded.withColumn("even_height", even(F.col("height"))).groupBy("source", "ladder", "sw", "sh", "even_height").agg(F.max_by("bitrate", F.struct("bitrate", -F.col("ord"))).alias("bitrate"))
    scaled = F.floor((F.col("sw") * F.col("even_height") * 2 + F.col("sh")) / (F.col("sh") * 2))
    return best.select("source", "ladder", even(scaled).alias("width"), F.col("even_height").alias("height"), "bitrate")


def encoder_codecs(width: Column, height: Column, preferred: Column, fps: Column | int = 30) -> Column:
    """The codec strings to ask an encoder for, in order: of the preferred profile, then of the others."""
    level = F.lower(F.lpad(F.hex(level_for_frame(width, height, fps)), 2, "0"))
    wanted = F.element_at(F.create_map(*(x for name, code in PROFILES.items() for x in (F.lit(name), F.lit(code)))), preferred)
    order = F.concat(F.array(wanted), F.filter(F.array(*map(F.lit, PROFILES.values())), lambda p: p != wanted))
    return F.transform(order, lambda p: F.concat(F.lit("avc1."), p, level))


def ladder_key(ladders: DataFrame) -> DataFrame:
    """ladder and its rungs as text, in order; null without rungs."""
    listed = ladders.groupBy("ladder").agg(F.array_sort(F.collect_list(F.struct("ord", "height", "bitrate"))).alias("rungs"))
    text = F.array_join(F.transform("rungs", lambda r: F.concat(r["height"].cast("string"), F.lit("@"), r["bitrate"].cast("string"))), ",")
    return listed.select("ladder", F.nullif(text, F.lit("")).alias("key"))


def fit(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Width and height within most columns, never enlarged."""
    scaled = F.greatest(F.lit(1), F.floor((height * (2 * most) + width) / (width * 2))).cast("long")
    return F.when(width <= most, width).otherwise(F.lit(most)).cast("long"), F.when(width <= most, height).otherwise(scaled).cast("long")


def sprite(df: DataFrame, count: str, duration: str, *keep: str) -> DataFrame:
    """keep, and for each still its number, tile column and row, and the time of its slice's middle (thousandths)."""
    across = F.ceil(F.sqrt(count)).cast("long")
    each = df.select(*keep, count, duration, across.alias("columns"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)).alias("i"))
    return each.select(
        *keep, "i", (F.col("i") % F.col("columns")).alias("tile_x"), F.floor(F.col("i") / F.col("columns")).cast("long").alias("tile_y"),
        F.floor(F.col(duration) * (2 * F.col("i") + 1) / (2 * F.col(count))).cast("long").alias("target"),
    )

