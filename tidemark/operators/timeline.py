"""Ordered merges and as-of lookups along time.

Each as-of is a union of the two sides, sorted by key and time, with the last row of the looked-up side carried along; ties are settled
by the sort key. With span, keys are cut into blocks of that much time (scan.py) and the last row of earlier blocks is carried too, so
that a key of any length is spread over tasks; without it, a key is sorted in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import BLOCK, in_blocks, ranks, with_blocks_before


def merge(first: DataFrame, second: DataFrame, time: str, key: str, *tie: str, span: int | None = None) -> DataFrame:
    """Rows of both by time, those of second before those of first at the same time, with pos from 0 within key."""
    both = first.withColumn("rank", F.lit(1)).unionByName(second.withColumn("rank", F.lit(0)))
    if span:
        return ranks(both, key, time, ["rank", *tie], "pos", span)
    order = Window.partitionBy(key).orderBy(time, "rank", *tie)
    return both.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))


def _both(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], strict: bool) -> DataFrame:
    # At equal times a row sees those with a lower rank: matches before lookups, or the other way if strict.
    looked = right.filter(F.col(time).isNotNull()).select(key, time, F.lit(1 if strict else 0).alias("__rank"), F.struct(*values).alias("__value"))
    return left.withColumn("__rank", F.lit(0 if strict else 1)).withColumn("__asked", F.lit(True)).unionByName(looked, allowMissingColumns=True)


def _with_found(both: DataFrame, left: DataFrame, time: str, values: list[str], found: Column) -> DataFrame:
    """The rows of left with what was found for them; a value whose name left has comes as name_found."""
    taken = set(left.columns)
    known = both.withColumn("__found", F.when(F.col(time).isNotNull(), found)).filter("__asked")
    return known.select(*left.columns, *(F.col(f"__found.{v}").alias(f"{v}_found" if v in taken else v) for v in values))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], strict: bool = False, span: int | None = None) -> DataFrame:
    """left with values of the last row of right, of the same key, at or before (strict: before) its time; null if none.

    Rows of left without a time find nothing, and rows of right without one are never found.
    """
    both, keys = _spread(_both(left, right, key, time, values, strict), key, time, span)
    order = Window.partitionBy(*keys).orderBy(time, "__rank").rowsBetween(Window.unboundedPreceding, 0)
    return _with_found(both, left, time, values, F.coalesce(F.last("__value", ignorenulls=True).over(order), "__before"))


def nearest(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], span: int | None = None) -> DataFrame:
    """As as_of; where nothing is at or before, the first row after it."""
    both, keys = _spread(_both(left, right, key, time, values, False), key, time, span)
    order = Window.partitionBy(*keys).orderBy(time, "__rank")
    past, later = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    found = F.coalesce(F.last("__value", ignorenulls=True).over(past), "__before", F.first("__value", ignorenulls=True).over(later), "__after")
    return _with_found(both, left, time, values, found)


def _spread(both: DataFrame, key: str, time: str, span: int | None) -> tuple[DataFrame, list[str]]:
    """both with what blocks of time before and after a row's own hold nearest to it, and the columns to sort within."""
    if not span:
        nothing = F.lit(None).cast(both.schema["__value"].dataType)
        return both.withColumns({"__before": nothing, "__after": nothing}), [key]
    at = F.when(F.col("__value").isNotNull(), F.col(time))
    summary = {"__last": F.max_by("__value", at), "__first": F.min_by("__value", at)}
    found = with_blocks_before(in_blocks(both, time, span), [key], summary, {"__before": F.last("__last", ignorenulls=True)}, {"__after": F.first("__first", ignorenulls=True)})
    return found, [key, BLOCK]


def rescaled(ticks: Column, timescale: Column | int, per_second: Column | int) -> Column:
    """Ticks of one timescale in another, halves up, exactly in 64-bit integers: whole seconds and the rest go apart.

    Exact for timescales up to 2**32 of which the product is below 2**62.
    """
    old, new = F.lit(timescale).cast("long"), F.lit(per_second).cast("long")
    rest = F.pmod(ticks, old)
    return floor_div(ticks - rest, old) * new + floor_div(rest * new * 2 + old, old * 2)


def floor_div(a: Column, b: Column) -> Column:
    """The integer quotient of longs, rounded down; b is positive."""
    return F.call_function("div", a - F.pmod(a, b), b)


def ticks_to_us(ticks: Column, timescale: Column | int) -> Column:
    return rescaled(ticks, timescale, 1_000_000)


def us_to_ticks(us: Column, rate: Column | int) -> Column:
    """Microseconds as ticks of an audio track, which runs at its sample rate."""
    return rescaled(us, 1_000_000, rate)


def ticks_to_seconds(ticks: Column, timescale: Column | int) -> Column:
    return ticks / F.greatest(F.lit(timescale), F.lit(1))


def seconds_to_ticks(seconds: Column, timescale: Column | int) -> Column:
    """A target duration in ticks: one at least."""
    return F.greatest(F.lit(1), F.floor(seconds * F.lit(timescale) + 0.5)).cast("long")
