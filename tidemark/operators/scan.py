"""Running totals, ranks and last values along a key of any length.

A window over a key sorts all of the key in one task. Here a key is cut into blocks of its order (span units each): each block is
summed up map-side, the blocks of a key are run through (a row each), and every row then needs its own block and one number of those
before it. A key with a large part of all rows is thus spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "__block"
_NONE = -(1 << 62)


def in_blocks(df: DataFrame, order: str, span: int) -> DataFrame:
    """df with the block of each row; rows without an order are a block of their own."""
    return df.withColumn(BLOCK, F.coalesce(F.floor(F.col(order) / span), F.lit(_NONE)).cast("long"))


def with_blocks_before(df: DataFrame, keys: list[str], summary: dict[str, Column], carried: dict[str, Column], after: dict[str, Column] | None = None) -> DataFrame:
    """df (in blocks) with carried: aggregates over what summary makes of the blocks before a row's own; after: likewise of those after it."""
    blocks = df.groupBy(*keys, BLOCK).agg(*(c.alias(n) for n, c in summary.items()))
    order = Window.partitionBy(*keys).orderBy(BLOCK)
    before, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    found = [c.over(before).alias(n) for n, c in carried.items()] + [c.over(later).alias(n) for n, c in (after or {}).items()]
    return df.join(blocks.select(*keys, BLOCK, *found), [*keys, BLOCK])


def running_sum(df: DataFrame, key: str, order: str, value: str, output: str, span: int) -> DataFrame:
    """df with the sum of value over the rows before each in its key."""
    placed = with_blocks_before(in_blocks(df, order, span), [key], {"__sum": F.sum(value)}, {"__before": F.sum("__sum")})
    within = Window.partitionBy(key, BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce("__before", F.lit(0)) + F.coalesce(F.sum(value).over(within), F.lit(0))
    return placed.withColumn(output, total.cast("long")).select(*df.columns, output)


def counted(df: DataFrame, key: str, order: str, begins: Column, output: str, span: int) -> DataFrame:
    """df with how many rows of its key, up to and with itself, begins is true of: the number of the group that they begin."""
    marked = df.withColumn("__begins", F.coalesce(begins, F.lit(False)).cast("long"))
    return running_sum(marked, key, order, "__begins", "__begun", span).withColumn(output, F.col("__begun") + F.col("__begins")).select(*df.columns, output)


def after_previous(df: DataFrame, key: str, order: str, value: Column, output: str, span: int) -> DataFrame:
    """df with value of the row before each in its key; null for the first."""
    valued = in_blocks(df, order, span).withColumn("__value", value)
    placed = with_blocks_before(valued, [key], {"__end": F.max_by("__value", order)}, {"__last": F.last("__end", ignorenulls=True)})
    before = F.lag("__value").over(Window.partitionBy(key, BLOCK).orderBy(order))
    return placed.withColumn(output, F.coalesce(before, "__last")).select(*df.columns, output)


def ranks(df: DataFrame, key: str, order: str, tie: list[str], output: str, span: int) -> DataFrame:
    """df with the number of rows before each in its key, by order and then tie."""
    placed = with_blocks_before(in_blocks(df, order, span), [key], {"__count": F.count("*")}, {"__before": F.sum("__count")})
    within = Window.partitionBy(key, BLOCK).orderBy(order, *tie)
    return placed.withColumn(output, (F.coalesce("__before", F.lit(0)) + F.row_number().over(within) - 1).cast("long")).select(*df.columns, output)
