"""Sample indexes from run-length and chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import MAX_SAMPLES

from .scan import counted, running_sum
from .timeline import as_of


#: Samples, chunks or runs of a key that one task sorts.
SPAN = 1 << 16


def decode_times(samples: DataFrame, key: str = "track", order: str = "sample_idx", duration: str = "duration", output: str = "decode_time") -> DataFrame:
    """samples with the ticks before each in its track."""
    return running_sum(samples, key, order, duration, output, SPAN)


def rows_of_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays of equal length to rows, numbered from 0."""
    return df.select(F.posexplode(F.arrays_zip(*columns)).alias("sample_idx", "row")).select("sample_idx", "row.*")


def expand_runs(runs: DataFrame, key: str, order: str, count: str, value: str, most: int = MAX_SAMPLES) -> DataFrame:
    """key, sample_idx and value of each run, repeated count times; more than most rows of a key are an error."""
    placed = running_sum(runs.select(key, order, count, value).filter(F.col(count) > 0), key, order, count, "__first", SPAN)
    stop = F.col("__first") + F.col(count)
    checked = F.when(stop > most, F.raise_error(F.concat(F.lit(f"more than {most} samples of "), F.col(key).cast("string"))).cast("long")).otherwise(stop - 1)
    each = F.explode(F.sequence(F.col("__first"), checked))
    return placed.select(key, each.alias("sample_idx"), value)


def covering_runs(chunks: DataFrame, runs: DataFrame, key: str, chunk: str, *values: str) -> DataFrame:
    """Chunks with the values of the last run of their key whose first chunk isn't after them (null if there is none)."""
    return as_of(chunks, runs, key, chunk, list(values), span=SPAN)


def sample_rows(tracks: DataFrame, *keys: str, most: int = MAX_SAMPLES) -> DataFrame:
    """keys, sample_idx, offset, size, duration, is_sync and cts of every sample of tracks with run-length tables (sources/media.py).

    A track's tables are arrays of a row, of which at most `most` samples may speak. They are unrolled side by side within the row,
    and zipped, so that nothing is shuffled but by chunk, for offsets. Sizes say which samples there are; a duration, offset or
    chunk that is missing is 0, chunks take the samples of the last run that begins at or before them, and without a table of
    sync samples all are.
    """
    n = F.size("sizes")
    repeat = lambda value, times: F.array_repeat(value, F.greatest(times, F.lit(0)).cast("int"))
    unrolled = lambda c: F.flatten(F.transform(c, lambda r: repeat(r["b"], r["a"])))
    many = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, r: s + r["a"])
    too_many = (n > most) | (F.size("chunks") > most) | (many("stts") > most) | (many("ctts") > most)
    checked = tracks.withColumn("sizes", F.when(too_many, F.raise_error(F.lit(f"more than {most} samples")).cast("array<long>")).otherwise(F.col("sizes")))
    stop = lambda i: F.coalesce(F.get("stsc", i + 1)["a"], F.size("chunks") + F.lit(1).cast("long"))
    before = repeat(F.lit(0).cast("long"), F.coalesce(F.get("stsc", F.lit(0))["a"], F.size("chunks") + F.lit(1).cast("long")) - 1)
    per_chunk = F.concat(before, F.flatten(F.transform("stsc", lambda r, i: repeat(r["b"], stop(i) - r["a"]))))
    flags = F.flatten(F.transform("sync", lambda s, j: F.concat(repeat(F.lit(False), s - 1 - F.when(j > 0, F.get("sync", j - 1)).otherwise(0)), F.array(F.lit(True)))))
    runs = checked.withColumns({"sync": F.array_sort(F.array_distinct("sync")), "per_chunk": per_chunk})
    held = F.flatten(F.transform("chunks", lambda base, c: repeat(F.struct(c.alias("chunk"), base.alias("base")), F.least(F.coalesce(F.get("per_chunk", c), F.lit(0)), n.cast("long")))))
    sync = F.when(F.col("sync").isNull(), repeat(F.lit(True), n)).otherwise(flags)
    zipped = F.arrays_zip(F.col("sizes").alias("size"), *(F.slice(c, F.lit(1), n).alias(name) for c, name in ((unrolled("stts"), "duration"), (unrolled("ctts"), "cts"), (held, "held"), (sync, "is_sync"))))
    whole = runs.select(*keys, F.posexplode(zipped).alias("sample_idx", "s")).select(*keys, F.col("sample_idx").cast("long").alias("sample_idx"), "s.*")
    within = Window.partitionBy(*keys, "held.chunk").orderBy("sample_idx").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.when(F.col("held").isNotNull(), F.col("held.base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    rest = (F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("duration", "cts"))
    return whole.select(*keys, "sample_idx", F.coalesce(offset, F.lit(0)).cast("long").alias("offset"), "size", F.coalesce("is_sync", F.lit(False)).alias("is_sync"), *rest)


def chunk_offsets(samples: DataFrame, key: str, chunk: str, order: str, base: str, size: str) -> Column:
    """Offset of each sample: its chunk's, and the sizes before it in the chunk."""
    before = Window.partitionBy(key, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (F.col(base) + F.coalesce(F.sum(size).over(before), F.lit(0))).cast("long")


def run_offsets(samples: DataFrame, key: str, order: str, base: str, data_offset: str, size: str) -> DataFrame:
    """Offsets in fragments: a run with a data offset begins at base plus that; others go on from the cursor."""
    numbered = counted(samples, key, order, F.col(data_offset).isNotNull(), "__group", SPAN)
    start = F.first(data_offset).over(Window.partitionBy(key, "__group").orderBy(order))
    before = Window.partitionBy(key, "__group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col(base) + F.coalesce(start, F.lit(0)) + F.coalesce(F.sum(size).over(before), F.lit(0))
    return numbered.withColumn("offset", offset.cast("long")).drop("__group")


def cascade(*values: Column | str) -> Column:
    """The first of a sample's, its header's and its track's value that is set, else 0."""
    return F.coalesce(*(F.col(v) if isinstance(v, str) else v for v in values), F.lit(0))


def is_sync_flag(flags: Column) -> Column:
    return flags.bitwiseAND(0x10000) == 0


def sync_membership(samples: DataFrame, table: DataFrame, key: str, number: str, has_table: str | None = None) -> DataFrame:
    """samples with is_sync: whether table lists their number; all are where there is no table."""
    listed = table.select(key, number).distinct().withColumn("__listed", F.lit(True))
    joined = samples.join(listed, [key, number], "left")
    found = F.col("__listed").isNotNull()
    return joined.withColumn("is_sync", found if has_table is None else F.when(F.col(has_table), found).otherwise(F.lit(True))).drop("__listed")
