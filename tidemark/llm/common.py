"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one vectorised step works on; it bounds a worker's memory whatever the batch is.
STEP_CHARS = 500_000
#: Entries of a per-process cache of words; a full cache is emptied, which costs time and never changes a result.
CACHE_ENTRIES = 150_000


Batches = Iterator[pa.RecordBatch]


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut df's lineage into the shared folder of spark.checkpoint.dir.

    Where that is unset, a folder of the driver's machine serves a local master only; on a cluster executors could not share it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and context.master != "local" and not (context.master or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not folder:
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """The one vocabulary or model, with its caches, that a worker process holds; asking for another lets go of it.

    Workers are reused from stage to stage, so that what each stage held would add up.
    """
    if key not in _held:
        _held.clear()
        shrink()
        _held[key] = make()
    return _held[key]


@functools.lru_cache(1)
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def shrink() -> None:
    """Hand freed memory of this worker process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    _trim()(0)


def worker(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run for mapInArrow; at its end the process hands back the memory that its batches took."""

    def bounded(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            shrink()

    return bounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers find this package where the driver has it, unless they are told another place.
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(column: pa.Array, limit: int = STEP_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of an Arrow column of texts with their texts (null: empty), of about limit bytes; a longer text is a range of its own."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())).to_pylist()
    start, before = 0, 0
    for i, end in enumerate(ends):
        if i > start and end - before > limit:
            yield start, i, [t or "" for t in column.slice(start, i - start).to_pylist()]
            start, before = i, ends[i - 1]
    if start < len(column):
        yield start, len(column), [t or "" for t in column.slice(start).to_pylist()]


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that nothing refers to any more, which else stay until memory runs short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_texts(
    df: DataFrame, keep: list[Column], text: Column, schema: str, function: Callable[[list[str]], dict[str, object]], limit: int = STEP_CHARS
) -> DataFrame:
    """Columns keep of each row, followed by those of schema that function makes of its text (null: empty).

    function gets the texts of some rows and returns an array or list for each column of schema, row by row.
    """
    source = df.select(*keep, F.coalesce(text.cast("string"), F.lit("")).alias("__text"))
    names = source.columns[:-1]
    kinds = [f for f in source.schema.fields[:-1]]
    made = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType([*kinds, *made.fields])
    arrow = to_arrow_schema(made)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for a, b, texts in slices(batch.column(len(names)), limit):
                columns = function(texts)
                kept = [batch.column(i).slice(a, b - a) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(columns[f.name], type=f.type) for f in arrow)], names=[*names, *(f.name for f in arrow)])

    return source.mapInArrow(worker(run), out)


#: Two digests of a row's text; equal texts have equal ones.
T1, T2 = "__t1", "__t2"


def keyed(df: DataFrame, text: str) -> DataFrame:
    """df with T1 and T2 of its texts (null: empty)."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.withColumns({T1: F.xxhash64(F.lit(1), whole), T2: F.xxhash64(F.lit(2), whole)})


def stable(*columns: Column, seed: int = 0) -> Column:
    """A 64-bit hash of columns, the same in every run."""
    return F.xxhash64(F.lit(seed), *columns)


def filter_texts(df: DataFrame, text: str, function: Callable[[list[str]], object], limit: int = STEP_CHARS) -> DataFrame:
    """The rows of df for whose text (null: empty) function, given the texts of some rows, says true."""
    at = df.columns.index(text)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for a, b, texts in slices(batch.column(at), limit):
                yield batch.slice(a, b - a).filter(pa.array(function(texts), pa.bool_()))

    return df.mapInArrow(worker(run), df.schema)


def append_texts(df: DataFrame, text: str, schema: str, function: Callable[[list[str]], dict[str, object]], limit: int = STEP_CHARS) -> DataFrame:
    """The rows of df followed by the columns of schema that function, given the texts of some rows (null: empty), makes of them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    at, names = df.columns.index(text), df.columns
    made = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(made)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for a, b, texts in slices(batch.column(at), limit):
                columns = function(texts)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *(pa.array(columns[f.name], type=f.type) for f in arrow)], names=[*names, *(f.name for f in arrow)])

    return df.mapInArrow(worker(run), StructType([*df.schema.fields, *made.fields]))
