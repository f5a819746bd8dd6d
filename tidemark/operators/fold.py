"""Greedy cuts along ordered rows: the one kind of step here whose state depends on its own output.

Rows are dealt by key and sorted within partitions, and a fold streams through each partition with a state of a few
numbers, so a key of any length needs no memory; within a batch it jumps from cut to cut by binary search on running
totals instead of going row by row. That is one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

#: A step gets the state (None at a key's first rows) and some rows of one key; it returns the state and the new column.
Step = Callable[[Any, dict[str, np.ndarray]], tuple[Any, np.ndarray]]


def fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], output: str, step: Step) -> DataFrame:
    """df with a column of longs that step makes of inputs, in order within keys."""
    names = df.columns
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        state: Any = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key_columns = [batch.column(names.index(k)) for k in keys]
            changed = np.zeros(batch.num_rows, bool)
            for column in key_columns:
                coded = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                changed[1:] |= coded[1:] != coded[:-1]
            starts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
            values = {c: batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in inputs}
            parts = []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if a == b:
                    continue
                key = tuple(c[a].as_py() for c in key_columns)
                if key != last:
                    last, state = key, None
                state, made = step(state, {c: v[a:b] for c, v in values.items()})
                parts.append(made)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts).astype(np.int64))], names=[*names, output])

    return dealt.mapInArrow(run, StructType([*df.schema.fields, StructField(output, LongType())]))


def by_keyframe(target: int, duration: str, sync: str) -> Step:
    """Segment of each sample: a keyframe begins a new one once the ticks pending reach target."""

    def step(state: tuple[int, int] | None, rows: dict[str, np.ndarray]) -> tuple[tuple[int, int], np.ndarray]:
        segment, pending = state or (0, 0)
        ticks = rows[duration].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(ticks)]) + pending  # before each row, and at the end
        places = np.flatnonzero(rows[sync])
        if state is None:
            places = places[places > 0]  # nothing is pending before the first sample
        out, base = np.full(len(ticks), segment, np.int64), 0
        at = total[places]
        k = int(np.searchsorted(at, base + target))
        while k < len(places):
            segment, base = segment + 1, int(at[k])
            out[places[k] :] = segment
            k = max(int(np.searchsorted(at, base + target)), k + 1)
        return (segment, int(total[-1]) - base), out

    return step


def by_gap(gap: int, time: str) -> Step:
    """1 for the first row and for each that is gap or more after the last row with a 1, else 0."""

    def step(state: int | None, rows: dict[str, np.ndarray]) -> tuple[int | None, np.ndarray]:
        at = rows[time].astype(np.int64)
        out, last = np.zeros(len(at), np.int64), state
        k = 0 if last is None else int(np.searchsorted(at, last + gap))
        while k < len(at):
            out[k], last = 1, int(at[k])
            k = max(int(np.searchsorted(at, last + gap)), k + 1)
        return last, out

    return step


def by_island(window: int, offset: str, size: str) -> Step:
    """Island of each range: a new one where a range doesn't begin at the last one's end, or the island would pass window."""

    def step(state: tuple[int, int, int] | None, rows: dict[str, np.ndarray]) -> tuple[tuple[int, int, int], np.ndarray]:
        at, sizes = rows[offset].astype(np.int64), rows[size].astype(np.int64)
        ends = at + sizes
        island, begin, end = state or (-1, 0, -1)
        out, k = np.zeros(len(at), np.int64), 0
        apart = np.flatnonzero(at[1:] != ends[:-1]) + 1
        while k < len(at):
            if island < 0 or at[k] != end or ends[k] - begin > window:
                island, begin = island + 1, int(at[k])
            stop = int(np.append(apart[np.searchsorted(apart, k, "right") :], len(at))[0])
            stop = max(min(stop, k + int(np.searchsorted(ends[k:stop], begin + window, "right"))), k + 1)
            out[k:stop], end, k = island, int(ends[stop - 1]), stop
        return (island, begin, end), out

    return step
