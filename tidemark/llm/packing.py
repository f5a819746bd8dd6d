"""Packing texts into sequences of a fixed number of tokens by cutting-stock column generation.

A text's ids (with an end mark) are cut into pieces of a whole sequence each and one rest, so that pieces and
their checksums need no second pass. The rests' length histogram, by classes of lengths, is a cutting-stock
problem: a linear program over patterns (how many pieces of each class a sequence holds), whose columns are
priced by a knapsack over the program's duals. Rounded-down patterns, and first-fit patterns for what is left,
are dealt to pieces by their rank within their class. Only the histogram (at most CLASSES * SALTS numbers,
whatever the corpus holds) reaches the driver, and only the pattern table is sent back.

Null and empty texts are one piece, the end mark. Repeated rows are packed each. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import merge_file
from .common import CACHE_ENTRIES, checkpoint, held, slices, stable, worker
from .token_count import special, words_of
from .words import lower_words

#: Classes of lengths, and parts in which the pieces of a class are ranked: bounds of what the driver gets.
CLASSES, SALTS = 256, 128
#: Pivots of the linear program; what it hasn't improved by then only costs padding.
PIVOTS = 1500


class Ids:
    """Texts to ids, from a bounded cache of words."""

    def __init__(self, path: str) -> None:
        self.path, self.merger, self.cache = path, merge_file(path), {}

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [words_of(t, self.path) for t in texts]
        new = list(set().union(*(s for s, _ in split)).difference(self.cache))
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            self.cache.clear()
            new = list(set().union(*(s for s, _ in split)))
        self.cache.update(zip(new, self.merger.encode([w.encode("utf-8", "replace") for w in new]), strict=True))
        of = self.cache.__getitem__
        return [b"".join(map(of, s)) if not n else self.mixed(t) for t, (s, n) in zip(texts, split, strict=True)]

    def mixed(self, text: str) -> bytes:
        """The ids of a text that holds special tokens' strings."""
        split, added = special(self.path)
        parts = [added[x].to_bytes(4, "little") if k % 2 else b"".join(self.cache[w] for w in lower_words(x, self.path)) for k, x in enumerate(split.split(text))]
        return b"".join(parts)


def encoder(path: str) -> Ids:
    return held(("ids", path), lambda: Ids(path))


def pieces(df: DataFrame, path: str, end: int, size: int, key: str, text: str) -> DataFrame:
    """Pieces of all texts: key, start, length, ids_crc32, doc_tokens and row (tells repeated rows apart)."""
    source = df.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = source.schema[key].dataType.simpleString()
    mark = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in slices(batch.column(1)):
                rows, starts, lengths, sums, totals = [], [], [], [], []
                for k, ids in enumerate(encoder(path).ids(texts), a):
                    ids += mark
                    for at in range(0, len(ids), 4 * size):
                        part = ids[at : at + 4 * size]
                        rows.append(k)
                        starts.append(at // 4)
                        lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                        totals.append(len(ids) // 4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))],
                    names=[key, "start", "length", "ids_crc32", "doc_tokens"],
                )

    return source.mapInArrow(worker(run), f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def knapsack(value: np.ndarray, weight: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items within capacity, by dynamic programming over it."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    use = np.flatnonzero(value > 1e-12)
    value, weight = value[use], weight[use]
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if (fit := np.searchsorted(weight, c, "right")) and (got := value[:fit] + best[c - weight[:fit]])[k := int(got.argmax())] > best[c] + 1e-12:
            best[c], choice[c] = got[k], k
    pattern, c = np.zeros(len(use), np.int64), capacity
    while c > 0:
        if (k := choice[c]) < 0:
            c -= 1
        else:
            pattern[k] += 1
            c -= weight[k]
    return float(best[capacity]), np.bincount(use, pattern, len(value) if not len(use) else int(use.max()) + 1).astype(np.int64)


def cut(demand: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times, {class: pieces}) that together hold exactly demand[c] pieces of each class c of weight c + 1."""
    classes = np.flatnonzero(demand)
    if not len(classes):
        return []
    weight, need = classes + 1, demand[classes].astype(float)
    patterns = np.diag(capacity // weight).astype(float)
    inverse = np.diag(1 / np.diag(patterns))
    amount = inverse @ need
    for _ in range(PIVOTS):
        dual = inverse.sum(axis=0)
        value, column = knapsack(dual, weight, capacity)
        if value <= 1 + 1e-7:
            break
        entering = np.zeros(len(classes))
        entering[: len(column)] = column
        direction = inverse @ entering
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, amount / np.where(up, direction, 1), np.inf)
        leave = int(ratio.argmin())
        step = ratio[leave]
        amount = amount - step * direction
        amount[leave] = step
        patterns[:, leave] = entering
        pivot = inverse[leave] / direction[leave]
        inverse = inverse - np.outer(direction, pivot)
        inverse[leave] = pivot
    times = np.floor(np.maximum(amount, 0) + 1e-6).astype(np.int64)
    left, out = demand[classes].astype(np.int64), []
    for k in np.argsort(-amount, kind="stable"):
        column = patterns[:, k].astype(np.int64)
        held = column > 0
        n = min(int(times[k]), int((left[held] // column[held]).min())) if held.any() else 0
        if n > 0:
            out.append((n, {int(classes[i]): int(column[i]) for i in np.flatnonzero(held)}))
            left -= n * column
    while left.any():  # first fit, longest first, the same filling as often as it goes
        room, filling = capacity, np.zeros(len(classes), np.int64)
        for i in range(len(classes) - 1, -1, -1):
            filling[i] = min(left[i], room // weight[i])
            room -= filling[i] * weight[i]
        held = filling > 0
        n = int((left[held] // filling[held]).min())
        out.append((n, {int(classes[i]): int(filling[i]) for i in np.flatnonzero(held)}))
        left -= n * filling
    return out


def pack(df: DataFrame, path: str, size: int = 4096, end: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all texts with the sequence_id and offset of each; see the module."""
    unit = -(-size // CLASSES)
    capacity = size // unit
    cut_up = pieces(df, path, end, size, key, text)
    ranked = cut_up.withColumn("class", (F.ceil(F.col("length") / unit) - 1).cast("int"))
    ranked = checkpoint(ranked.withColumn("salt", F.pmod(stable(F.col(key), F.col("start"), F.col("ids_crc32")), F.lit(SALTS)).cast("int")))
    counts = ranked.groupBy("class", "salt").count().toPandas().sort_values(["class", "salt"])
    demand = np.bincount(counts["class"], counts["count"], capacity).astype(np.int64)
    before = {(c, s): n for c, s, n in zip(counts["class"], counts["salt"], counts.groupby("class")["count"].cumsum() - counts["count"], strict=True)}
    # For each class: the ranks from which a pattern's slots begin, the pattern's first sequence, and its slots of the class.
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    used, sequence = np.zeros(capacity, np.int64), 0
    for times, held in cut(demand, capacity):
        for c, slots in held.items():
            places.setdefault(c, []).append((int(used[c]), sequence, slots, times))
            used[c] += times * slots
        sequence += times
    table = {c: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for c, rows in places.items()}

    @F.pandas_udf("long")
    def sequence_of(c: pd.Series, salt: pd.Series, number: pd.Series) -> pd.Series:
        rank = number.to_numpy() - 1 + np.array([before[x] for x in zip(c, salt, strict=True)], np.int64)
        out = np.zeros(len(c), np.int64)
        for k in np.unique(c):
            mine = (c == k).to_numpy()
            begin, first, slots, _ = table[k]
            p = np.searchsorted(begin, rank[mine], "right") - 1
            out[mine] = first[p] + (rank[mine] - begin[p]) // slots[p]
        return pd.Series(out)

    within = Window.partitionBy("class", "salt").orderBy(F.col(key).asc_nulls_first(), "start", "ids_crc32")
    dealt = ranked.withColumn("__n", F.row_number().over(within)).withColumn("sequence_id", sequence_of("class", "salt", "__n"))
    in_order = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), F.col(key).asc_nulls_first(), "start", "ids_crc32", "__n", "salt")
    offset = F.coalesce(F.sum("length").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return dealt.select(key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
