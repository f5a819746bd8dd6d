"""Near-duplicate embeddings by an epsilon grid order join.

Vectors are scaled to length 1, where a cosine of at least `least` is a distance of at most epsilon. They are
projected on the leading principal axes (fitted on a bounded sample; any axes give the same links, only slower),
laid in a grid of cells as wide as epsilon, and sorted by group and cell. The sequence is cut into intervals of
at most INTERVAL numbers, as wide as they are stored. Two intervals are joined if their boxes come within epsilon; a join halves the larger
interval again and again, drops halves whose boxes are farther apart than epsilon, and compares what is left
by one product of matrices in double precision. Boxes of projections never are farther apart than vectors, so nothing
within epsilon is lost.

Rows with equal vectors of a group are one class, joined once and counted by size. Intervals give, for each class,
its number of links and one link to the least class that their links lead it to, so no list of pairs is made.

Vectors that are null, empty, zero or hold null or non-finite components, and vectors of a null group, link with
nothing; so do rows without an id. Vectors of different sizes are never compared. Repeated rows link with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import Batches, checkpoint, worker
from .components import components, forest

#: Leading principal axes of the grid, and vectors they are fitted on at most.
AXES, SAMPLE = 6, 4096
#: Numbers that the vectors of an interval hold together. Pairs of intervals are what is shuffled: the longer they are, the fewer.
INTERVAL = 1 << 17
#: Vectors of a part that is compared without being halved again.
LEAF = 128


def sound(vector: str) -> F.Column:
    """If a vector can be compared."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def axes_of(vectors: np.ndarray) -> np.ndarray:
    """Leading principal axes of rows of length 1, as columns."""
    _, axes = np.linalg.eigh(np.cov(vectors.T) if len(vectors) > 1 else np.eye(vectors.shape[1]))
    return axes[:, ::-1][:, :AXES]


def units(batch: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    return scaled(batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size))


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # lest squares overflow or vanish
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def apart(a: np.ndarray, b: np.ndarray) -> float:
    """Least distance of the boxes around two sets of points."""
    gap = np.maximum(np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)), 0)
    return float(np.sqrt((gap * gap).sum()))


def interval_pairs(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, least: float, epsilon: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of linked rows of two intervals (each pair once, if they are the same)."""
    pending = [(0, len(x), 0, len(y))]
    while pending:
        a, b, c, d = pending.pop()
        if a == b or c == d or apart(px[a:b], py[c:d]) > epsilon:
            continue
        if max(b - a, d - c) <= LEAF:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= least)
            i, j = i + a, j + c
            yield (i[i < j], j[i < j]) if same else (i, j)
        elif same and (a, b) == (c, d):
            m = (a + b) // 2
            pending += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            m = (a + b) // 2
            pending += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            pending += [(a, b, c, m), (a, b, m, d)]


def near_duplicates(df: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", group: str = "label") -> DataFrame:
    """Columns key (of integers), n_links, component_id and kept; see the module. An empty table gives an empty one."""
    source = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(group).alias("g"))
    usable = sound("v") & F.col("g").isNotNull() & F.col("id").isNotNull()
    hashed = source.select("id", "g", "v", F.coalesce(usable, F.lit(False)).alias("ok")).withColumn("k1", F.when(F.col("ok"), F.xxhash64(F.lit(1), "v"))).withColumn("k2", F.when(F.col("ok"), F.xxhash64(F.lit(2), "v")))
    classes = checkpoint(
        hashed.filter("ok").groupBy("g", "k1", "k2").agg(F.min("id").alias("class"), F.count("*").alias("n"), F.first("v").alias("v")).withColumn("size", F.size("v"))
    )
    epsilon = math.sqrt(max(2 - 2 * least, 0)) + 1e-9
    sample = classes.orderBy(F.xxhash64("class"), "k1").limit(SAMPLE).select("v", "size").toPandas()
    size = int(sample["size"].mode().iloc[0]) if len(sample) else 1
    picked = np.stack(sample["v"][sample["size"] == size].to_list()) if len(sample) else np.ones((1, 1))
    axes = axes_of(scaled(picked))
    # Numbers that were stored in 32 bits are sent in 32 bits; all products are of 64.
    stored = np.dtype("<f4" if df.schema[vector].dataType == ArrayType(FloatType(), df.schema[vector].dataType.containsNull) else "<f8")

    def projected(unit: np.ndarray) -> np.ndarray:
        return unit @ axes if unit.shape[1] == size else unit[:, : min(AXES, unit.shape[1])]

    kind = classes.schema["g"].dataType.simpleString()

    def cells(batches: Batches) -> Batches:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for n in np.unique(sizes):
                part = batch.filter(pa.array(sizes == n))
                cell = np.floor(projected(units(part.column("v"), int(n))) / epsilon).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("g", "class", "n", "size", "v")), pa.array(list(cell), pa.list_(pa.int64()))], names=["g", "class", "n", "size", "v", "cell"])

    in_grid = classes.mapInArrow(worker(cells), f"g {kind}, class long, n long, size int, v array<double>, cell array<long>")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("g", "size", "cell", "class")
    sequence = in_grid.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.spark_partition_id().cast("long"))

    def intervals(batches: Batches) -> Batches:
        held: list[tuple] = []
        number = 0

        def made() -> pa.RecordBatch:
            nonlocal number
            number += 1
            rows = np.array([h[4] for h in held], np.float64)
            p = projected(scaled(rows))
            columns = [[held[0][0]], [held[0][3]], [held[0][5] << 32 | number], [p.min(axis=0).tolist()], [p.max(axis=0).tolist()]]
            columns += [[np.array([h[k] for h in held], np.int64).tobytes()] for k in (1, 2)] + [[rows.astype(stored).tobytes()]]
            kinds = (group_kind, pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["g", "size", "interval", "low", "high", "ids", "counts", "numbers"])

        group_kind = None
        for batch in batches:
            group_kind = batch.column("g").type
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                for row in zip(*(part.column(c).to_pylist() for c in ("g", "class", "n", "size", "v", "at")), strict=True):
                    if held and (len(held) >= INTERVAL // max(held[0][3], 1) or held[-1][0] != row[0] or held[-1][3] != row[3]):
                        yield made()
                        held.clear()
                    held.append(row)
        if held:
            yield made()

    blocks = checkpoint(sequence.mapInArrow(worker(intervals), f"g {kind}, size int, interval long, low array<double>, high array<double>, ids binary, counts binary, numbers binary"))
    # Intervals meet if a cell of the first axis, or one beside it, is in both and their boxes are near.
    first = lambda c, by: (F.floor(F.element_at(c, 1) / epsilon) + by).cast("long")
    span = blocks.select("g", "size", "interval", "low", "high")
    left = span.withColumn("c", F.explode(F.sequence(first("low", -1), first("high", 1)))).toDF("g", "size", "i", "low_i", "high_i", "c")
    right = span.withColumn("c", F.explode(F.sequence(first("low", 0), first("high", 0)))).toDF("g", "size", "j", "low_j", "high_j", "c")
    gaps = F.zip_with(F.zip_with("low_i", "high_j", lambda a, b: a - b), F.zip_with("low_j", "high_i", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    distance = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    near = left.join(right, ["g", "size", "c"]).filter((F.col("i") <= F.col("j")) & (distance <= epsilon * epsilon)).select("i", "j").distinct()
    data = blocks.select("interval", "size", "ids", "counts", "numbers")
    sides = near.select("i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("interval")).join(data, "interval")

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["interval"])
        ids, counts, unit = ([np.frombuffer(r[c], k) for r in rows] for c, k in (("ids", np.int64), ("counts", np.int64), ("numbers", stored)))
        unit = [scaled(u.astype(np.float64).reshape(len(i), -1)) for u, i in zip(unit, ids, strict=True)]
        same = len(rows) == 1
        links = [np.zeros(len(i), np.int64) for i in ids]
        a_all, b_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in interval_pairs(unit[0], projected(unit[0]), unit[-1], projected(unit[-1]), least, epsilon, same):
            links[0] += np.bincount(i, counts[-1][j], len(ids[0])).astype(np.int64)
            links[-1] += np.bincount(j, counts[0][i], len(ids[-1])).astype(np.int64)
            a_all.append(ids[0][i])
            b_all.append(ids[-1][j])
        root = dict(zip(*forest(np.concatenate(a_all).tolist(), np.concatenate(b_all).tolist()), strict=True))
        out = [(int(k), int(n), root.get(int(k), int(k))) for block, found in zip(ids, links, strict=True) for k, n in zip(block, found, strict=True) if n]
        return pa.table([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], names=["class", "links", "root"])

    found = checkpoint(sides.groupBy("i", "j").applyInArrow(join, "class long, links long, root long"))
    linked = found.groupBy("class").agg(F.sum("links").alias("links"))
    member = components(found.filter(F.col("class") != F.col("root")).select(F.col("class").alias("a"), F.col("root").alias("b"))).toDF("class", "component")
    of_class = classes.select("g", "k1", "k2", "class", "n").join(linked, "class", "left").join(member, "class", "left")
    rows = hashed.select("id", "g", "k1", "k2").join(of_class, ["g", "k1", "k2"], "left")
    component = F.coalesce("component", "class", "id")
    return rows.select(
        F.col("id").alias(key),
        F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
