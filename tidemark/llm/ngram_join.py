"""Exact Jaccard join of shingle sets by parity sketches.

A text's set is its distinct word shingles (shingles.py). Texts with equal sets are one class, found by digest,
and only classes are compared. Two classes link when 100 * intersection >= percent * union; then their sets
differ in at most `difference(size)` shingles, where size is the larger set's.

Sketch: shingles are dealt by hash to as many parts as that number plus one, and XOR-hashed within each part.
A shingle in one set only can change one part at most, so the number of parts that differ (the sketches' Hamming
distance by parts) never exceeds the symmetric difference, and linked classes agree in some part. Parts are
numbered within size bands; a class emits the parts of its own band, and of the next if its partner may be there.

Joining parts: for each part that several classes share, its least class (under a few orders of hashing)
is paired with the others, pairs are verified on the sets, and links are contracted to components. Within parts
whose classes are still in several components, every pair across components whose parity sketches of single bits do
not rule it out is verified; large parts are split in blocks for that. So no pair that could join two
components is left unverified, and no part is paired out as a whole.

Null, empty and blank texts have an empty set, 0 shingles, and link with nothing. In groups(), rows without an id link with
nothing and have no component, and repeated rows give a row each, with the same component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import T1, T2, checkpoint, keyed, map_texts, release, slices, worker
from .components import components
from .shingles import mix, set_keys, shingle_sets

#: Classes of one part that are compared in one block; larger parts are split in blocks.
BLOCK = 256
#: Orders under which the classes of a part have a least one, and so rounds before blocks.
ORDERS = 2
#: Parts of a class by which it is told where a pair is made.
FIRST = 16
#: Ids or pairs of them that are sent to every executor to pick rows; more are joined by a shuffle.
SENT_IDS = 500_000
#: Shingles of sets that are sent to every executor, likewise.
SENT_SHINGLES = 2_000_000


def difference(size: int, percent: int) -> int:
    """Most shingles by which a set of this size and one that is no larger can differ and still link."""
    # u - i = a + b - 2 * i, and linking means i >= percent * (a + b) / (100 + percent); most where a = b = size.
    return 2 * size * (100 - percent) // (100 + percent)


def parts_of(size: int, percent: int) -> list[tuple[int, int]]:
    """The bands whose parts a set of this size emits, with the number of parts: its own, and those of larger partners.

    Sizes double from band to band; a pair belongs to the band of its larger set.
    """
    bands = [size.bit_length()]
    while (1 << bands[-1]) * percent <= 100 * size:  # the least size of the next band is within reach
        bands.append(bands[-1] + 1)
    return [(b, difference((1 << b) - 1, percent) + 1) for b in bands]


def part_keys(own: np.ndarray, percent: int) -> np.ndarray:
    """Keys of parts of the sketch of a set; equal keys: the same band, part and shingles in it.

    The parts that hold fewest shingles are left out while a partner must agree in more parts than are left out:
    a part in which two sets agree holds as many shingles of each, so the set that leaves out more of the two
    still has one of these parts, and so has the other.
    """
    out = []
    spread = mix(own ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)
    farthest = len(own) * (100 - percent) // percent
    for b, parts in parts_of(len(own), percent):
        if parts < 2:  # sets that small link only if equal
            continue
        part = (spread * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part)
        counts = np.bincount(part, minlength=parts)
        value = np.zeros(parts, np.uint64)
        filled = np.flatnonzero(counts)
        value[filled] = np.bitwise_xor.reduceat(own[order], (np.cumsum(counts) - counts)[filled])
        weak = np.cumsum(np.bincount(counts))  # parts of so many shingles at most
        least = int(np.searchsorted(weak, parts - min(farthest, parts - 1) - 1, "right"))
        kept = np.flatnonzero(counts >= least)
        out.append(mix(value[kept] + mix(kept.astype(np.uint64) + np.uint64(b << 32))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def parity(own: np.ndarray) -> bytes:
    """A sketch of 256 to 16384 bits, four or more for each shingle, each the parity of the shingles that hash to it.

    A bit is a shingle's hash modulo their number, so the XOR of a sketch's halves is the sketch of half its bits.
    """
    bits = min(max(256, 4 << len(own).bit_length()), 16384)
    place = (mix(own ^ np.uint64(0x9E6C63D0876A9F1B)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, all folded to the shortest."""
    size = min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, size // 8), axis=0) for x in sketches])


def may_link(apart: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """If sets of n shingles together can link although their sketches differ in so many bits."""
    # u - i <= (100 - percent) * u / 100 and u <= 100 * n / (100 + percent)
    return apart.astype(np.int64) * (100 + percent) <= (100 - percent) * n


def with_sets(df: DataFrame, keep: list[Column], text: str, width: int) -> DataFrame:
    """Columns keep, n (size of the set) and the set's two digests k1 and k2."""

    def run(texts: list[str]) -> dict[str, object]:
        sets = shingle_sets([t.encode("utf-8", "replace") for t in texts], width)
        k1, k2 = set_keys(sets)
        return {"n": [len(s) for s in sets], "k1": k1, "k2": k2}

    return map_texts(df, keep, F.col(text), "n long, k1 long, k2 long", run)


def part_rows(df: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """part and k1, a row for each part of each text's sketch."""
    source = df.select(F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                sets = shingle_sets([t.encode("utf-8", "replace") for t in texts], width)
                k1, _ = set_keys(sets)
                keys = [part_keys(s, percent) for s in sets]
                lengths = [len(k) for k in keys]
                joined = np.concatenate(keys).view(np.int64)
                owner = np.repeat(k1, lengths)
                for at in range(0, len(joined), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(joined[at : at + 50_000]), pa.array(owner[at : at + 50_000])], names=["part", "k1"])

    return source.mapInArrow(worker(run), "part long, k1 long")


def set_rows(df: DataFrame, text: str, width: int) -> DataFrame:
    """k1, n, the set and its parity sketch, of each text."""

    def run(texts: list[str]) -> dict[str, object]:
        sets = shingle_sets([t.encode("utf-8", "replace") for t in texts], width)
        return {"k1": set_keys(sets)[0], "n": [len(s) for s in sets], "shingles": [s.view(np.int64) for s in sets], "sketch": [parity(s) for s in sets]}

    return map_texts(df, [], F.col(text), "k1 long, n long, shingles array<long>, sketch binary", run)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link; b is the side with fewer different sets."""
    pairs = checkpoint(pairs)
    few = pairs.count() <= SENT_IDS
    sent = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    right = sets.select(F.col("k1").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb")).join(sent(pairs.select("b").distinct()), "b", "left_semi")
    left = sets.select(F.col("k1").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa")).join(sent(pairs), "a")
    if (right.agg(F.sum("nb")).first()[0] or 0) <= SENT_SHINGLES:
        right = F.broadcast(right)
    near = left.join(right, "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return near.withColumn("i", both).filter(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * percent).select("a", "b")


def screened(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the sizes and sketches of their sets don't rule out."""
    side = lambda k: sets.select(F.col("k1").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            apart = [int(np.bitwise_count(np.bitwise_xor(*folded([x, y]))).sum()) for x, y in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(may_link(np.array(apart, np.int64), na + nb, percent)))

    return near.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(worker(run), "a long, b long")


def across(pairs_of: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) across components within parts, less those that the sketches rule out.

    pairs_of: part, k1, component, n, sketch, the class's FIRST least parts, and the number of rows of the part (members).
    If two classes have one of these in common, the least such part is the least of all that they share, and the pair is
    made there only; else it is made in all, which are few if so many of the least are not among them.
    """
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("k1"), blocks).cast("int")
    # A block meets every block, itself included, once: its rows go to (i, j) for all i <= own and j >= own.
    spread = pairs_of.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select("part", "k1", "component", "n", "sketch", "least", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        k1, component, n, own = (table.column(c).to_numpy() for c in ("k1", "component", "n", "own"))
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        sketch = folded(table.column("sketch").to_pylist())
        part, least = table.column("part")[0].as_py(), [frozenset(v) for v in table.column("least").to_pylist()]
        a_out, b_out = [], []
        for x in range(len(k1)):
            ok = (component != component[x]) & (k1 > k1[x])
            if not same:
                ok &= own != own[x]
            y = np.flatnonzero(ok)
            y = y[np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent]
            if len(y):
                y = y[may_link(np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1), n[y] + n[x], percent)]
                y = y[[min(least[x] & least[k], default=part) == part for k in y.tolist()]] if len(y) else y
                a_out.append(np.full(len(y), k1[x]))
                b_out.append(k1[y])
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *a_out]), "b": np.concatenate([none, *b_out])})

    return spread.groupBy("part", "i", "j").applyInArrow(run, "a long, b long").distinct()


def link_classes(df: DataFrame, text: str, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """k1 and component (another k1) of every class that links with another.

    classes: k1, and the id and T1 of a row of each class. df: the table they are from, with its id.
    """
    parts = part_rows(df, text, width, percent)
    shared = checkpoint(parts.groupBy("part").count().filter(F.col("count") > 1).select("part"))
    release(df.sparkSession)
    members = checkpoint(parts.join(shared, "part").distinct())
    release(df.sparkSession)
    # Copies of one set have made some parts look shared.
    members = checkpoint(members.join(members.groupBy("part").count().filter(F.col("count") > 1).select("part"), "part"))
    wanted = members.select("k1").distinct().join(classes, "k1").select(F.col("id").alias("__id"), F.col(T1).alias("__o1"))
    wanted = checkpoint(wanted.distinct())
    few = wanted.count() <= SENT_IDS
    texts = keyed(df, text).join(F.broadcast(wanted) if few else wanted, F.col("id").eqNullSafe(F.col("__id")) & (F.col(T1) == F.col("__o1")), "left_semi")
    sets = checkpoint(set_rows(texts, text, width))
    if sets.count() > wanted.count():  # rows that share id and text
        sets = checkpoint(sets.dropDuplicates(["k1"]))
    release(df.sparkSession)

    active = members.withColumn("component", F.col("k1"))
    links = None
    for order in range(ORDERS):
        hubs = active.groupBy("part").agg(F.min_by(F.struct("k1", "component"), F.xxhash64(F.lit(order), "component", "k1")).alias("hub"))
        pairs = active.join(hubs, "part").filter(F.col("component") != F.col("hub.component"))
        pairs = pairs.select(F.col("k1").alias("a"), F.col("hub.k1").alias("b")).distinct()
        new = verified(screened(pairs, sets, percent), sets, percent)
        found = checkpoint(components(new if links is None else links.union(new)))
        links = found.filter(F.col("node") != F.col("component")).toDF("a", "b")
        active = still_open(members, found.toDF("k1", "component"))
        release(df.sparkSession)
    # The one pair of a part of two classes has been verified.
    large = active.groupBy("part").agg(F.count("*").alias("members")).filter(F.col("members") > 2)
    active = checkpoint(active.join(large, "part"))
    lists = active.groupBy("k1").agg(F.slice(F.array_sort(F.collect_list("part")), 1, FIRST).alias("least"))  # a class has as many parts as its sketch
    left = active.join(sets.select("k1", "n", "sketch"), "k1").join(lists, "k1")
    return components(links.union(verified(across(left, percent), sets, percent))).toDF("k1", "component")


def still_open(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members, with their components, of parts that have several of these."""
    labelled = members.join(found, "k1", "left").select("part", "k1", F.coalesce("component", "k1").alias("component"))
    parts = labelled.groupBy("part").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    return checkpoint(labelled.join(parts.filter(F.col("x") < F.col("y")).select("part"), "part"))


def _grouped(df: DataFrame, key: str, text: str, width: int, percent: int, unnamed: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (id, digests of text and set, n) of df, and the component of each class of sets with its lead, the least row by id.

    unnamed: whether rows without an id take part, after all others.
    """
    rows = checkpoint(with_sets(keyed(df.select(F.col(key), F.col(text)), text), [F.col(key).alias("id"), F.col(T1), F.col(T2)], text, width))
    taking = rows.filter((F.col("n") > 0) & (F.lit(unnamed) | F.col("id").isNotNull()))
    lead = F.min(F.struct(F.col("id").isNull().alias("none"), "id", T1, T2)).alias("lead")
    classes = taking.groupBy("k1", "k2", "n").agg(lead)
    takes = F.lit(unnamed) | F.col("id").isNotNull()
    linked = link_classes(df.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(takes), "text", classes.select("k1", "lead.id", f"lead.{T1}"), width, percent)
    labelled = classes.join(linked, "k1", "left").withColumn("component", F.coalesce("component", "k1"))
    least = labelled.groupBy("component").agg(F.min("lead").alias("lead"))
    # Cut off from its aggregation, so that Spark can split a component of very many classes.
    return rows, labelled.drop("lead").join(checkpoint(least), "component").select("k1", "k2", "n", "lead")


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Columns key, n_shingles and component_id (the least id that links lead to, the row's own included)."""
    rows, of_class = _grouped(df, key, text, width, percent, False)
    joined = rows.join(of_class, ["k1", "k2", "n"], "left")
    own = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("lead.id")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """df with one row of each component: that of the least id, and of the least digest of text where rows share that id.

    Rows are told apart by id and text, so a row goes only if its own text links with the one that stays, whatever ids rows
    share. Rows without an id take part after all others. Of rows with the same id and text one stays. Rows without words stay.
    """
    rows, of_class = _grouped(df, key, text, width, percent, True)
    # Joined once, from the left and cut off: an inner join to what Spark can't size makes Bloom filters, MB each, in every task the driver sends.
    members = checkpoint(rows.join(of_class, ["k1", "k2", "n"], "left").select("id", T1, T2, "lead")).filter(F.col("lead").isNotNull())
    leads = F.col("id").eqNullSafe(F.col("lead.id")) & (F.col(T1) == F.col(f"lead.{T1}")) & (F.col(T2) == F.col(f"lead.{T2}"))
    identity = ("id", T1, T2)
    dropped = checkpoint(members.filter(~leads).select(*identity).distinct())
    repeated = checkpoint(members.filter(leads).groupBy(*identity).count().filter(F.col("count") > 1).select(*identity))

    def told(other: DataFrame, how: str) -> DataFrame:
        few, same = other.count() <= SENT_IDS, other.toDF("__id", "__o1", "__o2")
        return own.join(F.broadcast(same) if few else same, F.col(key).eqNullSafe(F.col("__id")) & (F.col(T1) == F.col("__o1")) & (F.col(T2) == F.col("__o2")), how)

    own = keyed(df, text)
    own = told(dropped, "left_anti")
    if not repeated.isEmpty():
        own = told(repeated, "left_anti").union(told(repeated, "left_semi").dropDuplicates([key, T1, T2]))
    return own.drop(T1, T2)
