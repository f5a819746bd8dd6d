"""Boxes of the ISO base media format: walking, reading and packing them in bytes.

Python runs here only, where bytes are taken apart or put together; what comes out are rows.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from tidemark.model import ERRORS, MAX_MOOF, MAX_MOOV, MAX_SAMPLES

#: Rows, and bytes read for them, after which a batch goes back to Spark: small files share one, and a large one doesn't wait.
BATCH_ROWS, BATCH_BYTES = 4096, 1 << 20
#: Boxes that hold boxes.
CONTAINERS = frozenset("moov trak mdia minf stbl mvex moof traf dinf edts udta".split())


def walk(data: bytes, start: int = 0, stop: int | None = None) -> Iterator[tuple[str, int, int, int]]:
    """kind, place, header length and size of each box in a range, up to the first that can't be one."""
    at, stop = start, len(data) if stop is None else stop
    while at + 8 <= stop:
        size, kind = struct.unpack_from(">I4s", data, at)
        header = 8
        if size == 1:
            if at + 16 > stop:
                return
            size, header = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = stop - at
        if size < header or at + size > stop:
            return
        yield kind.decode("latin-1"), at, header, size
        at += size


def walk_all(data: bytes, start: int = 0, stop: int | None = None) -> Iterator[tuple[str, int, int, int, int]]:
    """path, depth, place, header length and size of all boxes, parents before children, however deep."""
    pending = [("", 0, walk(data, start, stop))]
    while pending:
        path, depth, boxes = pending[-1]
        found = next(boxes, None)
        if found is None:
            pending.pop()
            continue
        kind, at, header, size = found
        here = f"{path}/{kind}" if path else kind
        yield here, depth, at, header, size
        if kind in CONTAINERS:
            pending.append((here, depth + 1, walk(data, at + header, at + size)))


def _entries(body: bytes, form: str) -> list[tuple[int, ...]]:
    """Entries after version, flags and a count; as many as there are bytes for."""
    width = struct.calcsize(form)
    if len(body) < 8:
        return []
    count = min(struct.unpack_from(">I", body, 4)[0], (len(body) - 8) // width)
    return [struct.unpack_from(form, body, 8 + k * width) for k in range(count)]


def track_tables(data: bytes) -> list[dict[str, object]]:
    """For each track of a movie: its id, handler, timescale, description and run-length tables, as far as they can be read."""
    tracks: list[dict[str, object]] = []
    for path, _, at, header, size in walk_all(data):
        body = data[at + header : at + size]
        if path == "moov/trak":
            tracks.append({"track_id": 0, "handler": "", "timescale": 0, "stts": [], "ctts": [], "stsc": [], "sizes": [], "chunks": [], "sync": None, "stsd": b""})
        if not tracks or not path.startswith("moov/trak/"):
            continue
        t, kind = tracks[-1], path.rpartition("/")[2]
        wide = bool(body[:1] == b"\x01")
        if kind == "tkhd" and len(body) >= (24 if wide else 16):
            t["track_id"] = struct.unpack_from(">I", body, 20 if wide else 12)[0]
        elif kind == "mdhd" and len(body) >= (24 if wide else 16):
            t["timescale"] = struct.unpack_from(">I", body, 20 if wide else 12)[0]
        elif kind == "hdlr" and len(body) >= 12:
            t["handler"] = body[8:12].decode("latin-1")
        elif kind == "stsd":
            t["stsd"] = body
        elif kind == "stts":
            t["stts"] = _entries(body, ">II")
        elif kind == "ctts":
            t["ctts"] = _entries(body, ">Ii")
        elif kind == "stsc":
            t["stsc"] = _entries(body, ">III")
        elif kind == "stco":
            t["chunks"] = [x[0] for x in _entries(body, ">I")]
        elif kind == "co64":
            t["chunks"] = [x[0] for x in _entries(body, ">Q")]
        elif kind == "stss":
            t["sync"] = [x[0] for x in _entries(body, ">I")]
        elif kind == "stsz" and len(body) >= 12:
            fixed, count = struct.unpack_from(">II", body, 4)
            if count > MAX_SAMPLES:
                raise ValueError(ERRORS["too_many_samples"])
            t["sizes"] = [fixed] * count if fixed else [x[0] for x in struct.iter_unpack(">I", body[12 : 12 + 4 * min(count, (len(body) - 12) // 4)])]
    return tracks


def parse_boxes(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, path, depth, offset and size of every box of every file."""
    return rows_of(files, key, content, "path string, depth int, offset long, size long", lambda data: [(path, depth, at, size) for path, depth, at, _, size in walk_all(data)])


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind.encode("latin-1")) + body


def full_box(kind: str, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def media_segment(sequence: int, track_id: int, base_time: int, samples: list[tuple[int, bool, int, bytes]]) -> bytes:
    """A fragment with one run of samples (duration, sync, composition offset, data)."""
    rows = b"".join(struct.pack(">IIIi", d, len(x), 0x02000000 if s else 0x01010000, c) for d, s, c, x in samples)

    def fragment(offset: int) -> bytes:
        run = full_box("trun", 1, 0xF01, struct.pack(">Ii", len(samples), offset), rows)
        track = box("traf", full_box("tfhd", 0, 0x020000, struct.pack(">I", track_id)), full_box("tfdt", 1, 0, struct.pack(">Q", base_time)), run)
        return box("moof", full_box("mfhd", 0, 0, struct.pack(">I", sequence)), track)

    return box("styp", b"msdh\0\0\0\0msdhmsix") + fragment(len(fragment(0)) + 8) + box("mdat", *(x for *_, x in samples))


def fragment_samples(data: bytes) -> list[tuple[int, int, int, int, bool, int]]:
    """track, offset, size, duration, sync and composition offset of each sample of all fragments."""
    out = []
    for kind, at, header, size in walk(data):
        if kind != "moof":
            continue
        for inner, a, h, s in walk(data, at + header, at + size):
            if inner != "traf":
                continue
            track, base, default, cursor = 0, at, {"duration": 0, "size": 0, "flags": 0}, at
            for leaf, b, lh, ls in walk(data, a + h, a + s):
                body = data[b + lh : b + ls]
                if leaf == "tfhd" and len(body) >= 8:
                    flags, track = struct.unpack_from(">II", body)
                    place = 8
                    for bit, name, form in ((1, "base", ">Q"), (2, "", ">I"), (8, "duration", ">I"), (16, "size", ">I"), (32, "flags", ">I")):
                        if flags & bit and place + struct.calcsize(form) <= len(body):
                            value = struct.unpack_from(form, body, place)[0]
                            place += struct.calcsize(form)
                            if name == "base":
                                base = cursor = value
                            elif name:
                                default[name] = value
                elif leaf == "trun" and len(body) >= 8:
                    flags, count = struct.unpack_from(">II", body)
                    flags, place = flags & 0xFFFFFF, 8
                    if flags & 1 and place + 4 <= len(body):
                        cursor = base + struct.unpack_from(">i", body, place)[0]
                        place += 4
                    first = None
                    if flags & 4 and place + 4 <= len(body):
                        first = struct.unpack_from(">I", body, place)[0]
                        place += 4
                    fields = [(n, f) for bit, n, f in ((0x100, "duration", ">I"), (0x200, "size", ">I"), (0x400, "flags", ">I"), (0x800, "cts", ">i")) if flags & bit]
                    for k in range(count):
                        row = dict(default, cts=0)
                        if first is not None and k == 0:
                            row["flags"] = first
                        if place + 4 * len(fields) > len(body):
                            break  # a run that is cut off keeps what it has
                        for name, form in fields:
                            row[name] = struct.unpack_from(form, body, place)[0]
                            place += 4
                        out.append((track, cursor, row["size"], row["duration"], not row["flags"] & 0x10000, row["cts"]))
                        cursor += row["size"]
    return out


def opened(path: str):  # noqa: ANN201
    """A file for ranged reads, and its size: of a mounted folder, or of a store that has an address."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    file = store.open_input_file(inner)
    return file, file.size()


def top_level(file, end: int) -> Iterator[tuple[str, int, int, int]]:  # noqa: ANN001
    """kind, place, header length and size of the top-level boxes of a file, of which only headers are read."""
    at = 0
    while at + 8 <= end:
        file.seek(at)
        head = file.read(min(16, end - at))
        size, kind = struct.unpack_from(">I4s", head)
        header = 8
        if size == 1 and len(head) == 16:
            size, header = struct.unpack_from(">Q", head, 8)[0], 16
        elif size == 0:
            size = end - at
        if size < header or at + size > end:
            return
        yield kind.decode("latin-1"), at, header, size
        at += size


class BoxPartition(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class BoxReader(DataSourceReader):
    """One task a file."""

    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]

    def partitions(self) -> list[BoxPartition]:
        return [BoxPartition(p) for p in self.paths]

    def read(self, partition: BoxPartition) -> Iterator[tuple]:
        file, end = opened(partition.path)
        with file:
            yield from self.rows(partition.path, file, end)

    def rows(self, path: str, file, end: int) -> Iterator[tuple]:  # noqa: ANN001
        for kind, at, _, size in top_level(file, end):
            yield path, kind, at, size


class MovieReader(BoxReader):
    def rows(self, path: str, file, end: int) -> Iterator[tuple]:  # noqa: ANN001
        kinds = []
        for kind, at, header, size in top_level(file, end):
            kinds.append(kind)
            if kind == "moov":
                if size - header > MAX_MOOV:
                    raise ValueError(f"'moov' box is implausibly large ({size - header} bytes); refusing to read")
                file.seek(at)
                yield path, at, file.read(size)
                return
        raise ValueError(f"No 'moov' box found — not a valid MP4. Top-level boxes: {', '.join(kinds) or 'none'}")


class FragmentReader(BoxReader):
    def rows(self, path: str, file, end: int) -> Iterator[tuple]:  # noqa: ANN001
        for n, (_, at, _, size) in enumerate(x for x in top_level(file, end) if x[0] == "moof"):
            if size > MAX_MOOF:
                raise ValueError(f"A 'moof' box at offset {at} is implausibly large ({size} bytes)")
            file.seek(at)
            yield path, n, at, file.read(size)


class BoxSource(DataSource):
    """spark.read.format("boxes").option("paths", "a.mp4,b.mp4"): path, kind, offset and size of the top-level boxes."""

    columns, kind = "path string, kind string, offset long, size long", BoxReader

    @classmethod
    def name(cls) -> str:
        return "boxes"

    def schema(self) -> str:
        return self.columns

    def reader(self, schema: object) -> BoxReader:
        return self.kind(self.options)


class MovieSource(BoxSource):
    """format("movies"): path, offset and content of each file's moov box, wherever it stands; a file without one is an error."""

    columns, kind = "path string, offset long, content binary", MovieReader

    @classmethod
    def name(cls) -> str:
        return "movies"


class FragmentSource(BoxSource):
    """format("fragments"): path, n, offset and content of every moof box, in order, without the media between them."""

    columns, kind = "path string, n long, offset long, content binary", FragmentReader

    @classmethod
    def name(cls) -> str:
        return "fragments"


def batches_of(batches: Iterator[pa.RecordBatch], rows: Callable[[bytes], list[tuple]], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What rows makes of the second column, with the first column before it: rows of many small files in a batch, those of one file always in the same."""
    found: list[tuple] = []
    n_bytes = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), types, strict=True)], schema=types)

    for batch in batches:
        for k in range(batch.num_rows):
            own, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or b""
            found += [(own, *r) for r in rows(data)]
            n_bytes += len(data)
            if found and (len(found) >= BATCH_ROWS or n_bytes >= BATCH_BYTES):
                yield made()
                found, n_bytes = [], 0
    if found:
        yield made()


def rows_of(files: DataFrame, key: str, content: str, schema: str, rows: Callable[[bytes], list[tuple]]) -> DataFrame:
    """key, and the columns of schema that rows makes of the content of each file."""
    kind = files.schema[key].dataType.simpleString()
    whole = f"`{key}` {kind}, {schema}"
    types = to_arrow_schema(files.sparkSession.createDataFrame([], whole).schema)
    return files.select(key, content).mapInArrow(lambda batches: batches_of(batches, rows, types), whole)


def fragments(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, n, track_id, offset, size, duration, is_sync and cts of each sample of the fragments of each file."""
    return rows_of(files, key, content, "n long, track_id long, offset long, size long, duration long, is_sync boolean, cts long", lambda data: [(n, *x) for n, x in enumerate(fragment_samples(data))])


def zip_entry_offsets(entries: DataFrame, key: str, order: str, name: str, size: str) -> DataFrame:
    """entries with the offset of each in a stored archive: 30 bytes, its name and its data for each before it."""
    from pyspark.sql import Window

    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    each = 30 + F.octet_length(name) + F.col(size)
    return entries.withColumn("__each", each.cast("long")).withColumn("offset", F.coalesce(F.sum("__each").over(before), F.lit(0)).cast("long")).drop("__each")


def read_samples(samples: DataFrame, window: int) -> DataFrame:
    """Samples (path, sample_idx, offset, size) with their data: one read of at most window bytes for each run of neighbours.

    The runs come from a fold over each file's samples; a read past the end of a file fails.
    """
    from tidemark.operators.segment import read_islands

    planned = read_islands(samples, "path", "sample_idx", window)
    names = planned.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(names.index(c)).to_pylist() for c in ("path", "island", "offset", "size")}
            data: list[bytes] = []
            at = 0
            while at < batch.num_rows:
                stop = at
                while stop < batch.num_rows and (columns["path"][stop], columns["island"][stop]) == (columns["path"][at], columns["island"][at]):
                    stop += 1
                first = columns["offset"][at]
                last = columns["offset"][stop - 1] + columns["size"][stop - 1]
                file, _ = opened(columns["path"][at])
                with file:
                    file.seek(first)
                    block = file.read(last - first)
                if len(block) < last - first:
                    raise EOFError(f"{columns['path'][at]} ends before {last}")
                data += [block[columns["offset"][k] - first : columns["offset"][k] - first + columns["size"][k]] for k in range(at, stop)]
                at = stop
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*names, "data"])

    return planned.mapInArrow(run, StructType([*planned.schema.fields, StructField("data", BinaryType())]))
