"""Sinks: uploads as a callable for every output, archives, and the order in which they become durable."""

from __future__ import annotations

import random
import struct
import time
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import zip_safe_name
from tidemark.model import MAX_ZIP_BYTES, MAX_ZIP_ENTRIES

Upload = Callable[[str, bytes], None]


class PermanentUploadError(Exception):
    """Trying again can't help."""


def with_retry(upload: Upload, key: str, data: bytes, retries: int = 2, sleep: Callable[[float], None] = time.sleep) -> None:
    """Upload, waiting a random time under a doubling ceiling between tries."""
    for attempt in range(retries + 1):
        try:
            return upload(key, data)
        except PermanentUploadError:
            raise
        except Exception:
            if attempt == retries:
                raise
            sleep(random.random() * min(300 * 2**attempt, 10_000) / 1000)
    return None


def upload_all(outputs: DataFrame, upload: Upload, retries: int = 2, sleep: Callable[[float], None] = time.sleep, request: str | None = None) -> DataFrame:
    """name and error (null if it went well) of each output (name, data); one failing doesn't stop the others.

    upload must write the same name over: a task that is run again uploads again. With request (a column of
    sources/adapters.py), upload gets that, as a dict, in place of the name.
    """
    columns = ["name", "data", *([request] if request else [])]

    def run(frames):  # noqa: ANN001, ANN202
        for frame in frames:
            errors = []
            for name, data, target in zip(frame["name"], frame["data"], frame[columns[-1] if request else "name"], strict=True):
                try:
                    with_retry(upload, target, bytes(data), retries, sleep)
                    errors.append(None)
                except Exception as error:  # noqa: BLE001
                    errors.append(f"{type(error).__name__}: {error}")
            yield pd.DataFrame({"name": frame["name"], "error": errors})

    return outputs.select(*columns).mapInPandas(run, "name string, error string")


def archive_parts(outputs: DataFrame, key: str, entries: int = MAX_ZIP_ENTRIES, size: int = MAX_ZIP_BYTES) -> DataFrame:
    """key, part, offset, name and bytes of a stored (uncompressed) archive of each key's outputs (ord, name, data), to be joined in order.

    One part for each output and one for the directory at the end, written in one pass with a running offset: a task
    holds one output and the directory so far. Names are made safe, and outputs without a safe one are left out. More than entries
    outputs, or more than size bytes, are errors, as the format can't hold them.
    """
    kind = outputs.schema[key].dataType.simpleString()
    named = outputs.select(key, "ord", zip_safe_name(F.col("name")).alias("name"), "data").filter(F.col("name").isNotNull())
    dealt = named.repartition(key).sortWithinPartitions(key, "ord", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, directory, at, part, begun = None, [], 0, 0, False

        def row(name: str | None, data: bytes) -> pa.RecordBatch:
            columns = (pa.array([current], kind_of), pa.array([part], pa.int64()), pa.array([at], pa.int64()), pa.array([name], pa.string()), pa.array([data], pa.binary()))
            return pa.RecordBatch.from_arrays(list(columns), names=[key, "part", "offset", "name", "bytes"])

        def end() -> bytes:
            whole = b"".join(directory)
            if at + len(whole) > size:
                raise ValueError(f"an archive holds at most {size} bytes")
            return whole + struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, len(directory), len(directory), len(whole), at, 0)

        for batch in batches:
            kind_of = batch.column(0).type
            for k in range(batch.num_rows):
                this, _, name, data = (batch.column(c)[k].as_py() for c in range(4))
                if begun and this != current:
                    yield row(None, end())
                    directory, at, part = [], 0, 0
                current, begun = this, True
                label, data = name.encode(), data or b""
                if len(directory) >= entries:
                    raise ValueError(f"an archive holds at most {entries} entries")
                if len(data) > size or at > size:
                    raise ValueError(f"an archive holds at most {size} bytes")
                # Version 1.0, names in UTF-8, method 0, the first day that the format knows.
                facts = struct.pack("<3H2H3I2H", 10, 0x800, 0, 0, 0x21, zlib.crc32(data), len(data), len(data), len(label), 0)
                local = b"PK\3\4" + facts + label + data
                directory.append(b"PK\1\2" + struct.pack("<H", 10) + facts + struct.pack("<3H2I", 0, 0, 0, 0, at) + label)
                yield row(name, local)
                at, part = at + len(local), part + 1
        if begun:
            yield row(None, end())

    return dealt.mapInArrow(run, f"`{key}` {kind}, part long, offset long, name string, bytes binary")


def durable(write: Callable[[DataFrame], None], checkpoint: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: outputs first, then their checkpoint."""

    def batch(frame: DataFrame, _: int) -> None:
        write(frame)
        checkpoint(frame)

    return batch
