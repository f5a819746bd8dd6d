"""Descriptors, entries, init segments, validation and ranged reads."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators import validate
from tidemark.plans import packaging, packaging_sql
from tidemark.sources import boxes, media

VIDEO = media.VideoEntry("avc1", 1280, 720, bytes.fromhex("0142c01effe1000467420a1e01000468ce3c80"))
AUDIO = media.Aac(2, 44_100, 2, bytes([0x12, 0x10]))


def test_init_segment_reads_back():
    data = media.init_segment(90_000, VIDEO, AUDIO)
    assert [k for k, *_ in boxes.walk(data)] == ["ftyp", "moov"] and sum(s for *_, s in boxes.walk(data)) == len(data)
    entries = [data[at + h : at + s] for path, _, at, h, s in boxes.walk_all(data) if path.endswith("/stsd")]
    assert media.video_entry(entries[0]) == VIDEO and media.aac(entries[1][8:]) == AUDIO
    assert [(t["track_id"], t["handler"], t["timescale"]) for t in boxes.track_tables(data)] == [(1, "vide", 90_000), (2, "soun", 44_100)]
    assert media.track_defaults(data) == [(1, 0, 0, 0), (2, 0, 0, 0)] and media.is_fragmented(data, 0) and not media.is_fragmented(data, 3)
    for cut in range(len(data)):
        boxes.track_tables(data[:cut])
        media.track_defaults(data[:cut])
    for entry in entries:
        for cut in range(len(entry)):
            media.video_entry(entry[:cut])
            media.aac(entry[8:cut])


def test_small_files_share_a_batch():
    """A batch for each file cost more than reading it; a large file still goes out at once."""
    types = pa.schema([("k", pa.int64()), ("path", pa.string())])
    read = lambda data: [(path,) for path, *_ in boxes.walk_all(data)]
    given = lambda contents: iter([pa.record_batch([pa.array([k]), pa.array([c], pa.binary())], names=["k", "content"]) for k, c in enumerate(contents)])
    contents = [None, b"", *[media.init_segment(90_000, VIDEO, AUDIO if k % 2 else None) for k in range(1000)]]
    found = list(boxes.batches_of(given(contents), read, types))
    assert len(found) < 20 and all(b.num_rows < boxes.BATCH_ROWS + 100 for b in found)
    assert pa.Table.from_batches(found).to_pylist() == [{"k": k, "path": p} for k, c in enumerate(contents) for p, *_ in boxes.walk_all(c or b"")]
    large = boxes.box("free", bytes(boxes.BATCH_BYTES))
    assert [b.num_rows for b in boxes.batches_of(given([contents[2], large, contents[2], large]), read, types)] == [len(read(contents[2])) + 1] * 2


def test_init_segments_are_dealt_to_tasks_and_made_once(spark, tmp_path):
    parts = [(1, 5), (2, 6), (2, 7), (2, 7), (None, 8), *((k, k % 50 + 1) for k in range(10, 400))]
    spark.createDataFrame(parts, "p_partkey long, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = packaging.init_segments(spark, str(tmp_path))
    tasks = found.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) == 4 and max(t["count"] for t in tasks) < 2 * min(t["count"] for t in tasks)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    wanted = sql.execute(packaging_sql.ORACLE["init_segments"])
    columns = [c[0] for c in wanted.description]
    assert sorted(map(repr, map(tuple, found.select(columns).collect()))) == sorted(map(repr, wanted.fetchall()))


def test_a_movie_is_made_and_read_once(spark, data):
    """Its facts came from two readings and a join; rows of a track without video or audio still give an answer."""
    info = packaging.QUERIES["movie_info"](spark, data)
    assert info._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    rows = [("a", media.movie(10, VIDEO, [(8, 4, 5, True, 0)])), ("b", media.init_segment(10, VIDEO, AUDIO)), ("c", media.init_segment(10, VIDEO).replace(b"avcC", b"xxxx")), ("d", b"")]
    tracks = media.movies(spark.createDataFrame(rows, "path string, content binary"), "path")
    assert {(r["path"], r["role"]) for r in media.chosen(tracks, "path").collect()} == {("a", "video"), ("b", "video"), ("b", "audio")}
    assert {r["path"]: (r["error"], r["has_audio"]) for r in media.inspected(tracks, "path").collect()} == {"a": (None, False), "b": ("no_samples", True), "c": ("no_video", False)}


@pytest.mark.parametrize("n", [0, 1, 127, 128, 16_383, 16_384, 2_097_152])
def test_lengths(spark, n):
    written = media.write_length(n)
    assert media.read_length(written, 0) == (n, len(written))
    found = spark.range(1).select(names.descriptor_length(F.lit(n)), names.length_of_descriptor(F.lit(written + b"x")), names.length_of_descriptor(F.lit(written[:-1]))).first()
    assert bytes(found[0]) == written and found[1] == n and found[2] is None


def test_validation(spark):
    rows = [(90_000, 1280, 720, b"abcd", 6.0, None), (0, 1, 1, b"abcd", 6.0, "timescale"), (1, 0, 1, b"abcd", 6.0, "dimensions"), (1, 1, 20_000, b"abcd", 6.0, "dimensions"), (1, 1, 1, b"a", 6.0, "codec_config"), (1, 1, 1, b"abcd", float("nan"), "target"), (1, 1, 1, b"abcd", float("inf"), "target")]
    df = spark.createDataFrame(rows, "t long, w long, h long, c binary, s double, wanted string")
    assert all(r[0] == r[1] for r in df.select(validate.config_error(*map(F.col, "twhcs")), "wanted").collect())
    assert [r[0] for r in spark.createDataFrame([(1.5,), (-1.0,), (float("nan"),), (float("inf"),)], "d double").select(validate.clean_duration(F.col("d"))).collect()] == [1.5, 0.0, 0.0, 0.0]


def test_limits_fail(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k long, x long")
    assert validate.at_most(df, "k", 2).count() == 3
    with pytest.raises(Exception, match="more than 1"):
        validate.at_most(df, "k", 1).collect()


def test_a_failing_job_is_a_row(spark):
    def work(job):
        if job["job_id"] == 2:
            raise ValueError("broken")

    found = {r["job_id"]: (r["status"], r["error"]) for r in validate.run_jobs(spark.range(1, 4).withColumnRenamed("id", "job_id"), work).collect()}
    assert found == {1: ("done", None), 2: ("failed", "ValueError: broken"), 3: ("done", None)}


def test_reads_neighbours_at_once(spark, tmp_path):
    path = tmp_path / "data"
    path.write_bytes(bytes(range(200)))
    rows = [(str(path), 0, 10, 5), (str(path), 1, 15, 5), (str(path), 2, 40, 3), (str(path), 3, 43, 60)]
    df = spark.createDataFrame(rows, "path string, sample_idx long, offset long, size long")
    found = sorted((r["sample_idx"], bytes(r["data"]), r["island"]) for r in boxes.read_samples(df, 50).collect())
    assert [x[1] for x in found] == [bytes(range(o, o + n)) for _, _, o, n in rows] and [x[2] for x in found] == [0, 0, 1, 2]
    with pytest.raises(Exception, match="ends before"):
        boxes.read_samples(spark.createDataFrame([(str(path), 0, 190, 20)], df.schema), 50).collect()


def test_little_is_read_beyond_the_media(spark, tmp_path):
    """Headers and the movie box are read without the media, and samples in runs without gaps between them."""
    media_bytes, samples, at = b"", [], 40
    for k in range(600):
        size = 100 + k % 13 * 7
        samples.append((at, size, 3000, k % 30 == 0, 0))
        at += size
        media_bytes += bytes(size)
    movie = media.movie(90_000, VIDEO, samples, per_chunk=5)
    path = tmp_path / "whole.mp4"
    path.write_bytes(boxes.box("ftyp", bytes(24)) + boxes.box("mdat", media_bytes) + movie[movie.index(b"moov") - 4 :])

    class Counted:
        def __init__(self, file):
            self.file, self.bytes = file, 0

        def seek(self, to):
            self.file.seek(to)

        def read(self, n):
            got = self.file.read(n)
            self.bytes += len(got)
            return got

    with open(path, "rb") as file:
        counted = Counted(file)
        (found,) = boxes.MovieReader({}).rows(str(path), counted, path.stat().st_size)
    assert counted.bytes <= len(found[2]) + 16 * 3
    rows = spark.createDataFrame([(str(path), k, o, n) for k, (o, n, *_) in enumerate(samples)], "path string, sample_idx long, offset long, size long")
    read = boxes.read_samples(rows, 4 << 20)
    runs = read.groupBy("path", "island").agg((F.max(F.col("offset") + F.col("size")) - F.min("offset")).alias("bytes"))
    assert runs.agg(F.sum("bytes")).first()[0] == len(media_bytes) and runs.count() == 1
