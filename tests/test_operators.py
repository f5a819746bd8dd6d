"""Folds, ladders, boxes, sinks and the streaming segmenter against plain Python."""

from __future__ import annotations

import random
import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fold, index, jobs, ladder, scan, segment, timeline
from tidemark.plans.catalogue import TARGET
from tidemark.sources import boxes, media, sinks, views
from tidemark.streaming import control
from tidemark.streaming.segmenter import Segmenter, stream_segments


def cut_plainly(durations, sync, target):
    out, seg, pending, n = [], 0, 0, 0
    for d, s in zip(durations, sync, strict=True):
        if s and n and pending >= target:
            seg, pending, n = seg + 1, 0, 0
        pending, n = pending + d, n + 1
        out.append(seg)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_keyframe_fold_in_batches(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 60)
    durations, sync, target = [rng.choice([0, 1, 3, 9]) for _ in range(n)], [rng.random() < 0.4 for _ in range(n)], rng.choice([1, 5, 12])
    step, state, out, at = fold.by_keyframe(target, "d", "s"), None, [], 0
    while at < n:
        k = rng.randint(1, 9)
        state, made = step(state, {"d": np.array(durations[at : at + k]), "s": np.array(sync[at : at + k])})
        out += made.tolist()
        at += k
    assert out == cut_plainly(durations, sync, target)


@pytest.mark.parametrize("seed", range(30))
def test_island_and_gap_folds_in_batches(seed):
    rng = random.Random(seed)
    offsets, sizes, at = [], [], 0
    for _ in range(rng.randint(1, 40)):
        at += rng.choice([0, 0, 0, 5])
        offsets.append(at)
        sizes.append(rng.randint(0, 30))
        at += sizes[-1]
    window, island, begin, end, plain = 60, -1, 0, None, []
    for o, s in zip(offsets, sizes, strict=True):
        if island < 0 or o != end or o + s - begin > window:
            island, begin = island + 1, o
        end = o + s
        plain.append(island)
    times = np.cumsum([rng.randint(0, 9) for _ in range(40)])
    last, forced = None, []
    for t in times:
        forced.append(int(last is None or t - last >= 12))
        last = t if forced[-1] else last
    for step, rows, wanted in ((fold.by_island(window, "o", "s"), {"o": np.array(offsets), "s": np.array(sizes)}, plain), (fold.by_gap(12, "t"), {"t": times}, forced)):
        state, out, k, n = None, [], 0, len(wanted)
        while k < n:
            m = rng.randint(1, 7)
            state, made = step(state, {c: v[k : k + m] for c, v in rows.items()})
            out += made.tolist()
            k += m
        assert out == wanted


def frames(spark, n, gop, duration):
    return spark.range(n).select(F.lit(1).cast("long").alias("track"), F.col("id").alias("sample_idx"), F.lit(duration).cast("long").alias("duration"), (F.col("id") % gop == 0).alias("is_sync"), F.lit(10).cast("long").alias("size"), (F.col("id") * duration).alias("us"))


@pytest.mark.parametrize(("n", "gop", "seconds", "duration", "count"), [(120, 30, 1, 3000, 4), (240, 120, 1, 3000, 2), (10, 5, 1, 0, 1), (6000, 30, 6, 3000, 34)])
def test_segment_counts(spark, n, gop, seconds, duration, count):
    found = segment.segments(frames(spark, n, gop, duration), seconds * 90_000)
    assert found.count() == count and found.agg(F.sum("n")).first()[0] == n


def test_ladder_goldens(spark):
    def plan(name, w, h, upscale=False):
        sources = spark.createDataFrame([(1, w, h)], "source long, width long, height long")
        rows = ladder.plan(sources, views.ladders(spark).filter(F.col("ladder") == name), upscale).orderBy(F.desc("height")).collect()
        return [(r["width"], r["height"], r["bitrate"]) for r in rows]

    assert [x[:2] for x in plan("standard", 1920, 1080)] == [(1920, 1080), (1280, 720), (854, 480)]
    assert [(x[1], x[2]) for x in plan("uhd", 1920, 1074)] == [(1074, 5_000_000), (720, 2_800_000)]
    assert [x[1] for x in plan("standard", 1920, 1074)] == [1074, 720, 480]
    assert [x[1] for x in plan("single", 1920, 1074)] == [720]
    assert [x[1] for x in plan("standard", 640, 360)] == [360]
    assert len(plan("standard", 640, 360, True)) == 3


@pytest.mark.parametrize(("w", "h", "level"), [(640, 480, 0x1E), (1280, 720, 0x1F), (1920, 1080, 0x28), (3840, 2160, 0x33), (9000, 9000, 0x34)])
def test_levels(spark, w, h, level):
    assert spark.range(1).select(ladder.level_for_frame(F.lit(w), F.lit(h))).first()[0] == level


def test_run_expansion_skips_empty_runs(spark):
    runs = spark.createDataFrame([(1, 0, 2, 100), (1, 1, 0, 7), (1, 2, 3, 200)], "t long, r long, n long, d long")
    found = index.expand_runs(runs, "t", "r", "n", "d").orderBy("sample_idx").collect()
    assert [(r[1], r[2]) for r in found] == [(0, 100), (1, 100), (2, 200), (3, 200), (4, 200)]


def test_boxes_round_trip_and_cut_off():
    samples = [(3000 + k, k % 4 == 0, k - 2, bytes([k]) * (k * 3 % 11)) for k in range(30)]
    data = boxes.media_segment(7, 2, 90_000, samples)
    found = boxes.fragment_samples(data)
    assert [(d, s, c, data[o : o + n]) for _, o, n, d, s, c in found] == samples and {x[0] for x in found} == {2}
    for cut in range(len(data)):
        list(boxes.walk_all(data[:cut]))
        boxes.fragment_samples(data[:cut])
        boxes.track_tables(data[:cut])


def test_movie_tables():
    import struct

    table = lambda kind, form, *rows: boxes.full_box(kind, 0, 0, struct.pack(">I", len(rows)), *(struct.pack(form, *r) for r in rows))
    stbl = boxes.box("stbl", table("stts", ">II", (2, 100), (3, 200)), table("stsc", ">III", (1, 2, 1), (3, 1, 1)), table("stco", ">I", (10_000,), (20_000,), (30_000,)), table("stss", ">I", (1,), (4,)), boxes.full_box("stsz", 0, 0, struct.pack(">II", 50, 5)))
    trak = boxes.box("trak", boxes.full_box("tkhd", 0, 0, struct.pack(">III", 0, 0, 9)), boxes.box("mdia", boxes.full_box("mdhd", 0, 0, struct.pack(">III", 0, 0, 90_000)), boxes.full_box("hdlr", 0, 0, struct.pack(">I4s", 0, b"vide")), boxes.box("minf", stbl)))
    (track,) = boxes.track_tables(boxes.box("ftyp", b"isom") + boxes.box("moov", trak))
    assert track == {"track_id": 9, "handler": "vide", "timescale": 90_000, "stts": [(2, 100), (3, 200)], "ctts": [], "stsc": [(1, 2, 1), (3, 1, 1)], "sizes": [50] * 5, "chunks": [10_000, 20_000, 30_000], "sync": [1, 4], "stsd": b""}


def test_box_source(spark, tmp_path):
    path = tmp_path / "a.mp4"
    path.write_bytes(boxes.media_segment(1, 1, 0, [(1, True, 0, b"abc")]))
    spark.dataSource.register(boxes.BoxSource)
    found = spark.read.format("boxes").option("paths", str(path)).load().orderBy("offset").collect()
    assert [r["kind"] for r in found] == ["styp", "moof", "mdat"]


def test_archives_and_uploads(spark, tmp_path):
    import io
    import zipfile

    rows = [(1, 0, "../a.txt", b"one"), (1, 1, "d/b.txt", b"two"), (2, 0, "c", b"")]
    outputs = spark.createDataFrame(rows, "job long, ord long, name string, data binary")
    parts = sinks.archive_parts(outputs, "job").orderBy("job", "part").collect()
    whole = {job: b"".join(bytes(r["bytes"]) for r in parts if r["job"] == job) for job in (1, 2)}
    archive = zipfile.ZipFile(io.BytesIO(whole[1]))
    assert archive.testzip() is None and [(n, archive.read(n)) for n in archive.namelist()] == [("a.txt", b"one"), ("d/b.txt", b"two")]
    assert zipfile.ZipFile(io.BytesIO(whole[2])).namelist() == ["c"]
    for limits in ({"entries": 1}, {"size": 40}):
        with pytest.raises(Exception, match="at most"):
            sinks.archive_parts(outputs, "job", **limits).collect()

    folder = str(tmp_path)

    def upload(name, data):
        if name == "c":
            raise sinks.PermanentUploadError("no")
        with open(f"{folder}/{name.replace('/', '_')}", "wb") as file:
            file.write(data)

    errors = {r["name"]: r["error"] for r in sinks.upload_all(outputs, upload).collect()}
    assert errors["c"].startswith("PermanentUploadError") and errors["d/b.txt"] is None
    assert (tmp_path / "d_b.txt").read_bytes() == b"two"


def test_retry_stops_at_permanent_errors():
    calls = []

    def flaky(key, data):
        calls.append(key)
        if len(calls) < 3:
            raise OSError("later")

    sinks.with_retry(flaky, "k", b"", 2, lambda _: None)
    assert len(calls) == 3
    with pytest.raises(sinks.PermanentUploadError):
        sinks.with_retry(lambda *_: (_ for _ in ()).throw(sinks.PermanentUploadError()), "k", b"", 5, lambda _: None)


def test_stream_equals_batch(spark, data, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    columns = ("track", "pos", "sample_idx", "duration", "is_sync", "size", "is_audio", "is_end")
    v = views.samples(spark, data).filter(F.col("track") % 10 == 3).withColumns({"is_end": F.lit(False), "is_audio": F.lit(False), "pos": F.col("sample_idx")}).select(*columns).cache()
    ends = v.groupBy("track").agg((F.max("sample_idx") + 1).alias("sample_idx")).withColumns({"pos": F.col("sample_idx"), "duration": F.lit(0).cast("long"), "size": F.lit(0).cast("long"), "is_sync": F.lit(False), "is_audio": F.lit(False), "is_end": F.lit(True)}).select(*columns)

    def run():
        stream = stream_segments(spark.readStream.schema(v.schema).parquet(source), TARGET)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    v.filter(F.col("sample_idx") < 5).coalesce(1).write.mode("append").parquet(source)
    run()
    v.filter(F.col("sample_idx") >= 5).union(ends).coalesce(1).write.mode("append").parquet(source)
    run()
    batch = segment.segments(views.samples(spark, data).filter(F.col("track") % 10 == 3), TARGET).select("track", "seg_idx", "first_sample", "n", "ticks", "bytes")
    assert sorted(map(tuple, spark.read.parquet(out).drop("n_audio", "audio_ticks", "audio_bytes").collect())) == sorted(map(tuple, batch.collect()))


def plain_segments(rows, target):
    """Segments of rows (duration, sync, size, audio, end), by the rules one row at a time."""
    out, seg, v, a = [], 0, [], []
    for k, (duration, sync, size, audio, end) in enumerate(rows):
        if v and (end or not audio and sync and sum(x[1] for x in v) >= target):
            out.append((seg, v[0][0], len(v), sum(x[1] for x in v), sum(x[2] for x in v), len(a), sum(x[0] for x in a), sum(x[1] for x in a)))
            seg, v, a = seg + 1, [], []
        if not end:
            a, v = (a + [(duration, size)], v) if audio else (a, v + [(k, duration, size)])
    return out


@pytest.mark.parametrize("seed", range(40))
def test_segmenter_keeps_audio_with_its_segment(seed):
    rng = random.Random(seed)
    rows = [(rng.choice([0, 2, 5]), rng.random() < 0.4, rng.randint(1, 9), rng.random() < (1 if k < 3 else 0.4), False) for k in range(rng.randint(1, 50))] + [(0, False, 0, False, True)]
    frame = pd.DataFrame(rows, columns=["duration", "is_sync", "size", "is_audio", "is_end"]).assign(sample_idx=range(len(rows)), pos=range(len(rows)))

    class Handle:
        def __init__(self):
            self.value = None

        def getValueState(self, *_):  # noqa: N802
            return self

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    cutter = Segmenter(9)
    cutter.init(Handle())
    out, at = [], 0
    while at < len(rows):
        k = rng.randint(1, 12)
        out += [tuple(r)[1:] for made in cutter.handleInputRows((1,), iter([frame.iloc[at : at + k]]), None) for r in made.itertuples(index=False)]
        at += k
    assert out == plain_segments(rows, 9)


def test_streams_report_and_stop(spark, data, tmp_path):
    v = views.samples(spark, data).filter(F.col("track") == 3).select("track", "sample_idx")
    v.repartition(3).write.parquet(str(tmp_path / "in"))
    query = control.run_through(control.pulled(spark, v.schema, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "state"))
    found = control.progress_rows(query).collect()
    assert sum(r["rows"] for r in found) == v.count() and len(found) >= 3 and {r["phase"] for r in found} == {"done"}
    with control.cancellable(spark, "slow"):
        worker = threading.Thread(target=lambda: (time.sleep(3), control.cancel(spark, "slow")))
        worker.start()
        with pytest.raises(Exception, match="(?i)cancel"):
            spark.range(8).repartition(4).mapInPandas(lambda frames: (f.assign(id=time.sleep(20) or 1) for f in frames), "id long").count()
        worker.join()


def test_durable_writes_before_its_checkpoint():
    calls = []
    sinks.durable(lambda f: calls.append(("write", f)), lambda f: calls.append(("checkpoint", f)))("frame", 4)
    assert calls == [("write", "frame"), ("checkpoint", "frame")]


def test_movies_and_fragments_are_read_without_their_media(spark, tmp_path):
    video = media.VideoEntry("avc1", 64, 48, bytes(20))
    movie = media.movie(10, video, [(8, 4, 5, True, 0), (12, 4, 5, False, 0)])
    good, bad, pieces = (tmp_path / n for n in ("good.mp4", "bad.mp4", "pieces.mp4"))
    good.write_bytes(movie[: movie.index(b"moov") - 4] + boxes.box("mdat", bytes(5000)) + movie[movie.index(b"moov") - 4 :])
    bad.write_bytes(boxes.box("ftyp", b"x") + boxes.box("mdat", bytes(9)))
    pieces.write_bytes(b"".join(boxes.media_segment(k, 1, 0, [(1, True, 0, b"abc" * k)]) for k in (1, 2, 3)))
    for source in (boxes.MovieSource, boxes.FragmentSource):
        spark.dataSource.register(source)
    load = lambda kind, path: spark.read.format(kind).option("paths", str(path)).load()
    tracks = media.movies(load("movies", good), "path")
    assert [(r["width"], r["height"], r["sizes"], r["sync"]) for r in tracks.collect()] == [(64, 48, [4, 4], [1])]
    assert media.inspected(tracks, "path").first()["error"] is None
    with pytest.raises(Exception, match="Top-level boxes: ftyp, mdat"):
        load("movies", bad).collect()
    found = load("fragments", f"{pieces},{good}").orderBy("path", "n").collect()
    assert [(r["n"], bytes(r["content"][4:8])) for r in found] == [(k, b"moof") for k in range(3)]
    assert [r["size"] for r in boxes.fragments(load("fragments", pieces).withColumnRenamed("offset", "at"), "at").orderBy("at").collect()] == [3, 6, 9]


def test_limits_of_boxes(monkeypatch, tmp_path):
    import struct

    stsz = boxes.full_box("stsz", 0, 0, struct.pack(">II", 7, 0xFFFFFFFF))
    with pytest.raises(ValueError, match="more samples"):
        boxes.track_tables(boxes.box("moov", boxes.box("trak", boxes.box("mdia", boxes.box("minf", boxes.box("stbl", stsz))))))
    deep = b""
    for _ in range(3000):
        deep = boxes.box("moov", deep)
    assert max(d for _, d, *_ in boxes.walk_all(deep)) == 2999
    path = tmp_path / "a.mp4"
    path.write_bytes(boxes.box("moov", bytes(100)) + boxes.box("moof", bytes(100)))
    for name, reader in (("MAX_MOOV", boxes.MovieReader), ("MAX_MOOF", boxes.FragmentReader)):
        monkeypatch.setattr(boxes, name, 50)
        with pytest.raises(ValueError, match="implausibly large"):
            list(reader({"paths": str(path)}).read(boxes.BoxPartition(str(path))))


def test_sample_rows_of_odd_tables(spark):
    pairs, triples = "array<struct<a: long, b: long>>", "array<struct<a: long, b: long, c: long>>"
    schema = f"k long, stts {pairs}, ctts {pairs}, stsc {triples}, sizes array<long>, chunks array<long>, sync array<long>"
    rows = [
        (1, [(2, 7), (0, 9), (1, 8)], [], [(1, 2, 1), (3, 1, 1)], [10, 20, 30, 40, 50], [100, 200, 300], [4, 1, 4]),
        (2, [(9, 1)], [(1, -5)], [(2, 1, 1)], [5, 6], [1000, 2000, 3000], None),
        (3, [], [], [], [5], [], []),
        (4, [], [], [], [], [], None),
    ]
    found = index.sample_rows(spark.createDataFrame(rows, schema), "k").orderBy("k", "sample_idx").select("k", "sample_idx", "offset", "size", "duration", "is_sync", "cts").collect()
    assert list(map(tuple, found)) == [
        (1, 0, 100, 10, 7, True, 0), (1, 1, 110, 20, 7, False, 0), (1, 2, 200, 30, 8, False, 0), (1, 3, 230, 40, 0, True, 0), (1, 4, 300, 50, 0, False, 0),
        (2, 0, 2000, 5, 1, True, -5), (2, 1, 3000, 6, 1, True, 0), (3, 0, 0, 5, 0, False, 0),
    ]
    with pytest.raises(Exception, match="more than 4 samples"):
        index.sample_rows(spark.createDataFrame(rows, schema), "k", most=4).collect()


def test_runs_beyond_the_limit_fail(spark):
    runs = spark.createDataFrame([(1, 0, 4, 100), (1, 1, 3, 7)], "t long, r long, n long, d long")
    assert index.expand_runs(runs, "t", "r", "n", "d", 7).count() == 7
    with pytest.raises(Exception, match="more than 6 samples of 1"):
        index.expand_runs(runs, "t", "r", "n", "d", 6).collect()


def test_as_of_without_times_and_with_clashing_names(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, None, "b"), (2, 5, "c")], "k long, t long, v string")
    right = spark.createDataFrame([(1, 4, "x"), (1, None, "y")], "k long, t long, v string")
    for found in (f(left, right, "k", "t", ["v"], span=s) for f in (timeline.as_of, timeline.nearest) for s in (None, 2)):
        assert {r["v"]: r["v_found"] for r in found.collect()} == {"a": "x", "b": None, "c": None}


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_blocks_of_a_key_do_not_change_a_result(spark, span):
    rng = random.Random(span)
    left = spark.createDataFrame([(rng.randint(0, 2), rng.randint(-50, 50), k) for k in range(150)], "k long, t long, n long")
    times = [(k, t) for k in (0, 1) for t in rng.sample(range(-45, 46), 9)]
    right = spark.createDataFrame([(k, t, 1000 * k + t) for k, t in times], "k long, t long, v long")
    for strict in (False, True):
        found = {r["n"]: r["v"] for r in timeline.as_of(left, right, "k", "t", ["v"], strict, span=span).collect()}
        past = lambda k, t: [s for j, s in times if j == k and (s < t or s == t and not strict)]  # noqa: B023, E731
        assert found == {r["n"]: 1000 * r["k"] + max(past(r["k"], r["t"])) if past(r["k"], r["t"]) else None for r in left.collect()}
    plain, blocks = ({tuple(r) for r in timeline.nearest(left, right, "k", "t", ["v"], s).collect()} for s in (None, span))
    assert plain == blocks
    plain, blocks = ({tuple(r) for r in timeline.merge(left, right.withColumnRenamed("v", "n"), "t", "k", "n", span=s).select("k", "t", "n", "rank", "pos").collect()} for s in (None, span))
    assert plain == blocks
    totals = scan.running_sum(left.dropDuplicates(["k", "t"]), "k", "t", "n", "s", span)
    ordered = scan.after_previous(scan.counted(left.dropDuplicates(["k", "t"]), "k", "t", F.col("n") % 3 == 0, "g", span), "k", "t", F.col("n"), "p", span).orderBy("k", "t").collect()
    groups, before = {}, {}
    for r in ordered:
        groups[r["k"]] = groups.get(r["k"], 0) + (r["n"] % 3 == 0)
        assert (r["g"], r["p"]) == (groups[r["k"]], before.get(r["k"]))
        before[r["k"]] = r["n"]
    rows = totals.collect()
    assert all(r["s"] == sum(x["n"] for x in rows if x["k"] == r["k"] and x["t"] < r["t"]) for r in rows)


@pytest.mark.parametrize(("ticks", "scale", "us"), [(4_500_000_000_001, 3, 1_500_000_000_000_333_333), (10**13, 1_000_000, 10**13), (1, 3, 333_333), (2, 3, 666_667), (-1, 2, -500_000), (1, 2_000_000, 1), (0, 1, 0)])
def test_time_scales_are_exact(spark, ticks, scale, us):
    assert spark.range(1).select(timeline.ticks_to_us(F.lit(ticks).cast("long"), scale)).first()[0] == us


def test_ladders_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ladder, "MAX_RUNGS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        ladder.plan(spark.createDataFrame([(1, 10, 10)], "source long, width long, height long"), views.ladders(spark))


def test_resumable_jobs_over_several_hours(spark):
    rows = [(k, "processing" if k % 4 else "done", (k * 7919 % 50) * 1_800_000_000) for k in range(80)]
    found = {r["job_id"]: r["rank"] for r in jobs.resumable(spark.createDataFrame(rows, "job_id long, status string, updated_at long")).collect()}
    order = sorted((r for r in rows if r[1] == "processing"), key=lambda r: (-r[2], r[0]))
    assert found == {r[0]: n for n, r in enumerate(order, 1)}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Some

    from tidemark.session import shared_folder

    make = lambda folder, master: Some(sparkContext=Some(getCheckpointDir=lambda: None, getConf=lambda: Some(get=lambda _: folder), master=master))
    assert shared_folder(make("/shared", "spark://cluster:7077")) == "/shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(make(None, "spark://cluster:7077"))
