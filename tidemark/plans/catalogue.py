"""One query for each operator, over the star-schema tables as sources/views.py reads them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import checksums, names
from tidemark.operators import index, jobs, ladder, manifest, scan, segment, timeline
from tidemark.session import table
from tidemark.sources import boxes, views

DAY = 86_400_000_000
TARGET = 2 * DAY
TIMESCALE = 1_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


# Indexes


@query
def sample_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.samples(spark, sf_dir)
    return index.decode_times(v.select("track", "sample_idx", "duration", "is_sync", "size"))


@query
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum("duration")
    rate = F.floor((F.count("*") * 2 * TIMESCALE * 86400 + total) / (2 * total)).cast("long")
    return views.samples(spark, sf_dir).groupBy("track").agg(
        F.count("*").alias("n"), F.sum("size").cast("long").alias("bytes"), total.cast("long").alias("ticks"), F.count_if("is_sync").alias("keyframes"),
        F.when(total > 0, F.when(rate == 0, 30).otherwise(rate)).otherwise(30).cast("long").alias("samples_per_day"),
    )


@query
def gop_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = scan.counted(views.samples(spark, sf_dir), "track", "sample_idx", F.col("is_sync"), "gop", index.SPAN)
    return v.groupBy("track", "gop").agg(F.sum("duration").cast("long").alias("ticks"), F.count("*").alias("n"))


@query
def rle_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("long").alias("count"))
    return index.expand_runs(runs, "p_brand", "p_partkey", "count", "p_partkey")


@query
def chunk_run_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("key"), F.col("c_custkey").alias("chunk"))
    runs = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("key"), (F.col("s_suppkey") * 10).alias("chunk"), F.col("s_suppkey").alias("run"))
    return index.covering_runs(chunks, runs, "key", "chunk", "run").withColumn("run", F.coalesce("run", F.lit(-1)).cast("long"))


@query
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.samples(spark, sf_dir).withColumn("chunk", F.floor(F.col("sample_idx") / 8).cast("long")).withColumn("base", F.col("chunk") * 1_000_000)
    return v.select("track", "sample_idx", "chunk", index.chunk_offsets(v, "track", "chunk", "sample_idx", "base", "size").alias("offset"))


@query
def run_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.samples(spark, sf_dir).withColumn("base", F.lit(1000).cast("long")).withColumn("data_offset", F.when(F.col("event_type") == "purchase", F.col("sample_idx") * 100))
    return index.run_offsets(v, "track", "sample_idx", "base", "data_offset", "size").select("track", "sample_idx", "offset")


@query
def sync_membership_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") > 45).select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(late, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query
def sync_membership_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") > 10).select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(late, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query
def sync_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.samples(spark, sf_dir).withColumn("has_table", F.col("track") % 3 != 0).drop("is_sync")
    listed = views.samples(spark, sf_dir).filter("is_sync").select("track", "sample_idx")
    return index.sync_membership(v, listed, "track", "sample_idx", "has_table").select("track", "sample_idx", "is_sync")


@query
def defaults_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a line, its part and nothing: the first value that is set."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.nullif(F.col("l_quantity").cast("long") % 3, F.lit(0)).alias("own"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.nullif(F.col("p_size").cast("long") % 2, F.lit(0)).alias("default"))
    return lines.join(parts, "l_partkey", "left").groupBy("l_orderkey").agg(F.sum(index.cascade("own", "default")).cast("long").alias("total"), F.count("*").alias("n"))


# Segments


@query
def segment_keyframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segments(views.samples(spark, sf_dir), TARGET).select("track", "seg_idx", "first_sample", "n", "ticks", "bytes")


@query
def segment_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = segment.with_base_times(segment.segments(views.samples(spark, sf_dir), TARGET))
    return cut.select("track", "seg_idx", "base", (F.col("base") + F.col("ticks")).alias("until"), "ticks")


@query
def segment_target_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = segment.segments(views.samples(spark, sf_dir), TARGET)
    longest = F.max("ticks")
    return cut.groupBy("track").agg(F.lit(TARGET).alias("declared"), longest.alias("longest"), (longest <= TARGET).alias("target_ok"), F.count("*").alias("n"))


@query
def resume_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.samples(spark, sf_dir)
    done = segment.segments(v, TARGET).filter(F.col("seg_idx") < 3)
    return segment.resumed_segments(v, done, TARGET).select("track", "seg_idx", "first_sample", "n", "ticks", "bytes")


@query
def resume_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.samples(spark, sf_dir)
    skip = F.greatest(F.col("track") % 40 - 5, F.lit(0))
    return v.filter(F.col("sample_idx") >= skip).select("track", "sample_idx", "us")


@query
def forced_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.forced_keyframes(views.samples(spark, sf_dir), DAY).select("track", "sample_idx", "us")


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.samples(spark, sf_dir)
    before = Window.partitionBy("track").orderBy("sample_idx").rowsBetween(Window.unboundedPreceding, -1)
    step = F.col("size") + F.when(F.col("event_type") == "error", 7).otherwise(0)
    return v.withColumn("__step", step).withColumn("offset", F.coalesce(F.sum("__step").over(before), F.lit(0)).cast("long")).select("track", "sample_idx", "offset", "size")


@query
def read_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.read_islands(_ranges(spark, sf_dir), "track", "sample_idx")
    return found.groupBy("track", "island").agg(F.min("offset").alias("offset"), F.sum("size").cast("long").alias("bytes"), F.count("*").alias("n"))


@query
def read_islands_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.read_islands(_ranges(spark, sf_dir), "track", "sample_idx", 20_000)
    return found.groupBy("track", "island").agg(F.min("offset").alias("offset"), F.sum("size").cast("long").alias("bytes"), F.count("*").alias("n"))


@query
def checkpoint_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that every type of event of a tenth of the users has, from the first on without a gap."""
    v = views.samples(spark, sf_dir).select((F.col("track") % 10).alias("job"), "event_type", F.floor((F.col("us") - 1_704_067_200_000_000) / DAY).cast("long").alias("seg"))
    return segment.finished_by_all(v, "job", "event_type", "seg", 5)


# Time


def _video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.samples(spark, sf_dir).filter(F.col("event_type") != "click")


def _audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.samples(spark, sf_dir).filter(F.col("event_type") == "click")


@query
def merge_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("track", "us", "event_id")
    return timeline.merge(_video(spark, sf_dir).select(*columns), _audio(spark, sf_dir).select(*columns), "us", "track", "event_id", span=DAY).select("track", "pos", "us", "event_id", F.col("rank").cast("long").alias("rank"))


@query
def audio_asof_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = segment.segments(_video(spark, sf_dir), TARGET).select("track", F.col("start_us").alias("us"), "seg_idx")
    found = timeline.as_of(_audio(spark, sf_dir).select("track", "us", "event_id"), cut, "track", "us", ["seg_idx"], strict=True, span=DAY)
    return found.select("track", "event_id", F.coalesce("seg_idx", F.lit(0)).cast("long").alias("seg_idx"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = views.samples(spark, sf_dir).select("track").distinct()
    first = 1_704_067_200_000_000
    return tracks.select("track", F.explode(F.sequence(F.lit(first), F.lit(first + 29 * DAY), F.lit(DAY))).alias("us"))


@query
def sync_at_or_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    sync = views.samples(spark, sf_dir).filter("is_sync").select("track", "us", "sample_idx")
    return timeline.as_of(_targets(spark, sf_dir), sync, "track", "us", ["sample_idx"], span=DAY).select("track", "us", F.coalesce("sample_idx", F.lit(0)).cast("long").alias("sample_idx"))


@query
def nearest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.nearest(_targets(spark, sf_dir), views.samples(spark, sf_dir).select("track", "us", "sample_idx"), "track", "us", ["sample_idx"], span=DAY)


@query
def ticks_to_micros(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("ticks"))
    return o.select("o_orderkey", timeline.ticks_to_us(F.col("ticks"), F.lit(90_000)).alias("us"))


@query
def frame_rung_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rungs = views.ladders(spark).filter(F.col("ladder") == "standard").select("height", "bitrate")
    each = views.samples(spark, sf_dir).crossJoin(F.broadcast(rungs))
    return each.groupBy("track", "height").agg(F.count("*").alias("frames"), F.sum(F.floor(F.col("bitrate") / 30)).cast("long").alias("bits"))


# Ladders


@query
def level_for_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.media_sources(spark, sf_dir).select("source", ladder.level_for_frame(F.col("width"), F.col("height")).alias("level"))


@query
def ladder_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.plan(views.media_sources(spark, sf_dir), views.ladders(spark))


@query
def ladder_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder.ladder_key(views.ladders(spark))


@query
def fit_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    width, height = ladder.fit(F.col("width"), F.col("height"), 640)
    return views.media_sources(spark, sf_dir).select("source", width.alias("width"), height.alias("height"))


@query
def sprite_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("count"), F.round(F.col("p_retailprice") * 1000).cast("long").alias("duration"))
    return ladder.sprite(v, "count", "duration", "p_partkey")


# Manifests


def _playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = segment.segments(views.samples(spark, sf_dir), TARGET)
    return manifest.media_playlist(cut, "track", F.concat(F.lit("t"), F.col("track").cast("string")), 172_800, TIMESCALE)


@query
def media_playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _playlists(spark, sf_dir)


def _masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = ladder_plan(spark, sf_dir).filter(F.col("ladder") == "wide")
    name = F.concat(F.lit("s"), F.col("source").cast("string"), F.lit("_"), F.col("height").cast("string"), F.lit("p.m3u8"))
    rungs = plan.select("source", "width", "height", "bitrate", F.lit("avc1.4d401f,mp4a.40.2").alias("codecs"), name.alias("uri"))
    return manifest.master_playlist(rungs, "source")


@query
def master_playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masters(spark, sf_dir)


@query
def playlist_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.references(_playlists(spark, sf_dir), "track")


@query
def rewrite_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    playlists = _playlists(spark, sf_dir)
    known = manifest.references(playlists, "track").filter(F.col("n") % 2 == 0)
    urls = known.select("track", "name", F.concat(F.lit("https://cdn.example/"), F.col("name"), F.lit("?v=1")).alias("url"))
    return manifest.rewrite(playlists, urls, "track")


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, "en", 'Eng"lish', True, True, False), (1, "pt-BR", "Português", False, True, False), (2, "??", "Signs", False, False, True)]
    return spark.createDataFrame(rows, "ord long, language string, name string, is_default boolean, autoselect boolean, forced boolean")


@query
def attach_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    masters = _masters(spark, sf_dir)
    tracks = masters.select("source").filter(F.col("source") % 2 == 0).crossJoin(F.broadcast(_tracks(spark, sf_dir)))
    return manifest.attach_subtitles(masters, tracks, "source", "video")


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = lambda s: F.format_string("%02d:%02d:%02d,000", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    start = F.col("turn") * 2
    cue = F.concat((F.col("turn") + 1).cast("string"), F.lit("\r\n"), clock(start), F.lit(" --> "), clock(start + 2), F.lit("\r\n"), F.col("text"), F.lit("\r\n"))
    lines = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", cue.alias("cue")).alias("c"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["cue"]), "\r\n")
    return lines.groupBy("conv_id").agg(body.alias("srt"))


@query
def srt_to_vtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cues(spark, sf_dir).select("conv_id", names.to_vtt(F.col("srt")).alias("vtt"))


@query
def subtitle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = _cues(spark, sf_dir).select("conv_id", F.element_at(F.array(F.lit("en"), F.lit("de-AT"), F.lit("!!")), (F.col("conv_id") % 3 + 1).cast("int")).alias("language"), F.col("srt").alias("content"))
    return manifest.subtitle_files(tracks, "video", 61_250).select("conv_id", "name", "text", "content_type", "is_manifest")


# Names


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url")


@query
def sanitize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("page_id", names.sanitize_key(F.col("url")).alias("key"), names.sanitize_key(F.concat(F.lit("..!./"), F.repeat("url", 4))).alias("long_key"))


@query
def safe_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", "://[^/]*(.*)$", 1)
    return _urls(spark, sf_dir).select("page_id", names.is_safe_key(F.col("url")).alias("url_safe"), names.is_safe_key(path).alias("path_safe"), names.is_safe_key(F.concat(F.lit("a/.."), path)).alias("up_safe"))


@query
def join_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", "://[^/]*(.*)$", 1)
    return _urls(spark, sf_dir).select("page_id", names.join_key(path, F.lit("seg.m4s")).alias("key"))


@query
def zip_safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("page_id", names.zip_safe_name(F.concat(F.lit("..\\./"), F.col("url"))).alias("name"))


@query
def redact_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("page_id", names.redact_url(F.col("url")).alias("url"))


@query
def storage_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("page_id", names.storage_id(F.lit("video"), F.col("url")).alias("id"))


@query
def byte_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", checksums.crc32(F.col("text")).alias("crc32"), checksums.fletcher(F.col("text")).alias("fletcher"))


@query
def byte_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", checksums.fletcher(F.col("url")).alias("fletcher"), checksums.fnv1a(F.col("url")).alias("fnv1a"))


@query
def segment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = segment.segments(views.samples(spark, sf_dir), TARGET)
    prefix = F.concat(F.lit("t"), F.col("track").cast("string"))
    return cut.select("track", "seg_idx", names.segment_name(prefix, F.col("seg_idx")).alias("name"), names.init_name(prefix).alias("init"), names.playlist_name(prefix).alias("playlist"))


@query
def cache_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("page_id", names.cache_policy(F.col("url").endswith("/")).alias("policy"))


@query
def error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.element_at(F.array(*map(F.lit, (200, 400, 403, 404, 429, 500))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return o.select("o_orderkey", names.error_class(status, F.when(F.col("o_custkey") % 7 == 0, "AccessDenied")).alias("class"), names.retry_ceiling_ms(F.col("o_orderkey") % 8).alias("ceiling_ms"))


@query
def dos_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", names.dos_time(F.col("ts")).alias("time"), names.dos_date(F.col("ts")).alias("date"))


@query
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", names.format_bytes(F.col("n_chars")).alias("chars"), names.format_bytes(F.col("n_chars") * 977).alias("many"))


# Jobs


@query
def resumable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.resumable(views.jobs(spark, sf_dir))


@query
def job_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = views.jobs(spark, sf_dir).select("job_id", "status", "updated_at")
    changes = store.filter(F.col("job_id") % 5 == 0).select("job_id", F.lit("done").alias("status"), (F.col("updated_at") + 1).alias("updated_at"))
    return jobs.upsert(store, changes, "job_id")


@query
def mark_uploaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = views.jobs(spark, sf_dir).filter(F.col("status") == "done")
    return jobs.mark_uploaded(views.outputs(spark, sf_dir), done, "job_id")


@query
def pending_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.pending(views.outputs(spark, sf_dir)).select("job_id", "n")


@query
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = views.jobs(spark, sf_dir)
    left, outputs = jobs.cascade_delete(store, views.outputs(spark, sf_dir), store.filter(F.col("status") == "failed").select("job_id"))
    return left.select("job_id", F.lit("job").alias("kind")).union(outputs.select("job_id", F.lit("output")))


@query
def match_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = views.jobs(spark, sf_dir)
    picked = store.select("job_id", "owner", F.when(F.col("job_id") % 4 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "updated_at")
    return jobs.matching(picked, store, "owner", "size", "updated_at").select("job_id")


@query
def queue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.queue_report(views.jobs(spark, sf_dir), by="owner")


@query
def quota_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.outputs(spark, sf_dir)
    available = F.when(F.col("job_id") % 3 != 0, F.col("n") * 30)
    return o.select("job_id", jobs.has_room(F.col("bytes"), available).alias("room"))


@query
def zip_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 16).alias("job"), "url", F.octet_length("html").cast("long").alias("size"))
    return boxes.zip_entry_offsets(p, "job", "page_id", "url", "size").select("page_id", "job", "offset")


@query
def outputs_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of a track: init, segments, playlist, in this order."""
    cut = segment.segments(views.samples(spark, sf_dir), TARGET)
    prefix = F.concat(F.lit("t"), F.col("track").cast("string"))
    media = cut.select("track", (F.col("seg_idx") + 1).alias("ord"), names.segment_name(prefix, F.col("seg_idx")).alias("name"))
    per_track = cut.groupBy("track").agg(F.max("seg_idx").alias("last"))
    ends = per_track.select("track", F.inline(F.array(F.struct(F.lit(0).cast("long").alias("ord"), names.init_name(prefix).alias("name")), F.struct((F.col("last") + 2).alias("ord"), names.playlist_name(prefix).alias("name")))))
    return media.unionByName(ends)


#: Samples of a fragment at most.
FRAGMENT = 64


def packed_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments packed from all samples of each track, with payloads of their sizes: file (track and fragment) and content."""
    each = views.samples(spark, sf_dir).select("track", F.floor(F.col("sample_idx") / FRAGMENT).cast("long").alias("fragment"), "sample_idx", "us", "duration", "is_sync", "size")
    # Fragments of a long track are spread over tasks; a task holds the samples of one fragment.
    dealt = each.repartition("track", "fragment").sortWithinPartitions("track", "fragment", "sample_idx")

    def pack(rows: list[tuple]) -> bytes:
        samples = [(duration & 0xFFFFFFFF, sync, 0, bytes(max(size, 0))) for *_, duration, sync, size in rows]
        return boxes.media_segment(rows[0][1] + 1 & 0xFFFFFFFF, 1, rows[0][3] & 0xFFFFFFFFFFFFFFFF, samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def made() -> pa.RecordBatch:
            file = pa.array([{"track": held[0][0], "fragment": held[0][1]}], pa.struct([("track", pa.int64()), ("fragment", pa.int64())]))
            return pa.RecordBatch.from_arrays([file, pa.array([pack(held)], pa.binary())], names=["file", "content"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:2] != row[:2]:
                    yield made()
                    held.clear()
                held.append(row)
        if held:
            yield made()

    return dealt.mapInArrow(run, "file struct<track: long, fragment: long>, content binary")


@query
def parse_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All boxes of the fragments."""
    return boxes.parse_boxes(packed_fragments(spark, sf_dir), "file").select("file.*", "path", "depth", "offset", "size")
