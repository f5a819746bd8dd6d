"""Queries of what packs, parses, checks and sends: bytes are made from the star-schema tables and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import __version__
from tidemark.functions import names
from tidemark.operators import index, jobs, ladder, manifest, segment, timeline, validate
from tidemark.session import shared_folder, spread, table
from tidemark.sources import adapters, boxes, media, sinks, views
from tidemark.streaming.control import pulled, run_through
from tidemark.streaming.segmenter import stream_segments

from .catalogue import TARGET, packed_fragments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
VIDEO_CONFIG = bytes.fromhex("0142c01effe1000467420a1e01000468ce3c80")
AUDIO = media.Aac(2, 44_100, 2, bytes([0x12, 0x10]))
PER_CHUNK = 8


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _packed(rows: DataFrame, key: str, inputs: list[str], pack: Callable[..., bytes]) -> DataFrame:
    """key and the content that pack makes of each row's inputs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                content = [pack(*values) for values in zip(*(part.column(c).to_pylist() for c in range(1, part.num_columns)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, pa.binary())], names=[key, "content"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *inputs).mapInArrow(run, f"`{key}` {kind}, content binary")


# Time


@query
def time_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks far beyond 2**53 in microseconds, these as audio ticks, prices as target durations."""
    ticks = F.round(F.col("o_totalprice") * 100).cast("long") * F.lit(1_000_000_007)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", ticks.alias("ticks"))
    us = timeline.ticks_to_us(F.col("ticks"), 90_000)
    return o.select(
        "o_orderkey", us.alias("us"), timeline.us_to_ticks(us % 1_000_000_007, 44_100).alias("audio_ticks"), timeline.ticks_to_seconds(F.col("ticks") % 1_000_003, 90_000).alias("seconds"),
        timeline.seconds_to_ticks(F.floor("o_totalprice") / 8, 90_000).alias("target"),
    )


# Movies and fragments


@query
def init_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Init segments of every source, half of them with audio, read back."""
    sources = spread(views.media_sources(spark, sf_dir).withColumn("sound", F.col("source") % 2 == 0))

    def pack(width: int, height: int, sound: bool) -> bytes:
        return media.init_segment(90_000, media.VideoEntry("avc1", width, height, VIDEO_CONFIG), AUDIO if sound else None)

    files = _packed(sources, "source", ["width", "height", "sound"], pack)
    tracks = media.chosen(media.inits(files, "source"), "source").filter("has_defaults")
    codec = F.when(F.col("role") == "video", names.codec_string(F.col("codec"))).otherwise(names.aac_codec(F.col("audio_config")))
    return tracks.select("source", "track_id", "role", "timescale", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("width", "height", "sample_rate", "channels")), codec.alias("codec"), F.size("sizes").cast("long").alias("samples"), "n_bytes", "fragmented")


def _movie_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A movie of each track: its samples but for clicks as video, clicks as audio, PER_CHUNK of them to a chunk."""
    v = views.samples(spark, sf_dir).withColumn("sound", F.col("event_type") == "click")
    seconds = F.floor(F.col("duration") / 1_000_000).cast("long")
    row = F.struct("sample_idx", "size", seconds.alias("duration"), "is_sync", (F.col("sample_idx") % 5 - 2).alias("cts"))
    lists = v.groupBy("track").agg(*(F.array_sort(F.collect_list(F.when(F.col("sound") == s, row))).alias(n) for n, s in (("video", False), ("audio", True))))

    def located(rows: list[dict], base: int) -> list[media.Sample]:
        out, at = [], 0
        for k, r in enumerate(rows):
            at = base + k // PER_CHUNK * 1_000_000_000 if k % PER_CHUNK == 0 else at
            out.append((at, r["size"], r["duration"], base > 0 or r["is_sync"], 0 if base else r["cts"]))
            at += r["size"]
        return out

    def pack(track: int, video: list[dict], audio: list[dict]) -> bytes:
        entry = media.VideoEntry("avc1", 320 + track % 100 * 2, 240 + track % 50 * 2, VIDEO_CONFIG)
        return media.movie(1, entry, located(video, 0), AUDIO if audio else None, located(audio, 500), PER_CHUNK)

    return _packed(lists.withColumn("own", F.col("track")), "track", ["own", "video", "audio"], pack)


@query
def movie_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample that the tables of the movies speak of, with its place in the file."""
    tracks = media.chosen(media.movies(_movie_files(spark, sf_dir), "track"), "track")
    return index.sample_rows(tracks, "track", "role")


@query
def movie_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.inspected(media.movies(_movie_files(spark, sf_dir), "track"), "track").drop("error")


@query
def fragment_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of all fragments, as the fragments' headers have them."""
    found = boxes.fragments(packed_fragments(spark, sf_dir), "file")
    return found.select("file.*", "n", "track_id", "offset", "size", "duration", "is_sync", "cts")


# Checks


@query
def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with settings, samples, restored segments and audio tracks, and the text that says so."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("s"), F.col("p_retailprice").alias("price"))
    s, config = F.col("s"), F.expr("CAST(repeat('a', CAST(s % 7 AS INT)) AS BINARY)")
    wrong = validate.config_error(s % 9, s * 100 % 17_000, s * 7, config, F.when(s % 11 == 0, F.lit(float("nan"))).otherwise(F.col("price")))
    return p.select(
        "p_partkey", wrong.alias("config_error"), validate.error_text(wrong).alias("config_text"),
        validate.sample_error(s % 10 * 10_000_000, s * 3_000).alias("sample_error"), validate.restore_error(F.col("price") - 1200, s % 2).alias("restore_error"),
        validate.audio_error(s % 4, s * 2_000, s % 5 == 0).alias("audio_error"), validate.audio_sample_error(s % 3 != 0, s % 6, s).alias("audio_sample_error"),
    )


@query
def support_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.support(spark)


@query
def encoder_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    preferred = F.element_at(F.array(*map(F.lit, ("main", "high", "baseline"))), (F.col("source") % 3 + 1).cast("int"))
    return views.media_sources(spark, sf_dir).select("source", F.array_join(ladder.encoder_codecs(F.col("width"), F.col("height"), preferred), ",").alias("codecs"))


# Sinks


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of jobs: pages, of which every fifth is a manifest and every fifteenth a master."""
    kind = F.when(F.col("page_id") % 15 == 0, "master.m3u8").when(F.col("page_id") % 5 == 0, "list.m3u8").otherwise("seg.m4s")
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("_"), kind)
    return table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 16).alias("job"), "url", name.alias("name"), (F.col("page_id") % 5 == 0).alias("is_manifest"), F.col("html").cast("binary").alias("data"))


@query
def upload_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _outputs(spark, sf_dir).withColumn("kind", F.when(F.col("is_manifest"), "application/vnd.apple.mpegurl").otherwise("video/mp4"))
    name, kind, is_manifest, prefix = F.col("name"), F.col("kind"), F.col("is_manifest"), F.concat(F.lit("/u/"), F.col("job").cast("string"), F.lit("/"))
    made = F.array(
        adapters.presigned(F.concat("url", F.lit("?sig=x")), kind, headers=F.create_map(F.lit("x-ms-blob-type"), F.lit("BlockBlob"))), adapters.s3("videos", prefix, name, kind, is_manifest),
        adapters.supabase("videos", prefix, name, kind, is_manifest), adapters.appwrite("bucket", F.lit("hls"), name, kind), adapters.firebase(prefix, name, kind, is_manifest),
    )
    headers: Column = F.array_join(F.array_sort(F.transform(F.map_entries("r.headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "; ")
    return o.select("page_id", F.posexplode(made).alias("store", "r")).select("page_id", F.col("store").cast("long").alias("store"), "r.method", "r.target", headers.alias("headers"))


@query
def upload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each store's failures say, and if trying again can help."""
    o = _outputs(spark, sf_dir)
    status = F.element_at(F.array(*map(F.lit, (403, 429, 500, 404))), (F.col("page_id") % 4 + 1).cast("int"))
    reason = F.element_at(F.array(*map(F.lit, ("SlowDown", "AccessDenied", "Bucket not found", "missing scope", "odd"))), (F.col("page_id") % 5 + 1).cast("int"))
    unknown = F.when(F.col("page_id") % 3 > 0, status)
    key = F.concat(F.lit("hls/"), F.col("name"))
    made = F.array(
        F.struct(adapters.presigned_error(F.col("name"), status, reason, F.concat("url", F.lit("?sig=x"))).alias("text"), status.isin(400, 401, 403, 404).alias("permanent")),
        F.struct(adapters.s3_error(key, unknown, reason).alias("text"), adapters.is_permanent("s3", unknown, reason).alias("permanent")),
        F.struct(adapters.supabase_error(key, reason).alias("text"), adapters.is_permanent("supabase", unknown, reason).alias("permanent")),
        F.struct(adapters.appwrite_error(F.col("name"), F.lit("id"), reason).alias("text"), adapters.is_permanent("appwrite", unknown, reason).alias("permanent")),
        F.struct(adapters.firebase_error(key, reason).alias("text"), adapters.is_permanent("s3", F.lit(None).cast("int"), reason).alias("permanent")),
    )
    return o.select("page_id", F.posexplode(made).alias("store", "r")).select("page_id", F.col("store").cast("long").alias("store"), "r.text", "r.permanent")


@query
def upload_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upload failing for good and one failing for now, of which the others know nothing; each is tried as often as that allows."""
    tries: dict[str, int] = {}

    def upload(name: str, data: bytes) -> None:
        tries[name] = tries.get(name, 0) + 1
        number = int(name[1:].split("_")[0])
        if number % 7 == 0:
            raise sinks.PermanentUploadError(f"tried {tries[name]}")
        if number % 3 == 0 or number % 4 == 0 and tries[name] < 3:
            raise OSError(f"tried {tries[name]}")
        if not data:
            raise ValueError("no data")

    return sinks.upload_all(_outputs(spark, sf_dir), upload, 2, lambda _: None)


@query
def archive_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages of each job, in parts: every entry, then the directory."""
    outputs = _outputs(spark, sf_dir).withColumn("ord", F.col("page_id")).withColumn("name", F.concat(F.lit("../d/"), F.col("name")))
    parts = sinks.archive_parts(outputs, "job")
    return parts.select("job", "part", "offset", F.octet_length("bytes").cast("long").alias("size"), F.coalesce("name", F.lit("")).alias("name"), F.lower(F.hex(F.substring("bytes", 1, 4))).alias("mark"))


@query
def main_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = _outputs(spark, sf_dir).withColumn("ord", F.col("page_id"))
    return manifest.main_playlist(outputs, "job")


# Segmenters


def _with_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.samples(spark, sf_dir).select("track", F.col("event_id").alias("frame"), F.expr("us * 16 + sample_idx % 16").alias("us"), (F.col("event_id") % 7 * 16 + 320).alias("width"), (F.col("event_id") % 5 * 16 + 240).alias("height"))


@query
def frame_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.from_frames(_with_sizes(spark, sf_dir))


@query
def segmenter_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.samples(spark, sf_dir)
    return segment.progress_of(segment.segments(v, TARGET), v.filter(F.col("event_type") == "error"), F.concat(F.lit("t"), F.col("track").cast("string")))


@query
def oldest_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments to take next, where some have been taken."""
    cut = segment.segments(views.samples(spark, sf_dir), TARGET).select("track", "seg_idx", "n", "bytes")
    return segment.oldest(cut.filter(F.col("seg_idx") >= F.col("track") % 4))


@query
def descriptor_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.round(F.col("o_totalprice") * 100).cast("long") % (1 << 28)
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, n % 20_000).otherwise(n).alias("n"))
    data = names.descriptor_length(F.col("n"))
    return o.select("o_orderkey", F.lower(F.hex(data)).alias("written"), names.length_of_descriptor(data).alias("n"), F.coalesce(names.length_of_descriptor(F.substring(data, 1, 2)), F.lit(-1)).alias("cut_off"))


@query
def engine_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(__version__).alias("version"))


# Jobs


@query
def truncated_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = jobs.truncated(views.jobs(spark, sf_dir), views.outputs(spark, sf_dir))
    counts = [s.agg(F.count("*").alias("rows")).select(F.lit(n).alias("store"), "rows") for n, s in zip(("jobs", "outputs"), kept, strict=True)]
    return counts[0].union(counts[1])


@query
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.progress(views.jobs(spark, sf_dir), "owner", F.col("status") == "done")


@query
def job_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs with the id of their job, and no more of the job than may be shown."""
    o = jobs.of_job(_outputs(spark, sf_dir), F.concat(F.lit("job-"), F.col("job").cast("string")))
    return jobs.snapshot(o, "data", "url", "job", "secret")


@query
def routed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id")
    handlers = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 3 == 0).select(F.col("c_custkey").alias("job_id"), F.col("c_nationkey").alias("handler"))
    return jobs.route(messages, handlers)


# Streams


@query
def streamed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples as a stream of files, clicks as audio, cut by the stateful segmenter."""
    v = views.samples(spark, sf_dir).withColumn("is_audio", F.col("event_type") == "click").select("track", "us", "event_id", "sample_idx", "duration", "is_sync", "size", "is_audio")
    both = timeline.merge(v.filter(~F.col("is_audio")), v.filter("is_audio"), "us", "track", "event_id").select("track", "pos", "sample_idx", "duration", "is_sync", "size", "is_audio", F.lit(False).alias("is_end"))
    zero = F.lit(0).cast("long")
    ends = both.groupBy("track").agg((F.max("pos") + 1).alias("pos")).select("track", "pos", zero.alias("sample_idx"), zero.alias("duration"), F.lit(False).alias("is_sync"), zero.alias("size"), F.lit(False).alias("is_audio"), F.lit(True).alias("is_end"))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    both.union(ends).write.parquet(f"{folder}/in")
    source = pulled(spark, both.schema, f"{folder}/in", 1_000)
    run_through(stream_segments(source, TARGET), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")
