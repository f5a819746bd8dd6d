"""Sample entries, codec descriptors, track defaults and init segments in bytes."""

from __future__ import annotations

import struct
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import MAX_CODEC_CONFIG, MAX_DIMENSION

from .boxes import box, full_box, rows_of, track_tables, walk, walk_all

#: Tags of the descriptors around an audio configuration.
ES, DECODER, SPECIFIC, LAYER = 3, 4, 5, 6
#: Sampling rates by their index in an audio configuration.
RATES = (96_000, 88_200, 64_000, 48_000, 44_100, 32_000, 24_000, 22_050, 16_000, 12_000, 11_025, 8_000, 7_350)
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class VideoEntry(NamedTuple):
    kind: str
    width: int
    height: int
    config: bytes


class Aac(NamedTuple):
    object_type: int
    sample_rate: int
    channels: int
    config: bytes


def video_entry(stsd: bytes) -> VideoEntry | None:
    """The first H.264 entry of a sample description's body (after its version, flags and count)."""
    for kind, at, header, size in walk(stsd, 8):
        body = stsd[at + header : at + size]
        if kind in ("avc1", "avc3") and len(body) >= 78:
            width, height = struct.unpack_from(">HH", body, 24)
            for inner, a, h, s in walk(body, 78):
                config = body[a + h : a + s]
                if inner == "avcC" and 4 <= len(config) <= MAX_CODEC_CONFIG and 0 < width <= MAX_DIMENSION and 0 < height <= MAX_DIMENSION:
                    return VideoEntry(kind, width, height, config)
    return None


def read_length(data: bytes, at: int) -> tuple[int, int] | None:
    """A descriptor's length, seven bits a byte, and the place after it."""
    value = 0
    for k in range(4):
        if at + k >= len(data):
            return None
        value = value << 7 | data[at + k] & 0x7F
        if not data[at + k] & 0x80:
            return value, at + k + 1
    return None


def write_length(value: int) -> bytes:
    out = [value & 0x7F]
    while value := value >> 7:
        out.append(value & 0x7F | 0x80)
    return bytes(reversed(out))


def _descriptor(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return bytes([tag]) + write_length(len(body)) + body


def specific_config(data: bytes) -> bytes | None:
    """The audio configuration within the descriptors of an esds body."""
    at, stop = 4, len(data)
    while at < stop:
        tag, found = data[at], read_length(data, at + 1)
        if found is None:
            return None
        length, start = found
        if tag == SPECIFIC:
            return data[start : start + length] if start + length <= len(data) else None
        if tag == ES and start + 3 <= len(data):
            flags, at = data[start + 2], start + 3
            at += 2 * bool(flags & 0x80)
            if flags & 0x40:
                at += 1 + (data[at] if at < len(data) else 0)
            at += 2 * bool(flags & 0x20)
        elif tag == DECODER:
            at = start + 13
        else:
            at = start + length
    return None


def aac(entry: bytes) -> Aac | None:
    """What an mp4a sample entry says of its audio."""
    for kind, at, header, size in walk(entry):
        body = entry[at + header : at + size]
        if kind != "mp4a" or len(body) < 28:
            continue
        channels, rate = struct.unpack_from(">H", body, 16)[0], struct.unpack_from(">I", body, 24)[0] >> 16
        for inner, a, h, s in walk(body, 28):
            config = specific_config(body[a + h : a + s]) if inner == "esds" else None
            if config is not None and 2 <= len(config) <= 64:
                index = (config[0] & 7) << 1 | config[1] >> 7
                return Aac(config[0] >> 3, RATES[index] if index < len(RATES) else rate, config[1] >> 3 & 15 or channels, config)
    return None


def aac_entry(audio: Aac, bitrate: int = 128_000) -> bytes:
    decoder = _descriptor(DECODER, struct.pack(">BBHBII", 0x40, 0x15, 0, 0, bitrate, bitrate), _descriptor(SPECIFIC, audio.config))
    esds = full_box("esds", 0, 0, _descriptor(ES, b"\0\2\0", decoder, _descriptor(LAYER, b"\2")))
    return box("mp4a", bytes(6), struct.pack(">H8xHHIHH", 1, audio.channels, 16, 0, 0, 0)[:-4], struct.pack(">I", (audio.sample_rate & 0xFFFF) << 16), esds)


def track_defaults(moov: bytes) -> list[tuple[int, int, int, int]]:
    """track, duration, size and flags of each defaults box that can be read."""
    found = []
    for path, _, at, header, size in walk_all(moov):
        body = moov[at + header : at + size]
        if path.endswith("mvex/trex") and len(body) >= 24:
            track, _, duration, length, flags = struct.unpack_from(">5I", body, 4)
            found.append((track, duration, length, flags))
    return found


#: offset, size, duration, sync and composition offset.
Sample = tuple[int, int, int, bool, int]


def sample_tables(samples: list[Sample], per_chunk: int = 1) -> bytes:
    """Run-length tables of samples of which per_chunk at a time stand in one chunk."""
    listed = lambda kind, form, rows, version=0: full_box(kind, version, 0, struct.pack(">I", len(rows)), *(struct.pack(form, *r) for r in rows))
    runs = lambda values: [(len(list(g)), v) for v, g in groupby(values)]
    chunks = [(x[0],) for x in samples[::per_chunk]]
    rest = len(samples) % per_chunk
    spread = [(1, per_chunk, 1)] if len(samples) >= per_chunk else []
    tables = [listed("stts", ">II", runs(x[2] for x in samples)), listed("stsc", ">III", [*spread, *([(len(chunks), rest, 1)] if rest else [])])]
    if any(x[4] for x in samples):
        tables.append(listed("ctts", ">Ii", runs(x[4] for x in samples), 1))
    if not all(x[3] for x in samples):
        tables.append(listed("stss", ">I", [(k,) for k, x in enumerate(samples, 1) if x[3]]))
    wide = any(c >= 1 << 32 for (c,) in chunks)
    sizes = full_box("stsz", 0, 0, struct.pack(">II", 0, len(samples)), *(struct.pack(">I", x[1]) for x in samples))
    return b"".join([*tables, sizes, listed("co64" if wide else "stco", ">Q" if wide else ">I", chunks)])


def _track(number: int, timescale: int, handler: bytes, header: bytes, entry: bytes, width: int, height: int, volume: int, tables: bytes | None = None) -> bytes:
    empty = b"".join(full_box(k, 0, 0, struct.pack(">I", 0)) for k in ("stts", "stsc", "stco")) + full_box("stsz", 0, 0, struct.pack(">II", 0, 0))
    table = box("stbl", full_box("stsd", 0, 0, struct.pack(">I", 1), entry), empty if tables is None else tables)
    location = box("dinf", full_box("dref", 0, 0, struct.pack(">I", 1), full_box("url ", 0, 1)))
    media = box(
        "mdia", full_box("mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, timescale, 0, 0x55C4, 0)), full_box("hdlr", 0, 0, bytes(4), handler, bytes(12), b"\0"), box("minf", header, location, table)
    )
    return box("trak", full_box("tkhd", 0, 7, struct.pack(">IIIII8xHHHH", 0, 0, number, 0, 0, 0, 0, volume, 0), _MATRIX, struct.pack(">II", width << 16, height << 16)), media)


def init_segment(timescale: int, video: VideoEntry, audio: Aac | None = None) -> bytes:
    """File type and movie boxes of a fragmented file: empty tables, and defaults of every track."""
    tracks = _tracks(timescale, video, audio, None, None)
    defaults = box("mvex", *(full_box("trex", 0, 0, struct.pack(">5I", k + 1, 1, 0, 0, 0)) for k in range(len(tracks))))
    return box("ftyp", b"iso5\0\0\0\0iso5iso6mp41") + box("moov", _header(timescale, len(tracks)), *tracks, defaults)


def movie(timescale: int, video: VideoEntry, samples: list[Sample], audio: Aac | None = None, audio_samples: list[Sample] | None = None, per_chunk: int = 1) -> bytes:
    """File type and movie boxes of a file whose tables say where its samples are."""
    tracks = _tracks(timescale, video, audio, sample_tables(samples, per_chunk), sample_tables(audio_samples or [], per_chunk))
    return box("ftyp", b"isom\0\0\0\0isomavc1") + box("moov", _header(timescale, len(tracks)), *tracks)


def _header(timescale: int, tracks: int) -> bytes:
    return full_box("mvhd", 0, 0, struct.pack(">IIIIIH10x", 0, 0, timescale, 0, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", tracks + 1))


def _tracks(timescale: int, video: VideoEntry, audio: Aac | None, tables: bytes | None, audio_tables: bytes | None) -> list[bytes]:
    entry = box("avc1", bytes(6), struct.pack(">H16xHHIII", 1, video.width, video.height, 0x480000, 0x480000, 0), struct.pack(">H32xHh", 1, 24, -1), box("avcC", video.config))
    tracks = [_track(1, timescale, b"vide", full_box("vmhd", 0, 1, bytes(8)), entry, video.width, video.height, 0, tables)]
    if audio:
        tracks.append(_track(2, audio.sample_rate, b"soun", full_box("smhd", 0, 0, bytes(4)), aac_entry(audio), 0, 0, 0x100, audio_tables))
    return tracks


def is_fragmented(moov: bytes, samples: int) -> bool:
    """No samples in its tables, and a box that announces fragments."""
    return samples == 0 and any(path == "moov/mvex" for path, *_ in walk_all(moov))


_PAIRS, _TRIPLES = "array<struct<a: long, b: long>>", "array<struct<a: long, b: long, c: long>>"
MOVIE = (
    f"n int, track_id long, handler string, timescale long, stts {_PAIRS}, ctts {_PAIRS}, stsc {_TRIPLES}, sizes array<long>, chunks array<long>, sync array<long>, "
    "kind string, width long, height long, codec binary, sample_rate long, channels long, audio_config binary, sample_entry binary, role string"
)


def _movie_rows(data: bytes) -> list[tuple]:
    rows, chosen = [], set()
    for n, t in enumerate(track_tables(data)):
        structs = lambda x: [dict(zip("abc", v, strict=False)) for v in x]
        stsd: bytes = t["stsd"]
        video, audio = video_entry(stsd) if t["handler"] == "vide" else None, aac(stsd[8:]) if t["handler"] == "soun" else None
        entry = next((stsd[at : at + size] for _, at, _, size in walk(stsd, 8)), None) if t["handler"] == "soun" else None
        facts = (video and video.kind, video and video.width, video and video.height, video and video.config, audio and audio.sample_rate, audio and audio.channels, audio and audio.config, entry)
        role = "video" if video else "audio" if entry is not None else None
        role = None if role in chosen else role
        chosen.add(role)
        rows.append((n, t["track_id"], t["handler"], t["timescale"], structs(t["stts"]), structs(t["ctts"]), structs(t["stsc"]), t["sizes"], t["chunks"], t["sync"], *facts, role))
    return rows


def movies(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key and, for each track of each movie in order (n): its id, handler, timescale, run-length tables and what its description says.

    role is video for the first track with video that can be read, audio for the first with audio, and null for others.
    """
    return rows_of(files, key, content, MOVIE, _movie_rows)


def inits(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """movies, with the size of each file, whether it is fragmented, and whether it has defaults for the track, in one reading."""

    def rows(data: bytes) -> list[tuple]:
        known, fragmented = {track for track, *_ in track_defaults(data)}, is_fragmented(data, 0)
        return [(*r, len(data), fragmented, r[1] in known) for r in _movie_rows(data)]

    return rows_of(files, key, content, f"{MOVIE}, n_bytes long, fragmented boolean, has_defaults boolean", rows)


def chosen(tracks: DataFrame, *keys: str) -> DataFrame:
    """The first track with video that can be read, and the first with audio, of each movie (role video or audio): those that movies has marked, without a shuffle."""
    return tracks.filter(F.col("role").isNotNull()).select(*keys, "role", *(c for c in tracks.columns if c not in (*keys, "role")))


def inspected(tracks: DataFrame, key: str) -> DataFrame:
    """What a movie is, in a row: of its chosen video track and of its chosen audio track, if there is one; error where there is no video."""
    ticks = F.aggregate("stts", F.lit(0).cast("long"), lambda s, r: s + r["a"] * r["b"])
    facts = tracks.select(key, "role", "width", "height", "timescale", F.size("sizes").cast("long").alias("n"), ticks.alias("ticks"), "channels", F.octet_length("audio_config").cast("long").alias("config"))
    of = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    found = facts.groupBy(key).agg(
        of("video", "width").alias("width"), of("video", "height").alias("height"), of("video", "timescale").alias("timescale"), F.coalesce(of("video", "n"), F.lit(0)).alias("sample_count"),
        (of("video", "ticks") / F.greatest(of("video", "timescale"), F.lit(1))).alias("duration"), F.max(F.coalesce(F.col("role") == "audio", F.lit(False))).alias("has_audio"),
        F.coalesce(of("audio", "timescale"), F.lit(0)).alias("audio_timescale"), F.coalesce(of("audio", "n"), F.lit(0)).alias("audio_sample_count"),
        F.coalesce(of("audio", "channels"), F.lit(0)).alias("audio_channels"), F.coalesce(of("audio", "config"), F.lit(0)).alias("audio_config_bytes"),
    )
    return found.withColumn("error", F.when(F.col("width").isNull(), "no_video").when(F.col("sample_count") == 0, "no_samples"))
