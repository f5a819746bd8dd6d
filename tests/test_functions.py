"""Fixed results of names, checksums and text rewriting."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import checksums, names
from tidemark.operators import manifest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "key"), [("../../etc/passwd", "etcpasswd"), ("..", "_"), ("a/b\\c", "abc"), ("", "_"), (".!.a", "a"), ("x" * 200, "x" * 128)])
def test_sanitize_key(spark, text, key):
    assert one(spark, names.sanitize_key(F.lit(text))) == key


@pytest.mark.parametrize("text", ["", "a", "abc", "123456789"])
def test_crc32(spark, text):
    assert one(spark, checksums.crc32(F.lit(text))) == zlib.crc32(text.encode())


@pytest.mark.parametrize("text", ["", "a", "hello", "é😀", "x" * 50])
def test_sums(spark, text):
    h = 0x811C9DC5
    units = text.encode("utf-16-be")
    for k in range(0, len(units), 2):
        h = (h ^ int.from_bytes(units[k : k + 2], "big")) * 0x01000193 % 2**32
    lo = hi = 0
    for b in text.encode():
        lo = (lo + b) % 65535
        hi = (hi + lo) % 65535
    assert one(spark, checksums.fnv1a(F.lit(text))) == h
    assert one(spark, checksums.fletcher(F.lit(text))) == hi << 16 | lo


def test_storage_id_is_short_and_stable(spark):
    long = one(spark, names.storage_id(F.lit("video"), F.lit("folder/" + "segment" * 9 + "_00001.m4s")))
    assert len(long) == 36 and long.endswith("segment_00001.m4s")
    assert one(spark, names.storage_id(F.lit(""), F.lit("a b.m4s"))) == "a-b.m4s"
    assert one(spark, names.storage_id(F.lit(""), F.lit("///"))) == "f"


def test_byte_codecs(spark):
    assert one(spark, names.codec_string(F.lit(bytes.fromhex("01640028")))) == "avc1.640028"
    assert one(spark, names.codec_string(F.lit(b"\1\2\3"))) is None
    assert one(spark, names.aac_codec(F.lit(bytes([0x12, 0x10])))) == "mp4a.40.2"


def test_vtt(spark):
    srt = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\nHi, you\r\n\r\n"
    assert one(spark, names.to_vtt(F.lit(srt))) == "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.500\nHi, you\n"
    assert one(spark, names.to_vtt(F.lit(" WEBVTT\n\nx"))) == " WEBVTT\n\nx"


def test_rewrite_keeps_what_it_does_not_know(spark):
    text = '#EXTM3U\n#X:URI="a.mp4",Y=1,URI="b.mp4"\n\n c.m4s \nd.m4s\n'
    playlists = spark.createDataFrame([(1, text)], "k long, playlist string")
    none = spark.createDataFrame([], "k long, name string, url string")
    some = spark.createDataFrame([(1, "b.mp4", "B"), (1, "c.m4s", "C")], "k long, name string, url string")
    assert manifest.rewrite(playlists, none, "k").first()[1] == text
    assert manifest.rewrite(playlists, some, "k").first()[1] == '#EXTM3U\n#X:URI="a.mp4",Y=1,URI="B"\n\nC\nd.m4s\n'
    twice = some.union(spark.createDataFrame([(1, "c.m4s", "A"), (1, "c.m4s", "D")], some.schema))
    assert manifest.rewrite(playlists, twice, "k").first()[1].split("\n")[3] == "A"
    assert [r["name"] for r in manifest.references(playlists, "k").orderBy("n").collect()] == ["a.mp4", "b.mp4", "c.m4s", "d.m4s"]


def test_subtitles_without_tracks_or_variants(spark):
    masters = spark.createDataFrame([(1, "#EXTM3U\n"), (2, "#EXTM3U\n")], "k long, playlist string")
    tracks = spark.createDataFrame([(2, 0, "", "x", False, True, False)], "k long, ord long, language string, name string, is_default boolean, autoselect boolean, forced boolean")
    found = {r[0]: r[1] for r in manifest.attach_subtitles(masters, tracks, "k", "video").collect()}
    assert found[1] == "#EXTM3U\n"
    assert found[2].startswith("#EXTM3U\n#EXT-X-MEDIA:TYPE=SUBTITLES") and found[2].endswith('URI="video_sub_und.m3u8"\n')
