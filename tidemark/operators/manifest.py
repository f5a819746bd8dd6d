"""Playlists as text: building, reading and rewriting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.names import quoted, srt_to_vtt, track_stem

from .timeline import floor_div, ticks_to_us

URI = 'URI="([^"]*)"'


def seconds6(ticks: Column, timescale: int) -> Column:
    """Ticks as seconds with six decimals, from integers; nothing below zero."""
    micros = ticks_to_us(F.greatest(ticks, F.lit(0)).cast("long"), timescale)
    return F.concat(floor_div(micros, F.lit(1_000_000)).cast("string"), F.lit("."), F.lpad((micros % 1_000_000).cast("string"), 6, "0"))


def media_playlist(segments: DataFrame, key: str, prefix: Column, target_s: int, timescale: int) -> DataFrame:
    """key and the playlist of its segments (seg_idx, ticks), in order."""
    line = F.concat(F.lit("#EXTINF:"), seconds6(F.col("ticks"), timescale), F.lit(",\n"), F.format_string("%s_%05d.m4s", prefix, F.col("seg_idx")))
    listed = segments.select(key, prefix.alias("prefix"), F.struct("seg_idx", line.alias("line")).alias("entry"))
    body = F.array_join(F.transform(F.array_sort("entries"), lambda e: e["line"]), "\n")
    head = F.concat(F.lit(f'#EXTM3U\n#EXT-X-VERSION:7\n#EXT-X-TARGETDURATION:{max(target_s, 1)}\n#EXT-X-MEDIA-SEQUENCE:0\n#EXT-X-PLAYLIST-TYPE:VOD\n#EXT-X-MAP:URI="'), F.col("prefix"), F.lit('_init.mp4"\n'))
    return listed.groupBy(key, "prefix").agg(F.collect_list("entry").alias("entries")).select(key, F.concat(head, body, F.lit("\n#EXT-X-ENDLIST\n")).alias("playlist"))


def master_playlist(rungs: DataFrame, key: str) -> DataFrame:
    """key and the master playlist of its rungs (width, height, bitrate, codecs, uri), richest first, ties by uri."""
    line = F.concat(
        F.lit("#EXT-X-STREAM-INF:BANDWIDTH="), F.col("bitrate").cast("string"), F.lit(",RESOLUTION="), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"),
        F.lit(',CODECS="'), F.col("codecs"), F.lit('"\n'), F.col("uri"),
    )
    listed = rungs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("bitrate")).alias("order"), "uri", line.alias("line")))).alias("entries"))
    body = F.array_join(F.transform("entries", lambda e: e["line"]), "\n")
    return listed.select(key, F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:7\n"), body, F.lit("\n")).alias("playlist"))


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, "^\\s+|\\s+$", "")


def references(playlists: DataFrame, key: str, text: str = "playlist") -> DataFrame:
    """key, n (from 0) and name of every file that a playlist refers to, in order."""
    lines = playlists.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", _trimmed(F.col("line"))).filter(F.col("line") != "")
    found = F.when(F.col("line").startswith("#"), F.filter(F.regexp_extract_all("line", F.lit(URI), F.lit(1)), lambda x: x != "")).otherwise(F.array("line"))
    each = lines.select(key, "line_no", F.posexplode(found).alias("at", "name"))
    return each.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("line_no", "at")) - 1).cast("long").alias("n"), "name")


def rewrite(playlists: DataFrame, urls: DataFrame, key: str, text: str = "playlist") -> DataFrame:
    """Playlists with each name that urls (key, name, url) knows replaced by its address; lines and their count stay.

    Names are found as references() finds them, joined to the addresses, and gathered again as one map per
    playlist, by which every line is rewritten in place. Of several addresses of a name the least one counts.
    """
    single = urls.groupBy(key, "name").agg(F.min("url").alias("url"))
    known = references(playlists, key, text).select(key, "name").distinct().join(single, [key, "name"])
    maps = known.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "url"))).alias("__urls"))
    joined = playlists.join(maps, key, "left")
    url = lambda name: F.try_element_at(F.col("__urls"), name)
    piece = lambda p: F.when(  # noqa: E731  a part that begins with URI=" up to its closing quote
        p.startswith('URI="') & (F.instr(F.substring(p, F.lit(6), F.length(p)), '"') > 0),
        F.coalesce(
            F.concat(F.lit('URI="'), url(F.regexp_extract(p, URI, 1)), F.lit('"'), F.regexp_replace(p, '^URI="[^"]*"', "")), p
        ),
    ).otherwise(p)
    tag = lambda line: F.array_join(F.transform(F.split(line, '(?=URI=")'), piece), "")
    rewritten = lambda line: (
        F.when(_trimmed(line) == "", line).when(_trimmed(line).startswith("#"), tag(line)).otherwise(F.coalesce(url(_trimmed(line)), line))
    )
    return joined.select(key, F.array_join(F.transform(F.split(text, "\n"), rewritten), "\n").alias("playlist"))


def main_playlist(outputs: DataFrame, key: str, order: str = "ord", name: str = "name", is_manifest: str = "is_manifest") -> DataFrame:
    """key and the manifest to give a player: the last one that is named a master, else the first; keys without one are left out."""
    found = outputs.filter(F.col(is_manifest)).groupBy(key).agg(
        F.max_by(F.when(F.col(name).contains("master"), F.col(name)), F.when(F.col(name).contains("master"), F.col(order))).alias("__master"), F.min_by(name, order).alias("__first")
    )
    return found.select(key, F.coalesce("__master", "__first").alias("main"))


def subtitle_files(tracks: DataFrame, prefix: str, duration_ms: int) -> DataFrame:
    """track key columns, name, content, content_type and is_manifest of the cues and the playlist of each track (language, content)."""
    stem = track_stem(F.lit(prefix), F.col("language"))
    cues = F.when(F.regexp_replace("content", "^[\\s\\x{FEFF}]+", "").startswith("WEBVTT"), F.col("content")).otherwise(srt_to_vtt(F.col("content")))
    length = f"{duration_ms // 1000}.{duration_ms % 1000:03d}"
    listing = F.concat(F.lit(f"#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:{-(-duration_ms // 1000)}\n#EXT-X-MEDIA-SEQUENCE:0\n#EXTINF:{length},\n"), stem, F.lit(".vtt\n#EXT-X-ENDLIST\n"))
    files = F.array(
        F.struct(F.concat(stem, F.lit(".vtt")).alias("name"), cues.alias("text"), F.lit("text/vtt").alias("content_type"), F.lit(False).alias("is_manifest")),
        F.struct(F.concat(stem, F.lit(".m3u8")).alias("name"), listing.alias("text"), F.lit("application/vnd.apple.mpegurl").alias("content_type"), F.lit(True).alias("is_manifest")),
    )
    return tracks.select(*[c for c in tracks.columns if c != "content"], F.inline(files))


def attach_subtitles(masters: DataFrame, tracks: DataFrame, key: str, prefix: str, group: str = "subs") -> DataFrame:
    """Master playlists with their tracks (ord, language, name, is_default, autoselect, forced) before the first variant.

    Each variant names the group once; without variants the tracks stand at the end; without tracks nothing changes.
    """
    flag = lambda c: F.when(F.col(c), "YES").otherwise("NO")
    line = F.concat(
        F.lit("#EXT-X-MEDIA:TYPE=SUBTITLES,GROUP-ID="), quoted(F.lit(group)), F.lit(",NAME="), quoted(F.col("name")), F.lit(",LANGUAGE="), quoted(F.col("language")),
        F.lit(",DEFAULT="), flag("is_default"), F.lit(",AUTOSELECT="), flag("autoselect"), F.when(F.col("forced"), ",FORCED=YES").otherwise(""),
        F.lit(",URI="), quoted(F.concat(track_stem(F.lit(prefix), F.col("language")), F.lit(".m3u8"))),
    )
    media = tracks.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda t: t["line"]).alias("__media"))
    lines = F.split(F.regexp_replace("playlist", "\r\n", "\n"), "\n")
    variant = lambda x: x.startswith("#EXT-X-STREAM-INF")
    tagged = F.transform(lines, lambda x: F.when(variant(x) & ~x.contains("SUBTITLES="), F.concat(x, F.lit(f',SUBTITLES="{group}"'))).otherwise(x))
    first = F.array_position(F.transform(lines, lambda x: variant(x).cast("int")), 1)
    end = F.when(F.element_at(lines, -1) == "", F.size(lines) - 1).otherwise(F.size(lines))
    at = F.when(first > 0, first - 1).otherwise(end).cast("int")
    whole = F.concat(F.slice(tagged, F.lit(1), at), F.col("__media"), F.slice(tagged, at + 1, F.size(lines)))
    joined = masters.join(media, key, "left")
    return joined.select(key, F.when(F.col("__media").isNull(), F.col("playlist")).otherwise(F.array_join(whole, "\n")).alias("playlist"))
