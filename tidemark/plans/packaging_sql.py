"""DuckDB SQL for the queries of packaging.py, and for those of catalogue.py that are about bytes."""

from __future__ import annotations

from tidemark import __version__
from tidemark.model import ERRORS, HIGHEST_LEVEL, LEVELS

from .oracle import SEGMENTS, SRC, TARGET, V

#: A fragment of n samples and s bytes: boxes with their depth, place and size.
HEADER = "8 + 16 + (8 + 16 + 20 + (20 + 16 * n))"
FRAGMENTS = f"{V}, f AS (SELECT track, sample_idx // 64 AS fragment, count(*) AS n, CAST(sum(size) AS BIGINT) AS s FROM v GROUP BY ALL)"
TREE = (
    ("styp", 0, "0", "24"), ("moof", 0, "24", HEADER), ("moof/mfhd", 1, "32", "16"), ("moof/traf", 1, "48", "8 + 16 + 20 + (20 + 16 * n)"), ("moof/traf/tfhd", 2, "56", "16"),
    ("moof/traf/tfdt", 2, "72", "20"), ("moof/traf/trun", 2, "92", "20 + 16 * n"), ("mdat", 0, f"24 + {HEADER}", "8 + s"),
)
BOXES = " UNION ALL ".join(f"SELECT track, fragment, '{path}' AS path, {depth} AS depth, CAST({at} AS BIGINT) AS \"offset\", CAST({size} AS BIGINT) AS size FROM f" for path, depth, at, size in TREE)
#: Running state over a list of bytes: the table is made by its rule.
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
CODES = "list_transform(range(octet_length(encode(text))), lambda i: CAST(('0x' || substr(hex(encode(text)), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))"
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c // 256, t[CAST(xor(c, x) % 256 + 1 AS BIGINT)])), 4294967295)"
HALF_UP = lambda a, b: f"CAST(({a}::HUGEINT * 2 + {b}) // ({b}::HUGEINT * 2) AS BIGINT)"
LEVEL = "CASE " + " ".join(f"WHEN mb <= {m} AND mb * 30 <= {r} THEN '{level:02x}'" for level, m, r in LEVELS) + f" ELSE '{HIGHEST_LEVEL:02x}' END"
TEXT = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in ERRORS.items()) + " END"
#: An init segment: its file type box, then a movie box with a header, one track or two, and the defaults of each.
ENTRY_V, ENTRY_A = 8 + 78 + 8 + 19, 8 + 28 + (12 + 2 + 3 + (2 + 13 + (2 + 2)) + (2 + 1))
TRACK = lambda header, entry: 8 + 92 + (8 + 32 + 33 + (8 + header + (8 + 8 + 4 + 4 + 12) + (8 + (16 + entry) + 3 * 16 + 20)))
MOVIE = 28 + 8 + 108 + 8
ONE, TWO = MOVIE + TRACK(20, ENTRY_V) + 32, MOVIE + TRACK(20, ENTRY_V) + TRACK(16, ENTRY_A) + 64
MOVIES = f"""{V}, m AS (SELECT track, CASE WHEN event_type = 'click' THEN 'audio' ELSE 'video' END AS role, size, duration // 1000000 AS duration, is_sync, sample_idx % 5 - 2 AS cts,
 row_number() OVER (PARTITION BY track, event_type = 'click' ORDER BY sample_idx) - 1 AS k FROM v)"""
OUTPUTS = """o AS (SELECT page_id, page_id % 16 AS job, url, 'p' || page_id || '_' || CASE WHEN page_id % 15 = 0 THEN 'master.m3u8' WHEN page_id % 5 = 0 THEN 'list.m3u8' ELSE 'seg.m4s' END AS name,
 page_id % 5 = 0 AS is_manifest, html FROM pages)"""
KIND = "CASE WHEN is_manifest THEN 'application/vnd.apple.mpegurl' ELSE 'video/mp4' END"
CACHE = "CASE WHEN is_manifest THEN 'public, max-age=60' ELSE 'public, max-age=31536000, immutable' END"
SECONDS = "CASE WHEN is_manifest THEN '60' ELSE '31536000' END"
BARE = "regexp_replace(url, '\\?.*$', '', 's')"
STREAM = f"""{V}, m AS (SELECT *, event_type = 'click' AS is_audio, row_number() OVER (PARTITION BY track ORDER BY us, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END, event_id) AS pos FROM v),
r(track, pos, seg, pend, n) AS (SELECT track, pos, 0::BIGINT, CASE WHEN is_audio THEN 0 ELSE duration END::BIGINT, CASE WHEN is_audio THEN 0 ELSE 1 END FROM m WHERE pos = 1 UNION ALL
 SELECT m.track, m.pos, CASE WHEN NOT m.is_audio AND m.is_sync AND r.n > 0 AND r.pend >= {TARGET} THEN r.seg + 1 ELSE r.seg END,
  CASE WHEN m.is_audio THEN r.pend WHEN m.is_sync AND r.n > 0 AND r.pend >= {TARGET} THEN m.duration ELSE r.pend + m.duration END, CASE WHEN m.is_audio THEN r.n ELSE 1 END
 FROM r JOIN m ON m.track = r.track AND m.pos = r.pos + 1),
g AS (SELECT m.track, r.seg AS seg_idx, min(m.sample_idx) FILTER (NOT is_audio) AS first_sample, count(*) FILTER (NOT is_audio) AS n, CAST(coalesce(sum(duration) FILTER (NOT is_audio), 0) AS BIGINT) AS ticks,
 CAST(coalesce(sum(size) FILTER (NOT is_audio), 0) AS BIGINT) AS bytes, count(*) FILTER (is_audio) AS n_audio, CAST(coalesce(sum(duration) FILTER (is_audio), 0) AS BIGINT) AS audio_ticks,
 CAST(coalesce(sum(size) FILTER (is_audio), 0) AS BIGINT) AS audio_bytes FROM m JOIN r ON r.track = m.track AND r.pos = m.pos GROUP BY ALL)"""

ORACLE: dict[str, str] = {
    "parse_boxes": f"WITH {FRAGMENTS} {BOXES}",
    "byte_checksums": f"WITH c AS (SELECT doc_id, {CODES} AS b FROM documents), k AS (SELECT {CRC_TABLE} AS t) SELECT doc_id, CAST({CRC} AS BIGINT) AS crc32, CAST(list_sum(list_transform(b, lambda x, i: x * (len(b) - i + 1))) % 65535 AS BIGINT) * 65536 + CAST(list_sum(b) % 65535 AS BIGINT) AS fletcher FROM c, k",
    "time_scales": f"WITH t AS (SELECT o_orderkey, o_totalprice, CAST(round(o_totalprice * 100) AS BIGINT) * 1000000007 AS ticks FROM orders), u AS (SELECT *, {HALF_UP('(ticks::HUGEINT * 1000000)', '90000')} AS us FROM t) SELECT o_orderkey, us, {HALF_UP('(us % 1000000007 * 44100)', '1000000')} AS audio_ticks, (ticks % 1000003) / 90000 AS seconds, CAST(greatest(1, floor(floor(o_totalprice) / 8 * 90000 + 0.5)) AS BIGINT) AS target FROM u",
    "init_segments": f"WITH {SRC}, t AS (SELECT source, 1 AS track_id, 'video' AS role, 90000 AS timescale, width, height, 0 AS sample_rate, 0 AS channels, 'avc1.42c01e' AS codec FROM src UNION ALL SELECT source, 2, 'audio', 44100, 0, 0, 44100, 2, 'mp4a.40.2' FROM src WHERE source % 2 = 0) SELECT source, CAST(track_id AS BIGINT) AS track_id, role, CAST(timescale AS BIGINT) AS timescale, width, height, CAST(sample_rate AS BIGINT) AS sample_rate, CAST(channels AS BIGINT) AS channels, codec, 0::BIGINT AS samples, CASE WHEN source % 2 = 0 THEN {TWO} ELSE {ONE} END::BIGINT AS n_bytes, true AS fragmented FROM t",
    "movie_samples": f"WITH {MOVIES} SELECT track, role, k AS sample_idx, CAST(CASE WHEN role = 'audio' THEN 500 ELSE 0 END + k // 8 * 1000000000 + coalesce(sum(size) OVER (PARTITION BY track, role, k // 8 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", size, duration, is_sync OR role = 'audio' AS is_sync, CASE WHEN role = 'audio' THEN 0 ELSE cts END AS cts FROM m",
    "movie_info": f"WITH {MOVIES} SELECT track, 320 + track % 100 * 2 AS width, 240 + track % 50 * 2 AS height, 1::BIGINT AS timescale, count(*) FILTER (role = 'video') AS sample_count, CAST(sum(duration) FILTER (role = 'video') AS DOUBLE) AS duration, bool_or(role = 'audio') AS has_audio, CASE WHEN bool_or(role = 'audio') THEN 44100 ELSE 0 END::BIGINT AS audio_timescale, count(*) FILTER (role = 'audio') AS audio_sample_count, CASE WHEN bool_or(role = 'audio') THEN 2 ELSE 0 END::BIGINT AS audio_channels, CASE WHEN bool_or(role = 'audio') THEN 2 ELSE 0 END::BIGINT AS audio_config_bytes FROM m GROUP BY track",
    "fragment_samples": f"WITH {FRAGMENTS} SELECT track, fragment, sample_idx % 64 AS n, 1::BIGINT AS track_id, CAST(24 + {HEADER.replace('n', 'f.n')} + 8 + coalesce(sum(size) OVER (PARTITION BY track, fragment ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", size, duration % 4294967296 AS duration, is_sync, 0::BIGINT AS cts FROM (SELECT *, sample_idx // 64 AS fragment FROM v) JOIN f USING (track, fragment)",
    "checks": f"WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS s, p_retailprice AS price FROM part), e AS (SELECT *, CASE WHEN s % 9 <= 0 THEN 'timescale' WHEN s * 100 % 17000 NOT BETWEEN 1 AND 16384 OR s * 7 NOT BETWEEN 1 AND 16384 THEN 'dimensions' WHEN s % 7 NOT BETWEEN 4 AND 4096 THEN 'codec_config' WHEN s % 11 = 0 OR price <= 0 THEN 'target' END AS config_error FROM p) SELECT p_partkey, config_error, {TEXT('config_error')} AS config_text, CASE WHEN s % 10 = 0 THEN 'empty' WHEN s % 10 * 10000000 > 67108864 THEN 'too_large' WHEN s * 3000 >= 100000 THEN 'too_many' END AS sample_error, CASE WHEN s % 2 > 0 THEN 'after_samples' WHEN price < 1200 THEN 'duration' END AS restore_error, CASE WHEN s % 5 = 0 THEN 'audio_after_start' WHEN s % 4 = 0 THEN 'timescale' WHEN s * 2000 NOT BETWEEN 8 AND 65536 THEN 'audio_config' END AS audio_error, CASE WHEN s % 3 = 0 THEN 'no_audio' WHEN s % 6 = 0 THEN 'empty' END AS audio_sample_error FROM e",
    "support_report": "SELECT * FROM (VALUES ('remux', true, NULL), ('resume', true, NULL), ('seamless_resume', true, NULL), ('transcode', false, 'decoding and encoding need a codec, which this engine doesn''t have')) t(feature, available, reason)",
    "encoder_codecs": f"WITH {SRC}, b AS (SELECT source, ((width + 15) // 16) * ((height + 15) // 16) AS mb FROM src) SELECT source, array_to_string(list_transform([['4d00', '6400', '4200'], ['6400', '4d00', '4200'], ['4200', '4d00', '6400']][source % 3 + 1], lambda p: 'avc1.' || p || {LEVEL}), ',') AS codecs FROM b",
    "upload_requests": f"WITH {OUTPUTS} SELECT page_id, 0::BIGINT AS store, 'PUT' AS method, url || '?sig=x' AS target, 'Content-Type: ' || {KIND} || '; x-ms-blob-type: BlockBlob' AS headers FROM o UNION ALL SELECT page_id, 1, 'PUT', 'videos/u/' || job || '/' || name, 'Cache-Control: ' || {CACHE} || '; Content-Type: ' || {KIND} FROM o UNION ALL SELECT page_id, 2, 'POST', 'videos/u/' || job || '/' || name, 'Cache-Control: ' || {SECONDS} || '; Content-Type: ' || {KIND} || '; x-upsert: true' FROM o UNION ALL SELECT page_id, 3, 'POST', 'bucket/hls-' || name, 'Content-Type: ' || {KIND} || '; x-file-name: ' || name FROM o UNION ALL SELECT page_id, 4, 'PUT', 'u/' || job || '/' || name, 'Cache-Control: ' || {CACHE} || '; Content-Type: ' || {KIND} FROM o",
    "upload_errors": f"WITH {OUTPUTS}, e AS (SELECT *, [403, 429, 500, 404][page_id % 4 + 1] AS status, ['SlowDown', 'AccessDenied', 'Bucket not found', 'missing scope', 'odd'][page_id % 5 + 1] AS reason, page_id % 3 > 0 AS known FROM o) SELECT page_id, 0::BIGINT AS store, 'Upload failed for \"' || name || '\": ' || status || ' ' || reason || ' (' || {BARE} || '?<redacted>)' AS text, status IN (403, 404) AS permanent FROM e UNION ALL SELECT page_id, 1, 'S3 upload failed for \"hls/' || name || '\"' || CASE WHEN known THEN ' (HTTP ' || status || ')' ELSE '' END || ': ' || reason, known AND status IN (403, 404) OR reason = 'AccessDenied' FROM e UNION ALL SELECT page_id, 2, 'Supabase upload failed for \"hls/' || name || '\": ' || reason, known AND status IN (403, 404) OR reason = 'Bucket not found' FROM e UNION ALL SELECT page_id, 3, 'Appwrite upload failed for \"' || name || '\" (id id): ' || reason, known AND status IN (403, 404) OR reason = 'missing scope' FROM e UNION ALL SELECT page_id, 4, 'Firebase upload failed for \"hls/' || name || '\": ' || reason, reason = 'AccessDenied' FROM e",
    "upload_outcomes": f"WITH {OUTPUTS} SELECT name, CASE WHEN page_id % 7 = 0 THEN 'PermanentUploadError: tried 1' WHEN page_id % 3 = 0 THEN 'OSError: tried 3' END AS error FROM o",
    "archive_parts": f"WITH {OUTPUTS}, e AS (SELECT job, row_number() OVER (PARTITION BY job ORDER BY page_id) - 1 AS part, 'd/' || name AS name, 30 + strlen('d/' || name) + strlen(html) AS size FROM o), p AS (SELECT job, part, CAST(coalesce(sum(size) OVER (PARTITION BY job ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\", CAST(size AS BIGINT) AS size, name, '504b0304' AS mark FROM e) SELECT * FROM p UNION ALL SELECT job, count(*), CAST(sum(size) AS BIGINT), CAST(sum(46 + strlen(name)) + 22 AS BIGINT), '', '504b0102' FROM p GROUP BY job",
    "main_playlists": f"WITH {OUTPUTS} SELECT job, coalesce(arg_max(name, page_id) FILTER (name LIKE '%master%'), arg_min(name, page_id)) AS main FROM o WHERE is_manifest GROUP BY job",
    "job_progress": "SELECT o_custkey AS owner, count(*) FILTER (o_orderstatus = 'F') AS processed, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') / count(*) AS fraction FROM orders GROUP BY owner",
    "job_snapshots": f"WITH {OUTPUTS} SELECT page_id, name, is_manifest, 'job-' || job AS job_id FROM o",
    "frame_samples": f"WITH {V}, f AS (SELECT track, event_id AS frame, us * 16 + sample_idx % 16 AS us, event_id % 7 * 16 + 320 AS w, event_id % 5 * 16 + 240 AS h FROM v) SELECT track, frame, us, row_number() OVER o - 1 AS sample_idx, coalesce(lead(us) OVER o - us, 0) AS duration, first_value(w) OVER o AS width, first_value(h) OVER o AS height FROM f WINDOW o AS (PARTITION BY track ORDER BY us)",
    "segmenter_progress": SEGMENTS + "SELECT track, max(seg_idx) + 1 AS next_segment, track IN (SELECT track FROM v WHERE event_type = 'error') AS has_audio, 't' || track || '_init.mp4' AS init, 't' || track || '.m3u8' AS playlist FROM s GROUP BY track",
    "oldest_segments": SEGMENTS + "SELECT track, seg_idx, n, bytes FROM s WHERE seg_idx >= track % 4 QUALIFY row_number() OVER (PARTITION BY track ORDER BY seg_idx) = 1",
    "descriptor_lengths": "WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) % 268435456 AS p FROM orders), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN p % 20000 ELSE p END AS n FROM o) SELECT o_orderkey, CASE WHEN n >= 2097152 THEN printf('%02x', (n >> 21) % 128 + 128) ELSE '' END || CASE WHEN n >= 16384 THEN printf('%02x', (n >> 14) % 128 + 128) ELSE '' END || CASE WHEN n >= 128 THEN printf('%02x', (n >> 7) % 128 + 128) ELSE '' END || printf('%02x', n % 128) AS written, n, coalesce(CASE WHEN n < 16384 THEN n END, -1) AS cut_off FROM n",
    "engine_version": f"SELECT '{__version__}' AS version",
    "truncated_stores": "SELECT * FROM (VALUES ('jobs', 0::BIGINT), ('outputs', 0::BIGINT)) t(store, rows)",
    "routed_messages": "SELECT user_id AS job_id, event_id, c_nationkey AS handler FROM events JOIN customer ON c_custkey = user_id WHERE c_custkey % 3 = 0",
    "streamed_segments": f"WITH RECURSIVE {STREAM} SELECT track, seg_idx, first_sample, n, ticks, bytes, n_audio, audio_ticks, audio_bytes FROM g WHERE n > 0",
}
