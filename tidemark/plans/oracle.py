"""DuckDB SQL for the queries of catalogue.py."""

from __future__ import annotations

from tidemark.model import HIGHEST_LEVEL, LADDERS, LEVELS

DAY = 86_400_000_000
TARGET = 2 * DAY
V = """v AS (SELECT user_id AS track, event_id, event_type, epoch_us(ts) AS us, row_number() OVER w - 1 AS sample_idx,
 coalesce(lead(epoch_us(ts)) OVER w - epoch_us(ts), 0) AS duration, event_type = 'view' AS is_sync, CAST(round(value * 100) AS BIGINT) AS size
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def cut(source: str = "v") -> str:
    """Segments of the samples of source, as s."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY sample_idx) AS rn FROM {source}),
r(track, rn, seg, pend) AS (SELECT track, rn, 0::BIGINT, duration::BIGINT FROM o WHERE rn = 1 UNION ALL
 SELECT o.track, o.rn, CASE WHEN o.is_sync AND r.pend >= {TARGET} THEN r.seg + 1 ELSE r.seg END, CASE WHEN o.is_sync AND r.pend >= {TARGET} THEN o.duration ELSE r.pend + o.duration END
 FROM r JOIN o ON o.track = r.track AND o.rn = r.rn + 1),
s AS (SELECT o.track, r.seg AS seg_idx, min(o.sample_idx) AS first_sample, count(*) AS n, CAST(sum(o.duration) AS BIGINT) AS ticks, CAST(sum(o.size) AS BIGINT) AS bytes, min(o.us) AS start_us
 FROM o JOIN r ON o.track = r.track AND o.rn = r.rn GROUP BY ALL)"""


SEGMENTS = f"WITH RECURSIVE {V}, {cut()} "
SRC = "src AS (SELECT p_partkey AS source, CAST(((240 + 40 * p_size) * 16 + 4) // 9 AS BIGINT) AS width, CAST(240 + 40 * p_size AS BIGINT) AS height FROM part)"
LAD = "lad(ladder, ord, height, bitrate) AS (VALUES " + ", ".join(f"('{n}', {k}::BIGINT, {h}::BIGINT, {b}::BIGINT)" for n, rungs in LADDERS.items() for k, (h, b) in enumerate(rungs)) + ")"
EVEN = lambda x: f"greatest(2, ({x} + 1) // 2 * 2)"
PLAN = f"""pr AS (SELECT source, s.width AS sw, s.height AS sh, ladder, ord, lad.height AS h, bitrate, lad.height <= s.height AS fits FROM src s CROSS JOIN lad),
fx AS (SELECT source, ladder, sw, sh, max(h) FILTER (fits) AS tallest, min(bitrate) AS least, bool_or(NOT fits) AS dropped, arg_min(bitrate, h * 100 + ord) FILTER (NOT fits) AS promoted FROM pr GROUP BY ALL),
al AS (SELECT source, ladder, sw, sh, ord, h, bitrate FROM pr WHERE fits UNION ALL SELECT source, ladder, sw, sh, 0, sh, least FROM fx WHERE tallest IS NULL
 UNION ALL SELECT source, ladder, sw, sh, -1, sh, promoted FROM fx WHERE dropped AND tallest IS NOT NULL AND {EVEN('tallest')} < {EVEN('sh')}),
rk AS (SELECT *, {EVEN('h')} AS eh, row_number() OVER (PARTITION BY source, ladder, {EVEN('h')} ORDER BY bitrate DESC, ord) AS k FROM al),
pl AS (SELECT source, ladder, CAST({EVEN('((sw * eh * 2 + sh) // (sh * 2))')} AS BIGINT) AS width, CAST(eh AS BIGINT) AS height, bitrate FROM rk WHERE k = 1)"""
SEC = "(((greatest(ticks, 0) * 2000000 + 1000000) // 2000000) // 1000000) || '.' || lpad(CAST(((greatest(ticks, 0) * 2000000 + 1000000) // 2000000) % 1000000 AS VARCHAR), 6, '0')"
PLAYLISTS = f"""pls AS (SELECT track, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-TARGETDURATION:172800' || chr(10) || '#EXT-X-MEDIA-SEQUENCE:0' || chr(10) || '#EXT-X-PLAYLIST-TYPE:VOD' || chr(10) || '#EXT-X-MAP:URI="t' || track || '_init.mp4"' || chr(10)
 || string_agg('#EXTINF:' || {SEC} || ',' || chr(10) || 't' || track || '_' || lpad(CAST(seg_idx AS VARCHAR), 5, '0') || '.m4s', chr(10) ORDER BY seg_idx) || chr(10) || '#EXT-X-ENDLIST' || chr(10) AS playlist FROM s GROUP BY track)"""
REFS = """ln AS (SELECT track, generate_subscripts(string_split(playlist, chr(10)), 1) AS k, unnest(string_split(playlist, chr(10))) AS line FROM pls),
rf AS (SELECT track, k, CASE WHEN line LIKE '#%' THEN regexp_extract(line, 'URI="([^"]*)"', 1) ELSE line END AS name FROM ln WHERE trim(line) <> ''),
rn AS (SELECT track, k, name, row_number() OVER (PARTITION BY track ORDER BY k) - 1 AS n FROM rf WHERE name <> '')"""
MASTERS = f"""ms AS (SELECT source, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || string_agg('#EXT-X-STREAM-INF:BANDWIDTH=' || bitrate || ',RESOLUTION=' || width || 'x' || height || ',CODECS="avc1.4d401f,mp4a.40.2"' || chr(10) || 's' || source || '_' || height || 'p.m3u8', chr(10) ORDER BY bitrate DESC, 's' || source || '_' || height || 'p.m3u8') || chr(10) AS playlist FROM pl WHERE ladder = 'wide' GROUP BY source)"""
CLOCK = lambda s: f"lpad(CAST({s} // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST({s} // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0')"
CUES = lambda dot, eol: f"string_agg((turn + 1) || {eol} || {CLOCK('(turn * 2)')} || '{dot}000 --> ' || {CLOCK('(turn * 2 + 2)')} || '{dot}000' || {eol} || text || {eol}, {eol} ORDER BY turn)"
VTT = f"SELECT conv_id, 'WEBVTT' || chr(10) || chr(10) || regexp_replace({CUES('.', 'chr(10)')}, '^\\s+|\\s+$', '', 'g') || chr(10) AS vtt FROM conversations GROUP BY conv_id"
SANITIZED = lambda x: f"coalesce(nullif(regexp_replace(substring(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9._-]', '', 'g'), '[.]+', '.', 'g'), 1, 128), '^[.]+', ''), ''), '_')"
PATH = "regexp_extract(url, '://[^/]*(.*)$', 1)"
SAFE = lambda x: f"(length({x}) > 0 AND NOT (starts_with({x}, '/') OR contains({x}, '..') OR contains({x}, '\\') OR regexp_matches({x}, '[\\x00-\\x1f\\x7f]')))"
JOBS = "j AS (SELECT o_orderkey AS job_id, o_custkey AS owner, CAST(round(o_totalprice * 100) AS BIGINT) AS size, CASE o_orderstatus WHEN 'P' THEN 'processing' WHEN 'F' THEN 'done' ELSE 'failed' END AS status, epoch_us(o_orderdate) AS updated_at FROM orders)"
OUTS = "u AS (SELECT l_orderkey AS job_id, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes, NOT bool_or(l_returnflag = 'R') AS uploaded FROM lineitem GROUP BY l_orderkey)"
ISLANDS = """rg AS (SELECT track, sample_idx, CAST(coalesce(sum(size + CASE WHEN event_type = 'error' THEN 7 ELSE 0 END) OVER (PARTITION BY track ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", size FROM v)"""
TARGETS = f"tg AS (SELECT track, 1704067200000000 + d * {DAY} AS us FROM (SELECT DISTINCT user_id AS track FROM events) CROSS JOIN range(30) t(d))"
SHOWN = lambda n, unit, p: f"CASE WHEN {n} < {10 * 1024**p} THEN (CAST(floor({n} * 10 / {1024**p}.0 + 0.5) AS BIGINT) // 10) || '.' || (CAST(floor({n} * 10 / {1024**p}.0 + 0.5) AS BIGINT) % 10) ELSE CAST(CAST(floor({n} / {1024**p}.0 + 0.5) AS BIGINT) AS VARCHAR) END || ' {unit}'"
BYTES = lambda n: f"CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < 1048576 THEN {SHOWN(n, 'KB', 1)} WHEN {n} < 1073741824 THEN {SHOWN(n, 'MB', 2)} ELSE {SHOWN(n, 'GB', 3)} END"
NEW = "chr(10)"
MEDIA = "'#EXT-X-MEDIA:TYPE=SUBTITLES,GROUP-ID=\"subs\",NAME=\"{n}\",LANGUAGE=\"{l}\",DEFAULT={d},AUTOSELECT={a}{f},URI=\"video_sub_{s}.m3u8\"'"
TRACKS = f" || {NEW} || ".join(
    MEDIA.format(n=n, l=lang, d=d, a=a, f=f, s=s) for n, lang, d, a, f, s in (("English", "en", "YES", "YES", "", "en"), ("Português", "pt-BR", "NO", "YES", "", "pt-BR"), ("Signs", "??", "NO", "NO", ",FORCED=YES", "und"))
)
LISTING = f"'#EXTM3U' || {NEW} || '#EXT-X-VERSION:3' || {NEW} || '#EXT-X-TARGETDURATION:62' || {NEW} || '#EXT-X-MEDIA-SEQUENCE:0' || {NEW} || '#EXTINF:61.250,' || {NEW} || stem || '.vtt' || {NEW} || '#EXT-X-ENDLIST' || {NEW}"

FNV = lambda x: f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({x}, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
RAW = "('video-' || url)"
DIGITS = " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((h // {36**k}) % 36 + 1 AS BIGINT), 1)" for k in range(6, -1, -1))

ORACLE: dict[str, str] = {
    "byte_sums": f"WITH c AS (SELECT page_id, ord(unnest(string_split(url, ''))) AS b, generate_subscripts(string_split(url, ''), 1) AS k, length(url) AS n FROM pages), t AS (SELECT page_id, CAST(sum(b) % 65535 AS BIGINT) AS lo, CAST(sum((n - k + 1) * b) % 65535 AS BIGINT) AS hi FROM c GROUP BY page_id) SELECT page_id, hi * 65536 + lo AS fletcher, {FNV('url')} AS fnv1a FROM pages JOIN t USING (page_id)",
    "storage_id": f"WITH c AS (SELECT page_id, {FNV(RAW)} AS h, regexp_replace(regexp_replace({RAW}, '[^a-zA-Z0-9._-]', '-', 'g'), '^[^a-zA-Z0-9]+', '') AS x FROM pages) SELECT page_id, CASE WHEN length(x) <= 36 THEN x ELSE {DIGITS} || '-' || right(x, 28) END AS id FROM c",
    "sample_index": f"WITH {V} SELECT track, sample_idx, duration, is_sync, size, CAST(coalesce(sum(duration) OVER (PARTITION BY track ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS decode_time FROM v",
    "track_summary": f"WITH {V}, a AS (SELECT track, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(duration) AS BIGINT) AS ticks, count(*) FILTER (is_sync) AS keyframes FROM v GROUP BY track) SELECT *, CAST(CASE WHEN ticks > 0 THEN coalesce(nullif((n * 2 * {DAY} + ticks) // (2 * ticks), 0), 30) ELSE 30 END AS BIGINT) AS samples_per_day FROM a",
    "gop_collapse": f"WITH {V}, g AS (SELECT *, CAST(sum(CAST(is_sync AS BIGINT)) OVER (PARTITION BY track ORDER BY sample_idx) AS BIGINT) AS gop FROM v) SELECT track, gop, CAST(sum(duration) AS BIGINT) AS ticks, count(*) AS n FROM g GROUP BY ALL",
    "rle_expand": "WITH e AS (SELECT p_brand, p_partkey, unnest(range(p_size)) AS k FROM part) SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, k) - 1 AS sample_idx, p_partkey FROM e",
    "chunk_run_asof": "WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS key, c_custkey AS chunk FROM customer), r AS (SELECT CAST(s_nationkey AS BIGINT) AS key, s_suppkey * 10 AS chunk, s_suppkey AS run FROM supplier) SELECT c.key, c.chunk, coalesce(r.run, -1) AS run FROM c ASOF LEFT JOIN r ON c.key = r.key AND c.chunk >= r.chunk",
    "chunk_offsets": f"WITH {V} SELECT track, sample_idx, sample_idx // 8 AS chunk, CAST(sample_idx // 8 * 1000000 + coalesce(sum(size) OVER (PARTITION BY track, sample_idx // 8 ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM v",
    "run_offsets": f"WITH {V}, g AS (SELECT *, CASE WHEN event_type = 'purchase' THEN sample_idx * 100 END AS d, count(CASE WHEN event_type = 'purchase' THEN 1 END) OVER (PARTITION BY track ORDER BY sample_idx) AS grp FROM v) SELECT track, sample_idx, CAST(1000 + coalesce(first(d) OVER (PARTITION BY track, grp ORDER BY sample_idx), 0) + coalesce(sum(size) OVER (PARTITION BY track, grp ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM g",
    "sync_membership_semi": "SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)",
    "sync_membership_anti": "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 10)",
    "sync_flags": f"WITH {V} SELECT track, sample_idx, is_sync OR track % 3 = 0 AS is_sync FROM v",
    "defaults_cascade": "SELECT l_orderkey, CAST(sum(coalesce(nullif(CAST(l_quantity AS BIGINT) % 3, 0), nullif(p_size % 2, 0), 0)) AS BIGINT) AS total, count(*) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey",
    "segment_keyframe": SEGMENTS + "SELECT track, seg_idx, first_sample, n, ticks, bytes FROM s",
    "segment_timeline": SEGMENTS + ", b AS (SELECT *, CAST(coalesce(sum(ticks) OVER (PARTITION BY track ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM s) SELECT track, seg_idx, base, base + ticks AS until, ticks FROM b",
    "segment_target_check": SEGMENTS + f"SELECT track, CAST({TARGET} AS BIGINT) AS declared, max(ticks) AS longest, max(ticks) <= {TARGET} AS target_ok, count(*) AS n FROM s GROUP BY track",
    "resume_equals_full": SEGMENTS + "SELECT track, seg_idx, first_sample, n, ticks, bytes FROM s",
    "resume_skip": f"WITH {V} SELECT track, sample_idx, us FROM v WHERE sample_idx >= greatest(track % 40 - 5, 0)",
    "forced_keyframes": f"WITH RECURSIVE {V}, r(track, sample_idx, us, last) AS (SELECT track, sample_idx, us, us FROM v WHERE sample_idx = 0 UNION ALL SELECT v.track, v.sample_idx, v.us, CASE WHEN v.us - r.last >= {DAY} THEN v.us ELSE r.last END FROM r JOIN v ON v.track = r.track AND v.sample_idx = r.sample_idx + 1) SELECT track, sample_idx, us FROM r WHERE us = last",
    "read_islands": f"WITH {V}, {ISLANDS}, g AS (SELECT *, CASE WHEN lag(\"offset\" + size) OVER (PARTITION BY track ORDER BY sample_idx) <> \"offset\" THEN 1 ELSE 0 END AS gap FROM rg), i AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY track ORDER BY sample_idx) AS BIGINT) AS island FROM g) SELECT track, island, min(\"offset\") AS \"offset\", CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n FROM i GROUP BY ALL",
    "read_islands_capped": f"WITH RECURSIVE {V}, {ISLANDS}, r(track, sample_idx, island, b, e, size) AS (SELECT track, sample_idx, 0::BIGINT, \"offset\", \"offset\" + size, size FROM rg WHERE sample_idx = 0 UNION ALL SELECT g.track, g.sample_idx, CASE WHEN g.\"offset\" <> r.e OR g.\"offset\" + g.size - r.b > 20000 THEN r.island + 1 ELSE r.island END, CASE WHEN g.\"offset\" <> r.e OR g.\"offset\" + g.size - r.b > 20000 THEN g.\"offset\" ELSE r.b END, g.\"offset\" + g.size, g.size FROM r JOIN rg g ON g.track = r.track AND g.sample_idx = r.sample_idx + 1) SELECT track, island, min(b) AS \"offset\", CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n FROM r GROUP BY ALL",
    "checkpoint_floor": f"WITH {V}, d AS (SELECT track % 10 AS job, (us - 1704067200000000) // {DAY} AS seg FROM v GROUP BY ALL HAVING count(DISTINCT event_type) = 5), k AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY seg) - 1 AS n FROM d) SELECT job, seg FROM k WHERE n = seg",
    "merge_tracks": f"WITH {V}, m AS (SELECT track, us, event_id, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END::BIGINT AS rank FROM v) SELECT track, row_number() OVER (PARTITION BY track ORDER BY us, rank, event_id) - 1 AS pos, us, event_id, rank FROM m",
    "audio_asof_segment": f"WITH RECURSIVE {V}, vid AS (SELECT * FROM v WHERE event_type <> 'click'), {cut('vid')} SELECT a.track, a.event_id, coalesce(s.seg_idx, 0) AS seg_idx FROM (SELECT * FROM v WHERE event_type = 'click') a ASOF LEFT JOIN s ON a.track = s.track AND a.us > s.start_us",
    "sync_at_or_before": f"WITH {V}, {TARGETS} SELECT t.track, t.us, coalesce(k.sample_idx, 0) AS sample_idx FROM tg t ASOF LEFT JOIN (SELECT * FROM v WHERE is_sync) k ON t.track = k.track AND t.us >= k.us",
    "nearest_frame": f"WITH {V}, {TARGETS} SELECT t.track, t.us, coalesce(p.sample_idx, q.sample_idx) AS sample_idx FROM tg t ASOF LEFT JOIN v p ON t.track = p.track AND t.us >= p.us ASOF LEFT JOIN v q ON t.track = q.track AND t.us <= q.us",
    "ticks_to_micros": "SELECT o_orderkey, (CAST(round(o_totalprice * 100) AS BIGINT) * 2000000 + 90000) // 180000 AS us FROM orders",
    "frame_rung_fanout": f"WITH {LAD} SELECT user_id AS track, height, count(*) AS frames, CAST(sum(bitrate // 30) AS BIGINT) AS bits FROM events CROSS JOIN (SELECT * FROM lad WHERE ladder = 'standard') GROUP BY ALL",
    "level_for_frame": f"WITH {SRC}, b AS (SELECT source, ((width + 15) // 16) * ((height + 15) // 16) AS mb FROM src) SELECT source, CAST(CASE " + " ".join(f"WHEN mb <= {m} AND mb * 30 <= {r} THEN {level}" for level, m, r in LEVELS) + f" ELSE {HIGHEST_LEVEL} END AS BIGINT) AS level FROM b",
    "ladder_plan": f"WITH {SRC}, {LAD}, {PLAN} SELECT source, ladder, width, height, bitrate FROM pl",
    "ladder_key": f"WITH {LAD} SELECT ladder, string_agg(height || '@' || bitrate, ',' ORDER BY ord) AS key FROM lad GROUP BY ladder",
    "fit_tile": f"WITH {SRC} SELECT source, least(width, 640) AS width, CASE WHEN width <= 640 THEN height ELSE greatest(1, (height * 1280 + width) // (width * 2)) END AS height FROM src",
    "sprite_layout": "WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS c, CAST(round(p_retailprice * 1000) AS BIGINT) AS d, CAST(ceil(sqrt(p_size)) AS BIGINT) AS w, unnest(range(p_size)) AS i FROM part) SELECT p_partkey, i, i % w AS tile_x, i // w AS tile_y, (d * (2 * i + 1)) // (2 * c) AS target FROM p",
    "media_playlist": SEGMENTS + f", {PLAYLISTS} SELECT track, playlist FROM pls",
    "master_playlist": f"WITH {SRC}, {LAD}, {PLAN}, {MASTERS} SELECT source, playlist FROM ms",
    "playlist_references": SEGMENTS + f", {PLAYLISTS}, {REFS} SELECT track, n, name FROM rn",
    "rewrite_uris": SEGMENTS + f", {PLAYLISTS}, {REFS}, w AS (SELECT l.track, l.k, CASE WHEN r.n % 2 = 0 THEN replace(l.line, r.name, 'https://cdn.example/' || r.name || '?v=1') ELSE l.line END AS line FROM ln l LEFT JOIN rn r ON l.track = r.track AND l.k = r.k) SELECT track, string_agg(line, chr(10) ORDER BY k) AS playlist FROM w GROUP BY track",
    "attach_subtitles": f"WITH {SRC}, {LAD}, {PLAN}, {MASTERS} SELECT source, CASE WHEN source % 2 = 1 THEN playlist ELSE replace(replace(playlist, 'mp4a.40.2\"', 'mp4a.40.2\",SUBTITLES=\"subs\"'), 'VERSION:7' || {NEW}, 'VERSION:7' || {NEW} || {TRACKS} || {NEW}) END AS playlist FROM ms",
    "srt_to_vtt": VTT,
    "subtitle_files": f"WITH c AS ({VTT}), t AS (SELECT conv_id, vtt, 'video_sub_' || ['en', 'de-AT', 'und'][conv_id % 3 + 1] AS stem FROM c) SELECT conv_id, stem || '.vtt' AS name, vtt AS text, 'text/vtt' AS content_type, false AS is_manifest FROM t UNION ALL SELECT conv_id, stem || '.m3u8', {LISTING}, 'application/vnd.apple.mpegurl', true FROM t",
    "sanitize_key": f"SELECT page_id, {SANITIZED('url')} AS key, {SANITIZED(chr(39) + '..!./' + chr(39) + ' || repeat(url, 4)')} AS long_key FROM pages",
    "safe_key": f"SELECT page_id, {SAFE('url')} AS url_safe, {SAFE(PATH)} AS path_safe, {SAFE('(' + chr(39) + 'a/..' + chr(39) + ' || ' + PATH + ')')} AS up_safe FROM pages",
    "join_key": f"SELECT page_id, CASE WHEN regexp_replace({PATH}, '^/+|/+$', '', 'g') = '' THEN 'seg.m4s' ELSE regexp_replace({PATH}, '^/+|/+$', '', 'g') || '/seg.m4s' END AS key FROM pages",
    "zip_safe_name": "SELECT page_id, array_to_string(list_filter(string_split(replace('..\\./' || url, '\\', '/'), '/'), lambda p: p NOT IN ('', '.', '..')), '/') AS name FROM pages",
    "redact_url": "SELECT page_id, regexp_replace(url, '\\?.*$', '?<redacted>') AS url FROM pages",
    "segment_names": SEGMENTS + "SELECT track, seg_idx, 't' || track || '_' || lpad(CAST(seg_idx AS VARCHAR), 5, '0') || '.m4s' AS name, 't' || track || '_init.mp4' AS init, 't' || track || '.m3u8' AS playlist FROM s",
    "cache_policy": "SELECT page_id, CASE WHEN url LIKE '%/' THEN 'public, max-age=60' ELSE 'public, max-age=31536000, immutable' END AS policy FROM pages",
    "error_class": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (1, 2, 3) OR o_custkey % 7 = 0 THEN 'permanent' ELSE 'retryable' END AS class, CAST(least(300 * pow(2, o_orderkey % 8), 10000) AS BIGINT) AS ceiling_ms FROM orders",
    "dos_datetime": "SELECT event_id, (second(ts) // 2) | (minute(ts) << 5) | (hour(ts) << 11) AS \"time\", day(ts) | (month(ts) << 5) | (greatest(0, year(ts) - 1980) << 9) AS \"date\" FROM events",
    "format_bytes": f"SELECT doc_id, {BYTES('n_chars')} AS chars, {BYTES('(n_chars * 977)')} AS many FROM documents",
    "resumable_jobs": f"WITH {JOBS} SELECT job_id, updated_at, row_number() OVER (ORDER BY updated_at DESC, job_id) AS rank FROM j WHERE status = 'processing'",
    "job_upsert": f"WITH {JOBS} SELECT job_id, CASE WHEN job_id % 5 = 0 THEN 'done' ELSE status END AS status, CASE WHEN job_id % 5 = 0 THEN updated_at + 1 ELSE updated_at END AS updated_at FROM j",
    "mark_uploaded": f"WITH {JOBS}, {OUTS} SELECT u.job_id, n, bytes, uploaded OR coalesce(j.status = 'done', false) AS uploaded FROM u LEFT JOIN j ON j.job_id = u.job_id",
    "pending_outputs": f"WITH {OUTS} SELECT job_id, n FROM u WHERE NOT uploaded",
    "cascade_delete": f"WITH {JOBS}, {OUTS} SELECT job_id, 'job' AS kind FROM j WHERE status <> 'failed' UNION ALL SELECT job_id, 'output' FROM u WHERE job_id NOT IN (SELECT job_id FROM j WHERE status = 'failed')",
    "match_source": f"WITH {JOBS}, p AS (SELECT job_id, owner, CASE WHEN job_id % 4 = 0 THEN size + 1 ELSE size END AS size, updated_at FROM j) SELECT job_id FROM p WHERE EXISTS (SELECT 1 FROM j WHERE j.owner = p.owner AND j.size = p.size AND j.updated_at = p.updated_at)",
    "queue_report": f"WITH {JOBS} SELECT owner, count(*) FILTER (status = 'done') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'processing') AS open, coalesce(min(job_id) FILTER (status = 'failed'), -1) AS first_failed FROM j GROUP BY owner",
    "quota_check": f"WITH {OUTS} SELECT job_id, CASE WHEN job_id % 3 = 0 THEN true ELSE n * 30 >= ceil(bytes * 6 / 5) END AS room FROM u",
    "zip_offsets": "SELECT page_id, page_id % 16 AS job, CAST(coalesce(sum(30 + strlen(url) + strlen(html)) OVER (PARTITION BY page_id % 16 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM pages",
    "outputs_union": SEGMENTS + "SELECT track, seg_idx + 1 AS ord, 't' || track || '_' || lpad(CAST(seg_idx AS VARCHAR), 5, '0') || '.m4s' AS name FROM s UNION ALL SELECT track, 0, 't' || track || '_init.mp4' FROM s GROUP BY track UNION ALL SELECT track, max(seg_idx) + 2, 't' || track || '.m3u8' FROM s GROUP BY track",
}
