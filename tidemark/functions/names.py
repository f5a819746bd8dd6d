"""Names, keys and addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.model import CACHE_MANIFEST, CACHE_SEGMENT, MAX_KEY, MAX_STORAGE_ID, PERMANENT_STATUS

from .checksums import fnv1a


def sanitize_key(name: Column) -> Column:
    """Letters, digits, dots, underscores and hyphens only, runs of dots as one, none in front, 128 at most; else "_"."""
    kept = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]", ""), "[.]+", ".")
    cut = F.regexp_replace(F.substring(kept, 1, MAX_KEY), "^[.]+", "")
    return F.when(cut == "", "_").otherwise(cut)


def is_safe_key(key: Column) -> Column:
    bad = key.startswith("/") | key.contains("..") | key.contains("\\") | key.rlike("[\\x00-\\x1f\\x7f]")
    return (F.length(key) > 0) & ~bad


def join_key(prefix: Column, name: Column) -> Column:
    trimmed = F.regexp_replace(F.coalesce(prefix, F.lit("")), "^/+|/+$", "")
    return F.when(trimmed == "", name).otherwise(F.concat(trimmed, F.lit("/"), name))


def zip_safe_name(name: Column) -> Column:
    """Without empty parts, "." and ".."; null if nothing is left."""
    parts = F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/")
    kept = F.array_join(F.filter(parts, lambda p: ~p.isin("", ".", "..")), "/")
    return F.nullif(kept, F.lit(""))


def segment_name(prefix: Column, index: Column) -> Column:
    return F.format_string("%s_%05d.m4s", prefix, index)


def init_name(prefix: Column) -> Column:
    return F.concat(prefix, F.lit("_init.mp4"))


def playlist_name(prefix: Column) -> Column:
    return F.concat(prefix, F.lit(".m3u8"))


def codec_string(config: Column) -> Column:
    """From a codec record; null if it is too short."""
    return F.when(F.octet_length(config) >= 4, F.concat(F.lit("avc1."), F.lower(F.hex(F.substring(config, 2, 3)))))


def aac_codec(config: Column) -> Column:
    first = F.conv(F.hex(F.substring(config, 1, 1)), 16, 10).cast("int")
    return F.concat(F.lit("mp4a.40."), F.when(F.octet_length(config) > 0, F.shiftright(first, 3)).otherwise(F.lit(2)).cast("string"))


def descriptor_length(n: Column) -> Column:
    """A length as descriptors have it: seven bits a byte, the highest first, all but the last marked; up to 28 bits."""
    part = lambda k: F.when(n >= 128**k, F.lpad(F.hex(F.shiftright(n, 7 * k).bitwiseAND(127).bitwiseOR(128)), 2, "0")).otherwise("")
    return F.unhex(F.concat(part(3), part(2), part(1), F.lpad(F.hex(n.bitwiseAND(127)), 2, "0")))


def length_of_descriptor(data: Column) -> Column:
    """The length that bytes begin with; null if they end before it does."""
    byte = lambda k: F.conv(F.hex(F.substring(data, k, 1)), 16, 10).cast("long")
    value, found = F.lit(0).cast("long"), F.lit(None).cast("long")
    for k in range(4, 0, -1):
        value = F.lit(0).cast("long")
        for j in range(1, k + 1):
            value = value * 128 + byte(j).bitwiseAND(127)
        found = F.when(byte(k) < 128, value).otherwise(found)
    return found


def storage_id(prefix: Column, name: Column) -> Column:
    """An id of at most 36 characters; longer names keep their tail behind a hash of the whole."""
    raw = F.when(F.coalesce(prefix, F.lit("")) == "", name).otherwise(F.concat(prefix, F.lit("-"), name))
    cleaned = F.regexp_replace(F.regexp_replace(raw, "[^a-zA-Z0-9._-]", "-"), "^[^a-zA-Z0-9]+", "")
    hashed = F.substring(F.lpad(F.lower(F.conv(fnv1a(raw).cast("string"), 10, 36)), 7, "0"), 1, 7)
    short = F.when(cleaned == "", "f").otherwise(cleaned)
    return F.when(F.length(cleaned) <= MAX_STORAGE_ID, short).otherwise(F.concat(hashed, F.lit("-"), F.substring(cleaned, -28, 28)))


def redact_url(url: Column) -> Column:
    return F.regexp_replace(url, "(?s)\\?.*$", "?<redacted>")


def srt_to_vtt(srt: Column) -> Column:
    lines = F.regexp_replace(F.regexp_replace(srt, "\\r\\n", "\n"), "^\\x{FEFF}", "")
    dotted = F.regexp_replace(lines, "(\\d{2}:\\d{2}:\\d{2}),(\\d{3})", "$1.$2")
    return F.concat(F.lit("WEBVTT\n\n"), F.regexp_replace(dotted, "^[\\s\\x{FEFF}]+|[\\s\\x{FEFF}]+$", ""), F.lit("\n"))


def to_vtt(content: Column) -> Column:
    return F.when(F.regexp_replace(content, "^[\\s\\x{FEFF}]+", "").startswith("WEBVTT"), content).otherwise(srt_to_vtt(content))


def track_stem(prefix: Column, language: Column) -> Column:
    tag = F.regexp_replace(language, "[^A-Za-z0-9-]", "")
    return F.concat(prefix, F.lit("_sub_"), F.when(tag == "", "und").otherwise(tag))


def quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit("")), F.lit('"'))


def cache_policy(is_manifest: Column) -> Column:
    return F.when(is_manifest, CACHE_MANIFEST).otherwise(CACHE_SEGMENT)


def error_class(status: Column, name: Column) -> Column:
    """permanent: retrying can't help."""
    denied = F.lower(F.coalesce(name, F.lit(""))).rlike("accessdenied|unauthorized|forbidden|notfound|nosuchbucket|invalid")
    return F.when(status.isin(*PERMANENT_STATUS) | denied, "permanent").otherwise("retryable")


def retry_ceiling_ms(attempt: Column) -> Column:
    return F.least(F.lit(300) * F.pow(F.lit(2), attempt), F.lit(10_000)).cast("long")


def format_bytes(count: Column) -> Column:
    """In units of 1024; one decimal under 10 beyond bytes."""
    def shown(unit: str, power: int) -> Column:
        tenths = F.floor(count * 10 / F.lit(1024**power) + 0.5).cast("long")
        whole = F.floor(count / F.lit(1024**power) + 0.5).cast("long")
        small = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
        return F.concat(F.when(count < 10 * 1024**power, small).otherwise(whole.cast("string")), F.lit(f" {unit}"))

    return F.when(count < 1024, F.concat(count.cast("string"), F.lit(" B"))).when(count < 1024**2, shown("KB", 1)).when(count < 1024**3, shown("MB", 2)).otherwise(shown("GB", 3))


def dos_time(ts: Column) -> Column:
    return F.floor(F.second(ts) / 2).cast("long").bitwiseOR(F.shiftleft(F.minute(ts), 5).cast("long")).bitwiseOR(F.shiftleft(F.hour(ts), 11).cast("long"))


def dos_date(ts: Column) -> Column:
    years = F.greatest(F.lit(0), F.year(ts) - 1980).bitwiseAND(0x7F)
    return F.dayofmonth(ts).cast("long").bitwiseOR(F.shiftleft(F.month(ts), 5).cast("long")).bitwiseOR(F.shiftleft(years, 9).cast("long"))


def job_id(*identity: Column) -> Column:
    """The same job for the same identity; a clock or chance would change it when a task is run again."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *identity), 256), 1, 16)
