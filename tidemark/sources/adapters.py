"""Upload adapters as columns: the request that stores an output in each kind of store, and the errors that come back.

A request is a struct of method, target and headers (a map), made from the columns of outputs (name, content_type,
is_manifest), so it is planned and tested like any other column; sinks.upload_all hands it to whatever sends it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.names import cache_policy, join_key, redact_url, storage_id
from tidemark.model import CACHE_SECONDS_MANIFEST, CACHE_SECONDS_SEGMENT, PERMANENT_STATUS

#: Names and messages of errors that trying again can't help.
PERMANENT = {
    "s3": "AccessDenied|InvalidAccessKeyId|SignatureDoesNotMatch|NoSuchBucket|ExpiredToken",
    "supabase": "(?i)row-level security|not authorized|Bucket not found|invalid",
    "appwrite": "(?i)not authorized|missing scope|Bucket with the requested ID could not be found",
}


def _request(method: str, target: Column, **headers: Column) -> Column:
    pairs = [x for name, value in headers.items() for x in (F.lit(name.replace("_", "-")), value.cast("string"))]
    return F.struct(F.lit(method).alias("method"), target.alias("target"), F.create_map(*pairs).alias("headers"))


def presigned(url: Column, content_type: Column, method: str = "PUT", headers: Column | None = None) -> Column:
    """To a signed address; headers (a map) are those that its signature covers, and may differ by output."""
    if method not in ("PUT", "POST"):
        raise ValueError("a signed address takes PUT or POST")
    own = F.create_map(F.lit("Content-Type"), content_type)
    if headers is not None:
        own = F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(headers, k)), headers)
    return F.struct(F.lit(method).alias("method"), url.alias("target"), own.alias("headers"))


def s3(bucket: str, prefix: Column, name: Column, content_type: Column, is_manifest: Column) -> Column:
    return _request("PUT", F.concat(F.lit(f"{_named(bucket, 'bucket')}/"), join_key(prefix, name)), Content_Type=content_type, Cache_Control=cache_policy(is_manifest))


def supabase(bucket: str, prefix: Column, name: Column, content_type: Column, is_manifest: Column, upsert: bool = True) -> Column:
    target = F.concat(F.lit(f"{_named(bucket, 'bucket')}/"), join_key(prefix, name))
    return _request("POST", target, Content_Type=content_type, Cache_Control=_seconds(is_manifest), x_upsert=F.lit("true" if upsert else "false"))


def appwrite(bucket: str, prefix: Column, name: Column, content_type: Column) -> Column:
    """Created under an id that the store takes; the name stays as it is."""
    return _request("POST", F.concat(F.lit(f"{_named(bucket, 'bucket id')}/"), storage_id(prefix, name)), Content_Type=content_type, x_file_name=name)


def firebase(prefix: Column, name: Column, content_type: Column, is_manifest: Column) -> Column:
    return _request("PUT", join_key(prefix, name), Content_Type=content_type, Cache_Control=cache_policy(is_manifest))


def _named(bucket: str, what: str) -> str:
    if not bucket:
        raise ValueError(f"a {what} is required")
    return bucket


def _seconds(is_manifest: Column) -> Column:
    return F.when(is_manifest, CACHE_SECONDS_MANIFEST).otherwise(CACHE_SECONDS_SEGMENT)


def is_permanent(kind: str, status: Column, message: Column) -> Column:
    """If trying again can't help: by status, or by what the store says."""
    return F.coalesce(status.isin(*PERMANENT_STATUS), F.lit(False)) | F.coalesce(message.rlike(PERMANENT[kind]), F.lit(False))


def presigned_error(name: Column, status: Column, reason: Column, url: Column) -> Column:
    """What a failed upload says; the address goes without its signature."""
    return F.concat(F.lit('Upload failed for "'), name, F.lit('": '), status.cast("string"), F.lit(" "), reason, F.lit(" ("), redact_url(url), F.lit(")"))


def s3_error(key: Column, status: Column, name: Column) -> Column:
    return F.concat(F.lit('S3 upload failed for "'), key, F.lit('"'), F.when(status.isNull(), "").otherwise(F.concat(F.lit(" (HTTP "), status.cast("string"), F.lit(")"))), F.lit(": "), name)


def supabase_error(path: Column, message: Column) -> Column:
    return F.concat(F.lit('Supabase upload failed for "'), path, F.lit('": '), message)


def appwrite_error(name: Column, file_id: Column, message: Column) -> Column:
    return F.concat(F.lit('Appwrite upload failed for "'), name, F.lit('" (id '), file_id, F.lit("): "), message)


def firebase_error(path: Column, message: Column) -> Column:
    return F.concat(F.lit('Firebase upload failed for "'), path, F.lit('": '), message)
