"""Constants, limits and error classes of the data model."""

from __future__ import annotations

#: Content types.
MIME_MANIFEST = "application/vnd.apple.mpegurl"
MIME_SEGMENT = "video/mp4"
MIME_VTT = "text/vtt"

#: Cache policies.
CACHE_SEGMENT = "public, max-age=31536000, immutable"
CACHE_MANIFEST = "public, max-age=60"
CACHE_SECONDS_SEGMENT, CACHE_SECONDS_MANIFEST = 31_536_000, 60

#: Limits.
MAX_SAMPLES = 5_000_000
MAX_CODEC_CONFIG = 4_096
MAX_DIMENSION = 16_384
MAX_SAMPLE_BYTES = 64 * 1024 * 1024
MAX_PENDING = 100_000
MAX_MOOV, MAX_MOOF = 256 * 1024 * 1024, 32 * 1024 * 1024
READ_WINDOW = 4 * 1024 * 1024
MAX_KEY = 128
MAX_STORAGE_ID = 36
MAX_ZIP_ENTRIES, MAX_ZIP_BYTES = 65_535, 0xFFFFFFFF

#: Rungs (height, bitrate) of the named ladders, in order.
LADDERS = {
    "single": [(720, 2_800_000)],
    "mobile": [(720, 2_000_000), (480, 900_000), (360, 500_000)],
    "standard": [(1080, 5_000_000), (720, 2_800_000), (480, 1_200_000)],
    "wide": [(1080, 5_000_000), (720, 2_800_000), (480, 1_200_000), (360, 600_000)],
    "uhd": [(2160, 16_000_000), (1440, 10_000_000), (1080, 5_000_000), (720, 2_800_000)],
}
DEFAULT_LADDER = "standard"

#: Level byte, most macroblocks of a frame, most macroblocks a second.
LEVELS = [
    (0x1E, 1_620, 40_500),
    (0x1F, 3_600, 108_000),
    (0x20, 5_120, 216_000),
    (0x28, 8_192, 245_760),
    (0x29, 8_192, 245_760),
    (0x2A, 8_704, 522_240),
    (0x32, 22_080, 589_824),
    (0x33, 36_864, 983_040),
    (0x34, 36_864, 2_073_600),
]
HIGHEST_LEVEL = 0x34

#: Profiles of encoders in order of preference, with the first two bytes of their codec strings.
PROFILES = {"main": "4d00", "high": "6400", "baseline": "4200"}
#: Rungs that all ladders together may have.
MAX_RUNGS = 10_000
#: Texts of errors.
ERRORS = {
    "timescale": "timescale must be greater than zero",
    "dimensions": "width and height must be within 1..=16384",
    "codec_config": "codec_config (avcC) is empty or implausibly large",
    "target": "target_seconds must be a positive, finite number",
    "empty": "sample data is empty",
    "too_large": "sample exceeds the maximum allowed size",
    "too_many": "segment exceeded the maximum sample count; is the source missing keyframes?",
    "after_samples": "restoreSegment must be called before any sample is pushed",
    "duration": "restored segment duration must be finite and non-negative",
    "audio_after_start": "setAudio must be called before packaging begins",
    "audio_config": "audio sample entry is missing or implausibly large",
    "no_audio": "pushAudioSample requires setAudio to have been called",
    "no_moov": "no moov box found; is this an MP4?",
    "no_video": "no supported H.264 video track found",
    "too_many_samples": "file declares more samples than this build will process",
    "inconsistent": "sample tables are inconsistent",
    "no_samples": "the video track contains no samples",
}
MAX_SAMPLE_ENTRY = 65_536
PERMANENT_STATUS = (400, 401, 403, 404)


class NotAvailable(NotImplementedError):
    """Raised where a codec would be needed: media is never decoded or encoded here."""


def transcode_pixels(*_: object, **__: object) -> None:
    raise NotAvailable("decoding and encoding need a codec, which this engine doesn't have")
