"""Quality rules: counts over words and lines, and the fertility of public tokenizers.

Fertility is measured on a text's words (maximal runs of characters other than space and \\t to \\r): characters
per token, the share of tokens that are byte fallbacks, and the entropy of the text's tokens, under the
vocabulary of `path`; characters per token also under the byte-level vocabulary of `second`. A text is rejected
outside the band of its script (parameters, wide enough for prose of any language in the script), and below the
floors of its language: floors come from the quartiles of all texts of the same script, language and length that
pass the base rules and the bands, no labels needed. The pieces of each distinct word are found once per process
(bounded cache). The plan is one scan and one Arrow map, whose rows are checkpointed, as the floors rest on all
of them; then an aggregation of a few numbers a row and a join to the floors.

A null or empty text has no words: all counts are 0, base_failed is true, kept false.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, append_texts, checkpoint, held, map_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: White space to str.split() that doesn't end a word here.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
SYMBOLS = "#*$%&|<>"


class Band(NamedTuple):
    """Least and most characters per token, most byte-fallback share, least entropy (bits) of texts of 50 words or more."""

    least_chars: float
    most_chars: float
    most_fallback: float
    least_entropy: float


#: Scripts by their first and last code points; fixed values. Characters below U+0250 are Latin or shared.
SCRIPTS = (("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("indic", 0x900, 0xDFF), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF))
BANDS = {
    "latin": Band(1.25, 7.0, 0.15, 3.5),
    "greek": Band(0.7, 7.0, 0.30, 3.5),
    "cyrillic": Band(1.0, 7.0, 0.15, 3.5),
    "hebrew": Band(0.7, 7.0, 0.30, 3.5),
    "arabic": Band(0.7, 7.0, 0.30, 3.5),
    "indic": Band(0.3, 7.0, 0.90, 2.5),
    "kana": Band(0.5, 7.0, 0.60, 3.5),
    "han": Band(0.4, 7.0, 0.80, 3.5),
    "hangul": Band(0.3, 7.0, 0.90, 3.0),
    "other": Band(0.2, 9.0, 1.00, 2.0),
}


#: Measures with floors, and the decimals that their quartiles are taken over, so that counts of values stay small.
FLOORS = {"chars_per_token": 3, "byte_chars_per_token": 3, "token_entropy": 3}
#: A floor is the median less so many times the spread of the upper half, which texts below hardly move.
WIDTH = 4.0
#: The distance of the upper quartile from the median in standard deviations of a normal distribution.
QUARTILE = 0.6745
#: Least spread as a share of the median: copies of one text don't make a floor of its value.
LEAST_SPREAD = 0.01
#: Texts that a group needs for floors of its own; smaller ones take those of their language, then the bands alone.
LEAST_TEXTS = 30
#: Rows of floors that are broadcast; more are joined by a shuffle.
SENT_FLOORS = 100_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def script_of(text: str) -> str:
    """The script of most characters from U+0250 on, if they are a third of the text at least; else latin."""
    if text.isascii():
        return "latin"
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    high = codes[codes >= 0x250]
    if 3 * len(high) < len(codes):
        return "latin"
    counts = [(int(((high >= a) & (high <= b)).sum()), name) for name, a, b in SCRIPTS]
    most, name = max(counts)
    return name if 2 * most >= len(high) else "other"


class Pieces:
    """Words to pieces of a sentencepiece vocabulary: a count, the byte fallbacks among them, and ids; and a count of byte-level tokens."""

    def __init__(self, path: str, second: str | None = None) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_level = byte_level(second) if second else None
        self.fallback = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.counts, self.bytes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.byte_counts = np.zeros(0, np.int64)

    def add(self, split: list[list[str]]) -> None:
        new = list(set().union(*split).difference(self.index))
        if len(self.index) + len(new) > CACHE_ENTRIES:
            self.clear()
            new = list(set().union(*split))
        encoded = self.model.encode(new, num_threads=1)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        counts = np.array([len(x) for x in encoded], np.int64)
        ids = np.fromiter(itertools.chain.from_iterable(encoded), np.int32, int(counts.sum()))
        row = np.repeat(np.arange(len(new)), counts)
        self.bytes = np.concatenate([self.bytes, np.bincount(row, self.fallback[ids], len(new)).astype(np.int64)])
        self.counts, self.ids = np.concatenate([self.counts, counts]), np.concatenate([self.ids, ids])
        if self.byte_level:
            self.byte_counts = np.concatenate([self.byte_counts, np.fromiter((len(self.byte_level.encode_ordinary(w)) for w in new), np.int64, len(new))])


def byte_level(path: str):  # noqa: ANN201
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("second", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(path: str, second: str | None = None) -> Pieces:
    return held(("pieces", path, second), lambda: Pieces(path, second))


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.concatenate([starts, [len(sorted_keys)]]))


def repeated_words(words: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Per text, its words in windows of three that it holds twice or more; words: numbers of the words, text by text."""
    if len(words) < 3:
        return np.zeros(texts, np.int64)
    inside, base = np.flatnonzero(text[:-2] == text[2:]), int(words.max()) + 1
    _, pair = np.unique(words[:-1] * base + words[1:], return_inverse=True)  # below the count of words, so that text and three words fit 64 bits
    key = (text[inside] * len(words) + pair[inside]) * base + words[inside + 2]
    order = np.argsort(key)
    _, lengths = _runs(key[order])
    found = inside[order[np.repeat(lengths > 1, lengths)]]
    marked = np.zeros(len(words), bool)
    for k in range(3):
        marked[found + k] = True
    return np.bincount(text, marked, texts).astype(np.int64)


def measure(texts: list[str], path: str, second: str | None = None) -> dict[str, np.ndarray | list[str]]:
    """All counts of the texts."""
    own, split = pieces(path, second), [words_of(t) for t in texts]
    own.add(split)
    n_words = np.array([len(s) for s in split], np.int64)
    of = own.index.__getitem__
    words = np.fromiter(map(of, itertools.chain.from_iterable(split)), np.int64, int(n_words.sum()))
    text = np.repeat(np.arange(len(texts)), n_words)
    n_tokens = np.bincount(text, own.counts[words], len(texts)).astype(np.int64)
    # Tokens, text by text: sort (text, token) and take the entropy of each text's runs.
    ends = np.cumsum(own.counts)
    lengths = own.counts[words]
    at = np.arange(int(lengths.sum())) + np.repeat(ends[words] - np.cumsum(lengths), lengths) if len(words) else np.zeros(0, np.int64)
    key = np.sort(np.repeat(text, lengths) * len(own.fallback) + own.ids[at]) if len(words) else at
    starts, sizes = _runs(key)
    owner = key[starts] // len(own.fallback) if len(key) else starts
    spread = np.bincount(owner, sizes * np.log2(sizes), len(texts)) if len(key) else np.zeros(len(texts))
    total = np.maximum(n_tokens, 1)
    duplicate_lines = []
    for t in texts:
        lines = [x for x in t.split("\n") if x and WORD.search(x)] if "\n" in t else ()
        duplicate_lines.append(len(lines) - len(set(lines)))
    word_chars = np.array([sum(map(len, s)) for s in split], np.int64)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array(duplicate_lines, np.int64),
        "n_repeat_words": repeated_words(words, text, len(texts)),
        "n_tokens": n_tokens,
        "chars_per_token": word_chars / total,
        "fallback_share": np.bincount(text, own.bytes[words], len(texts)) / total,
        "token_entropy": np.maximum(np.log2(total) - spread / total, 0.0),
        "script": [script_of(t) for t in texts],
        "byte_chars_per_token": word_chars / np.maximum(np.bincount(text, own.byte_counts[words], len(texts)), 1) if second else np.full(len(texts), np.nan),
    }


def verdicts(texts: list[str], path: str, bands: dict[str, Band], second: str | None = None) -> dict[str, object]:
    """The counts of texts, with base_failed, and kept by the base rules and the bands."""
    found = measure(texts, path, second)
    n_words, band = found["n_words"], np.array([bands[s] for s in found["script"]]).reshape(-1, 4)
    failed = (n_words < 50) | (100 * found["n_repeat_words"] > 50 * n_words)
    chars = found["chars_per_token"]
    fits = (chars >= band[:, 0]) & (chars <= band[:, 1]) & (found["fallback_share"] <= band[:, 2]) & (found["token_entropy"] >= band[:, 3])
    return found | {"base_failed": failed, "kept": fits & ~failed}


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_tokens long, chars_per_token double, fallback_share double, token_entropy double, script string, byte_chars_per_token double"
)


def above_floors(measured: DataFrame, language: str, mark: str = "") -> DataFrame:
    """measured, of which kept is true only of texts at or above the floors of their group; mark precedes the names of its measures."""
    spoken = F.coalesce(F.col(language).cast("string"), F.lit(""))
    rows = measured.withColumns({"__language": spoken, "__length": F.floor(F.log2(F.greatest(F.col(f"{mark}n_words"), F.lit(1)))).cast("int")})
    least = lambda c, q: q[0] - WIDTH * F.greatest((q[1] - q[0]) / QUARTILE, LEAST_SPREAD * q[0])
    quartiles = {c: F.percentile(F.round(f"{mark}{c}", places), F.array(F.lit(0.5), F.lit(0.75))) for c, places in FLOORS.items()}
    groups = rows.filter(f"{mark}kept").select(F.col(f"{mark}script").alias("__s"), F.col("__language").alias("__l"), F.explode(F.array("__length", F.lit(-1))).alias("__n"), *(f"{mark}{c}" for c in FLOORS))
    found = groups.groupBy("__s", "__l", "__n").agg(F.count("*").alias("texts"), *(q.alias(f"__{c}") for c, q in quartiles.items())).filter(F.col("texts") >= LEAST_TEXTS)
    floors = checkpoint(found.select("__s", "__l", "__n", F.struct(*(least(c, F.col(f"__{c}")).alias(c) for c in FLOORS)).alias("__floor")))
    sent = F.broadcast if floors.count() <= SENT_FLOORS else lambda df: df
    for name, length in (("__own", F.col("__length")), ("__wide", F.lit(-1))):
        side = floors.select(F.col("__s").alias(f"{name}_s"), F.col("__l").alias(f"{name}_l"), F.col("__n").alias(f"{name}_n"), F.col("__floor").alias(name))
        rows = rows.join(sent(side), (F.col(f"{mark}script") == F.col(f"{name}_s")) & (F.col("__language") == F.col(f"{name}_l")) & (length == F.col(f"{name}_n")), "left")
    floor = F.coalesce("__own", "__wide")
    above = functools.reduce(lambda a, b: a & b, (F.coalesce(F.round(f"{mark}{c}", places) >= floor[c], F.lit(True)) for c, places in FLOORS.items()))
    return rows.withColumn(f"{mark}kept", F.col(f"{mark}kept") & above).select(measured.columns)


def judge(df: DataFrame, path: str, *keep: str, text: str = "text", bands: dict[str, Band] = BANDS, second: str | None = None, language: str | None = None) -> DataFrame:
    """Columns keep, the counts, base_failed, kept and the fertility that kept rests on; without a column language, a script is one."""
    spoken = F.col(language) if language else F.lit(None)
    found = map_texts(df, [*(F.col(k) for k in keep), spoken.cast("string").alias("__spoken")], F.col(text), SCHEMA, lambda texts: verdicts(texts, path, bands, second))
    return above_floors(checkpoint(found), "__spoken").drop("__spoken")


def without_rejected(df: DataFrame, path: str, text: str = "text", bands: dict[str, Band] = BANDS, second: str | None = None, language: str | None = None) -> DataFrame:
    """The rows of df whose texts are kept."""
    schema = "__n_words long, __kept boolean, __script string, " + ", ".join(f"__{c} double" for c in FLOORS)

    def columns(texts: list[str]) -> dict[str, object]:
        return {f"__{k}": v for k, v in verdicts(texts, path, bands, second).items()}

    spoken = df.withColumn("__spoken", F.col(language).cast("string") if language else F.lit(None).cast("string"))
    found = checkpoint(append_texts(spoken, text, schema, columns).filter("__kept"))
    return above_floors(found, "__spoken", "__").filter("__kept").select(df.columns)
