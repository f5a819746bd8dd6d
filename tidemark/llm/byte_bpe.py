"""Byte-level BPE encoding and decoding of whole texts.

Texts are split by the vocabulary's pattern; the distinct words of a step that the process hasn't seen are
merged as length-bucketed padded matrices (bpe.py); a text's ids are the joined ids of its words. The plan
is one scan and one Arrow map: no shuffle, memory bounded by a step of text and by the cache of words.

Null and empty texts have no ids (empty bytes). Repeated rows give a row each. A text with characters that Unicode
versions class differently is split and merged like any other, and then held against the library itself.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import rank_file
from .common import CACHE_ENTRIES, held, map_texts
from .words import byte_words, settled


class Encoder:
    """Texts to ids as bytes (little-endian unsigned 32-bit integers), with a bounded cache of words."""

    def __init__(self, path: str, pattern: str) -> None:
        self.merger, self.tokens = rank_file(path)
        self.pattern, self.cache = pattern, {}
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths
        self.joined = np.frombuffer(b"".join(self.tokens), np.uint8)

    @functools.cached_property
    def library(self):  # noqa: ANN201
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks={t: i for i, t in enumerate(self.tokens) if t}, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [byte_words(t, self.pattern) for t in texts]
        new = list(set().union(*split).difference(self.cache))
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            self.cache.clear()
            new = list(set().union(*split))
        self.cache.update(zip(new, self.merger.encode([w.encode("utf-8", "replace") for w in new]), strict=True))
        of = self.cache.__getitem__
        return [ids if settled(t) else self.held_against_library(t, ids) for t, ids in zip(texts, (b"".join(map(of, s)) for s in split), strict=True)]

    def held_against_library(self, text: str, ids: bytes) -> bytes:
        """ids, or the library's where its version of Unicode splits the text elsewhere."""
        theirs = np.array(self.library.encode_ordinary(text), "<u4").tobytes()
        return ids if ids == theirs else theirs

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for, gathered from the joined tokens."""
        index = np.frombuffer(ids, "<u4").astype(np.int64)
        lengths = self.lengths[index]
        if not (total := int(lengths.sum())):
            return b""
        ends = np.cumsum(lengths)
        return self.joined[np.arange(total) + np.repeat(self.starts[index] - ends + lengths, lengths)].tobytes()


def encoder(path: str, pattern: str) -> Encoder:
    return held(("encoder", path, pattern), lambda: Encoder(path, pattern))


def encode(df: DataFrame, text: str | Column, path: str, pattern: str, *keep: str) -> DataFrame:
    """Columns keep, n_tokens and ids (an array of integers)."""

    def run(texts: list[str]) -> dict[str, object]:
        ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in encoder(path, pattern).encode(texts)]
        return {"n_tokens": [len(x) for x in ids], "ids": ids}

    return map_texts(df, [F.col(k) for k in keep], F.col(text) if isinstance(text, str) else text, "n_tokens long, ids array<long>", run)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", *keep: str) -> DataFrame:
    """Columns keep, with the count and digests of each text's ids and of the bytes they decode to."""

    def run(texts: list[str]) -> dict[str, object]:
        own = encoder(path, pattern)
        ids = own.encode(texts)
        return {
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(own.decode(x)).hexdigest() for x in ids],
        }

    return map_texts(df, [F.col(k) for k in keep], F.col(text), "n_tokens long, ids_sha256 string, decoded_sha256 string", run)
