"""Token counts of whole texts, without their ids.

The pieces of each distinct word are counted once (per process, in a bounded cache); a step of texts becomes a
table of (text, word, frequency), which is joined to the counts by word and summed by text. Shuffling
that table for one cluster-wide count of each word would move more bytes than the texts have, so the join
stays within each step; the plan is one scan and one Arrow map.

Null and empty texts count 0. Special tokens' strings in a text count one each, as the library's default has it.
"""

from __future__ import annotations

import functools
import itertools
import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import merge_file
from .common import CACHE_ENTRIES, held, map_texts
from .words import lower_words


@functools.lru_cache(2)
def special(path: str) -> tuple[re.Pattern[str], dict[str, int]]:
    """A pattern that splits a text at its special tokens, and their ids."""
    with open(path, encoding="utf-8") as file:
        added = {t["content"]: t["id"] for t in json.load(file).get("added_tokens") or ()}
    return re.compile("(" + "|".join(re.escape(a) for a in sorted(added, key=len, reverse=True)) + ")"), added


def words_of(text: str, path: str) -> tuple[list[str], int]:
    """The words of a text, and how many special tokens stand between them."""
    split, added = special(path)
    if "<|" not in text or not split.search(text):
        return lower_words(text, path), 0
    parts = split.split(text)
    return [w for part in parts[::2] for w in lower_words(part, path)], len(parts) // 2


class Counter:
    def __init__(self, path: str) -> None:
        self.path, self.merger = path, merge_file(path)
        self.index: dict[str, int] = {}
        self.pieces = np.zeros(0, np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        split = [words_of(t, self.path) for t in texts]
        new = list(set().union(*(s for s, _ in split)).difference(self.index))
        if len(self.index) + len(new) > CACHE_ENTRIES:
            self.index, self.pieces = {}, self.pieces[:0]
            new = list(set().union(*(s for s, _ in split)))
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.pieces = np.concatenate([self.pieces, self.merger.count([w.encode("utf-8", "replace") for w in new])])
        lengths = np.array([len(s) for s, _ in split], np.int64)
        of = self.index.__getitem__
        words = np.fromiter(map(of, itertools.chain.from_iterable(s for s, _ in split)), np.int64, int(lengths.sum()))
        # One row for each text and distinct word, with its frequency; then the join and the sum.
        pair, frequency = np.unique(np.repeat(np.arange(len(texts)), lengths) * len(self.pieces) + words, return_counts=True)
        row, word = np.divmod(pair, max(len(self.pieces), 1))
        return np.bincount(row, frequency * self.pieces[word], len(texts)).astype(np.int64) + np.array([n for _, n in split], np.int64)


def counter(path: str) -> Counter:
    return held(("counter", path), lambda: Counter(path))


def count_tokens(df: DataFrame, path: str, limit: int = 2048, text: str = "text", *keep: str) -> DataFrame:
    """Columns keep, n_bytes (of UTF-8), n_tokens, and over_limit (more tokens than limit)."""

    def run(texts: list[str]) -> dict[str, object]:
        tokens = counter(path).count(texts)
        return {"n_bytes": [len(t) if t.isascii() else len(t.encode("utf-8", "replace")) for t in texts], "n_tokens": tokens, "over_limit": tokens > limit}

    column: Column = F.col(text)
    return map_texts(df, [F.col(k) for k in keep], column, "n_bytes long, n_tokens long, over_limit boolean", run)
