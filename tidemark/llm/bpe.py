"""Byte-pair merges of many words at once in numpy.

Words are rows of padded matrices, one matrix for each bucket of lengths. In every round each row looks up
all its neighbouring pairs in a hash table, merges its leftmost pair of least rank, and closes the gap; rows
without a pair that merges leave the matrix. A word longer than LONG symbols would need as many rounds as it
has symbols over its whole width, so such words, alone, merge through a heap: same order of merges, same ids.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np

LONG = 256
_NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressing table from pairs of ids to (rank, merged id)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(8, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        self.rank = np.full(size, _NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        slot, waiting, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(waiting):  # all at once; the first at each free slot takes it, the others go one further
            self.probes += 1
            free = self.keys[slot[waiting]] == np.iinfo(np.uint64).max
            trying = waiting[free]
            _, first = np.unique(slot[trying], return_index=True)
            placed = trying[first]
            self.keys[slot[placed]] = keys[placed]
            self.rank[slot[placed]] = rank[placed]
            self.merged[slot[placed]] = merged[placed]
            waiting = np.setdiff1d(waiting, placed, assume_unique=True)
            slot[waiting] = (slot[waiting] + 1) & (size - 1)
        self.pairs = dict(zip(keys.tolist(), zip(rank.tolist(), merged.tolist(), strict=True), strict=True))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int32)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NONE if the pair doesn't merge) and slot of each pair."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        open_ = np.flatnonzero((found := self.keys[slot]).ravel() != keys.ravel())
        flat, want = slot.ravel(), keys.ravel()
        open_ = open_[found.ravel()[open_] != np.iinfo(np.uint64).max]
        while len(open_):
            flat[open_] = (flat[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[flat[open_]]
            open_ = open_[(there != want[open_]) & (there != np.iinfo(np.uint64).max)]
        return np.where(self.keys[slot] == keys, self.rank[slot], _NONE), slot


def merge_rows(matrix: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every row of a padded matrix of ids to its end; the matrix and its lengths after that."""
    matrix, lengths = matrix.copy(), lengths.copy()
    alive = np.flatnonzero(lengths > 1)
    work, count = matrix[alive], lengths[alive]
    rank, slot = (table.find(work[:, :-1], work[:, 1:])) if len(alive) else (None, None)
    if len(alive):
        rank[np.arange(work.shape[1] - 1)[None, :] >= (count - 1)[:, None]] = _NONE
    while len(alive):
        at = rank.argmin(axis=1)  # the leftmost of equals
        rows = np.arange(len(alive))
        go = rank[rows, at] < _NONE
        if not go.all():
            done = alive[~go]
            matrix[done, : work.shape[1]] = work[~go]
            lengths[done] = count[~go]
            alive, work, count, rank, slot, at = alive[go], work[go], count[go], rank[go], slot[go], at[go]
            if not len(alive):
                break
            rows = np.arange(len(alive))
        merged = table.merged[slot[rows, at]]
        columns = np.arange(work.shape[1])[None, :]
        # Each row loses one symbol and one pair, so what is left is again a matrix.
        work = work[columns != at[:, None] + 1].reshape(len(rows), -1)
        pairs = columns[:, :-1] != at[:, None]
        rank, slot = rank[pairs].reshape(len(rows), -1), slot[pairs].reshape(len(rows), -1)
        work[rows, at] = merged
        count = count - 1
        if work.shape[1] < 2:  # pairs only, and all have merged
            matrix[alive, :1] = work
            lengths[alive] = count
            break
        for shift in (-1, 0):  # only the pairs that touch the merged symbol are new
            place = at + shift
            ok = (place >= 0) & (place < count - 1)
            r, p = rows[ok], place[ok]
            rank[r, p], slot[r, p] = table.find(work[r, p], work[r, p + 1])
    return matrix, lengths


def merge_long(ids: list[int], table: PairTable) -> list[int]:
    """The same merges of one long word: a heap of pairs by rank and place over a linked list."""
    n, pairs = len(ids), table.pairs
    right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(p[0], i, ids[i], ids[i + 1], p[1]) for i in range(n - 1) if (p := pairs.get(ids[i] << 32 | ids[i + 1]))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, merged = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or not alive[i] or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], right[i] = merged, False, right[j]
        if right[j] < n:
            left[right[j]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y < n and (p := pairs.get(ids[x] << 32 | ids[y])):
                heapq.heappush(heap, (p[0], x, ids[x], ids[y], p[1]))
    return [x for x, ok in zip(ids, alive, strict=True) if ok]


class Merger:
    """Words (as bytes) to ids."""

    def __init__(self, table: PairTable, first: np.ndarray, last: np.ndarray, whole: dict[bytes, int] | None = None) -> None:
        """first: id of each byte; last: id of each byte where it ends a word; whole: words with an id of their own."""
        self.table, self.first, self.last, self.whole = table, first, last, whole or {}

    def merged(self, words: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Places of words, their ids as rows of a padded matrix, and the number of ids of each."""
        buckets: dict[int, list[int]] = {}
        if known := [i for i, word in enumerate(words) if word in self.whole]:
            yield known, np.array([[self.whole[words[i]]] for i in known], np.int32), np.ones(len(known), np.int64)
        for i, word in enumerate(words):
            if word in self.whole:
                continue
            if len(word) > LONG:
                ids = self.first[np.frombuffer(word, np.uint8)].tolist()
                ids[-1] = int(self.last[word[-1]])
                row = np.array([merge_long(ids, self.table)], np.int32)
                yield [i], row, np.array([row.shape[1]])
            elif word:
                buckets.setdefault(4 * ((len(word) + 3) // 4) if len(word) <= 32 else 1 << (len(word) - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            step = max(1, 400_000 // width)
            for a in range(0, len(members), step):
                part = members[a : a + step]
                lengths = np.fromiter((len(words[i]) for i in part), np.int64, len(part))
                raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
                matrix = self.first[raw]
                ends = (np.arange(len(part)), lengths - 1)
                matrix[ends] = self.last[raw[ends]]
                yield part, *merge_rows(matrix, lengths, self.table)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        for part, matrix, lengths in self.merged(words):
            flat = matrix[np.arange(matrix.shape[1])[None, :] < lengths[:, None]].astype("<u4").tobytes()
            begin = 0
            for i, stop in zip(part, np.cumsum(lengths * 4).tolist(), strict=True):
                out[i] = flat[begin:stop]
                begin = stop
        return out

    def count(self, words: list[bytes]) -> np.ndarray:
        """The number of ids of each word."""
        out = np.zeros(len(words), np.int64)
        for part, _, lengths in self.merged(words):
            out[part] = lengths
        return out


def rank_file(path: str) -> tuple[Merger, list[bytes]]:
    """The merger of a file of ranks, and the bytes of each id.

    Any two neighbours whose bytes together have a rank merge; a word that has one is one token at once.
    """
    ranks: dict[bytes, int] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    rows = [(ranks[t[:k]], ranks[t[k:]], r, r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    left, right, rank, merged = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, r in ranks.items():
        tokens[r] = token
    return Merger(PairTable(left, right, rank, merged), single, single, ranks), tokens


def printable_bytes() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def merge_file(path: str) -> Merger:
    """The merger of a JSON vocabulary with a list of merges and an ending that marks a word's last symbol."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary, ending = model["vocab"], model.get("end_of_word_suffix") or ""
    rows = []
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        rows.append((vocabulary[a], vocabulary[b], rank, vocabulary[a + b]))
    left, right, rank, merged = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    shown = printable_bytes()
    first = np.array([vocabulary[c] for c in shown], np.int32)
    last = np.array([vocabulary[c + ending] for c in shown], np.int32)
    return Merger(PairTable(left, right, rank, merged), first, last)
