"""Content-defined anchors of byte strings, in numpy over many texts at once.

Every string of LENGTH bytes has one anchor: of its first SPAN places, the leftmost whose next GRAM bytes have the
least hash. It depends on the string alone, so equal strings have it at the same place. A text's starts of
such strings fall into runs with a common anchor, which is what is shuffled instead of every start.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .shingles import BYTES, PIECE, mix, powers

_U = np.uint64
LENGTH, SPAN, GRAM = 400, 320, 16
#: Bytes from an anchor on that every string of the anchor holds.
SURE = LENGTH - SPAN + 1


class Sums(NamedTuple):
    """Prefix sums of bytes times powers: hashes of any substring in constant time."""

    sums: np.ndarray
    inverse: np.ndarray

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def prefix_sums(joined: np.ndarray, seed: int = 0) -> Sums:
    power, inverse = powers(len(joined) + 1)
    values = BYTES if not seed else mix(BYTES + _U(seed))
    return Sums(np.concatenate([np.zeros(1, _U), np.cumsum(values[joined] * power[:-1], dtype=_U)]), inverse)


def anchor_places(joined: np.ndarray, sums: Sums, starts: np.ndarray) -> np.ndarray:
    """The anchor of the string at each of starts (ascending places with LENGTH bytes of one text before them)."""
    n = len(joined) - GRAM + 1
    bits = max(n, 2).bit_length()
    grams = mix((sums.sums[GRAM:] - sums.sums[:-GRAM]) * sums.inverse[: n])
    key = (grams >> _U(bits) << _U(bits)) | np.arange(n, dtype=_U)
    padded = np.full(-(-n // SPAN) * SPAN, np.iinfo(_U).max, _U)
    padded[:n] = key
    rows = padded.reshape(-1, SPAN)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[starts], ahead[starts + SPAN - 1]) & _U((1 << bits) - 1)).astype(np.int64)


class Runs(NamedTuple):
    """Runs of starts with a common anchor; places are in their own text, text is its number."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    #: Hash of the SURE bytes from the anchor on, and two hashes of all bytes of the run's strings.
    sure: np.ndarray
    whole: np.ndarray
    other: np.ndarray


def runs(texts: list[bytes]) -> Runs:
    """The runs of texts; a long text goes in pieces, which cut a run of its in two at most at each of their ends."""
    if max(map(len, texts), default=0) <= PIECE + LENGTH:
        return _runs(texts)
    found = []
    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 1), PIECE):
            r = _runs([text[at : at + PIECE + LENGTH - 1]])
            found.append(Runs(r.text + k, r.first + at, r.last + at, r.anchor + at, r.sure, r.whole, r.other))
    return Runs(*map(np.concatenate, zip(*found, strict=True)))


def _runs(texts: list[bytes]) -> Runs:
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths) - lengths
    counts = np.maximum(lengths - LENGTH + 1, 0)
    total = int(counts.sum())
    none = np.zeros(0, np.int64)
    if not total:
        return Runs(none, none, none, none, *(none.astype(_U),) * 3)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    text = np.repeat(np.arange(len(texts)), counts)
    starts = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + begins[text]
    sums = prefix_sums(joined)
    anchor = anchor_places(joined, sums, starts)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([new[1:], [total]]) - 1
    first, last, anchor, text = starts[new], starts[last], anchor[new], text[new]
    shape = mix((anchor - first).astype(_U) << _U(32) | (last - first).astype(_U))
    sure = sums.hash(anchor, anchor + SURE)
    whole = mix(sums.hash(first, last + LENGTH) + shape)
    other = mix(prefix_sums(joined, 7).hash(first, last + LENGTH) + shape)
    base = begins[text]
    return Runs(text, first - base, last - base, anchor - base, sure, whole, other)
