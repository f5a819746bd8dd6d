"""Sets of word shingles as sorted 64-bit hashes, in numpy over the bytes of many texts at once.

Words are maximal runs of bytes other than space and \\t to \\r, after A-Z are lower-cased; a shingle is `width`
words in a row, and a text of fewer words is one shingle of all of them.
"""

from __future__ import annotations

import re

import numpy as np

#: Bytes of one text that are hashed in one step.
PIECE = 1_000_000
_SPACE = re.compile(rb"[ \t-\r]")
_U = np.uint64
_MULTIPLIER = 0xD6E8FEB86659FD93
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A random-looking number for each byte.
BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_powers = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier, and of its inverse, modulo 2**64; those of a usual step are kept."""
    made = _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_MULTIPLIER, _INVERSE):
            steps = np.full(n, base, _U)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if n <= PIECE + PIECE // 2:
            _powers[:] = made
    return made[0][:n], made[1][:n]


def pieces_of(text: bytes) -> list[bytes]:
    """A text cut at white space into pieces of PIECE bytes, or as long as a word that is longer."""
    out, at = [], 0
    while len(text) - at > PIECE:
        space = _SPACE.search(text, at + PIECE)
        if not space:
            break
        out.append(text[at : space.start()])
        at = space.end()
    return [*out, text[at:]] if out else [text]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, text by text, and the number of words in each text; a long text goes piece by piece."""
    if max(map(len, texts), default=0) <= PIECE:
        return _word_hashes(texts)
    found = [[_word_hashes([p]) for p in pieces_of(t)] for t in texts]
    return np.concatenate([w for parts in found for w, _ in parts]), np.array([sum(len(w) for w, _ in parts) for parts in found], np.int64)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    space = (joined == 32) | ((joined >= 9) & (joined <= 13))
    edges = np.diff(space.astype(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    power, inverse = powers(len(joined) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(BYTES[joined] * power[:-1], dtype=_U)])
    words = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))
    limits = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(starts, limits), prepend=0)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    if not texts:
        return []
    words, counts = word_hashes(texts)
    value = np.zeros(max(len(words) - width + 1, 0), _U)
    for k in range(width):
        value = mix((value + words[k : k + len(value)]) * _U(_MULTIPLIER) + _U(k + 1))
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(value[at : at + n - width + 1]))
        elif n:
            one = np.zeros(1, _U)
            for k in range(n):
                one = mix((one + words[at + k]) * _U(_MULTIPLIER) + _U(k + 1))
            out.append(mix(one + _U(n)))
        else:
            out.append(np.zeros(0, _U))
        at += n
    return out


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set; equal sets have equal ones."""
    first = np.array([int(np.bitwise_xor.reduce(mix(s + _U(0x51)))) if len(s) else 0 for s in sets], _U)
    second = np.array([int(np.add.reduce(mix(s ^ _U(0xA7A7A7A7A7A7A7A7)))) if len(s) else 0 for s in sets], _U)
    return first.view(np.int64), second.view(np.int64)
