"""Encoding, counting and packing against the libraries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import byte_bpe, packing, token_count
from tidemark.llm.bpe import merge_file, merge_long, rank_file
from tidemark.llm.queries import BYTE_RANKS, WORD_BPE
from tidemark.llm.words import _LOWER, byte_words, lower_words

HARD = ["it's 12 o'clock!!  \n\n x", "a" * 700 + "bc" * 400, "日本語のテキスト、ＡＢＣ", "Ωμέγα ΣΊΣΥΦΟΣ ς", "e\u0301 \u00a0\u3000x\x1c\x1fy", "<|endoftext|>a<|startoftext|> <|pad|>", "😀👨‍👩‍👧 ½²x_1", "\ud7ff\u2028z\u0558b", ""]


@pytest.fixture(scope="module")
def byte_library():
    _, tokens = rank_file(BYTE_RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens) if t}, special_tokens={})


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORD_BPE)


def ids(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def test_hard_texts_encode_as_the_libraries_do(byte_library, word_library):
    assert [ids(x) for x in byte_bpe.encoder(BYTE_RANKS, public_tokenizers.PATTERN).encode(HARD)] == [byte_library.encode_ordinary(t) for t in HARD]
    wanted = [word_library.encode(t, add_special_tokens=False).ids for t in HARD]
    assert [ids(x) for x in packing.encoder(WORD_BPE).ids(HARD)] == wanted
    assert token_count.counter(WORD_BPE).count(HARD).tolist() == [len(x) for x in wanted]


def test_latin_patterns_are_the_general_ones():
    general = regex.compile(public_tokenizers.PATTERN)
    for c in map(chr, range(256)):
        for text in (f"a{c}b {c}{c} 1{c}2", f"'{c}s {c}"):
            assert byte_words(text, public_tokenizers.PATTERN) == general.findall(text)
            assert lower_words(text, WORD_BPE) == _LOWER.findall(text.lower())


def test_long_words_merge_as_rows_do():
    rng = random.Random(1)
    for merger in (rank_file(BYTE_RANKS)[0], merge_file(WORD_BPE)):
        for _ in range(60):
            word = bytes(rng.choice(b"etaoin shrdlu") for _ in range(rng.randint(2, 200)))
            start = merger.first[np.frombuffer(word, np.uint8)].tolist()
            start[-1] = int(merger.last[word[-1]])
            if word not in merger.whole:
                assert merge_long(start, merger.table) == ids(merger.encode([word])[0])


def test_cache_runs_over(monkeypatch, byte_library):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 5)
    own = byte_bpe.Encoder(BYTE_RANKS, public_tokenizers.PATTERN)
    for text in HARD * 2:
        assert ids(own.encode([text])[0]) == byte_library.encode_ordinary(text) and own.decode(own.encode([text])[0]) == text.encode()


def test_round_trip(documents, texts, byte_library):
    found = byte_bpe.round_trip(documents, BYTE_RANKS, public_tokenizers.PATTERN, "text", "doc_id").collect()
    assert len(found) == len(texts)
    for r in found:
        wanted = byte_library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(wanted) and r["ids_sha256"] == hashlib.sha256(np.array(wanted, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_counts(documents, texts, word_library):
    for r in token_count.count_tokens(documents, WORD_BPE, 300, "text", "doc_id").collect():
        n = len(word_library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 300)


def check_packing(frame, texts, library, size):
    covered = {}
    for r in frame.itertuples():
        whole = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        part = whole[r.start : r.start + r.length]
        assert (len(part), len(whole), zlib.crc32(np.array(part, "<u4").tobytes())) == (r.length, r.doc_tokens, r.ids_crc32)
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
    for k, parts in covered.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(library.encode(texts[k], add_special_tokens=False).ids) + 1
    by_sequence = frame.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length
    assert (by_sequence.cumsum() - frame.length == frame.offset).all() and by_sequence.sum().max() <= size
    return by_sequence.sum()


def test_packing(documents, texts, word_library):
    frame = packing.pack(documents, WORD_BPE, size=4096, end=2).toPandas()
    sums = check_packing(frame, texts, word_library, 4096)
    assert set(frame.doc_id) == set(texts) and len(sums) <= -(-int(sums.sum()) // 4096) * 1.03 + 2
    check_packing(packing.pack(documents, WORD_BPE, size=300, end=2).toPandas(), texts, word_library, 300)


@pytest.mark.parametrize("seed", range(8))
def test_cutting_stock_covers_demand(seed):
    rng = np.random.default_rng(seed)
    demand = rng.integers(0, 50, 64) * (rng.random(64) < 0.5)
    held = np.zeros(64, int)
    sequences = 0
    for times, pattern in packing.cut(demand, 64):
        assert times > 0 and sum((c + 1) * n for c, n in pattern.items()) <= 64
        for c, n in pattern.items():
            held[c] += times * n
        sequences += times
    rooms: list[int] = []  # first fit, longest first
    for c in range(63, -1, -1):
        for _ in range(demand[c]):
            k = next((k for k, room in enumerate(rooms) if room > c), None)
            if k is None:
                rooms.append(63 - c)
            else:
                rooms[k] -= c + 1
    assert (held == demand).all() and sequences <= len(rooms) + 3


def test_odd_rows(odd, nothing):
    for f in (lambda d: byte_bpe.round_trip(d, BYTE_RANKS, public_tokenizers.PATTERN, "text", "doc_id"), lambda d: token_count.count_tokens(d, WORD_BPE, 2048, "text", "doc_id"), lambda d: packing.pack(d, WORD_BPE)):
        assert f(odd).count() >= 10 and f(nothing).count() == 0
    counts = [r["n_tokens"] for r in token_count.count_tokens(odd.filter("doc_id < 3"), WORD_BPE).collect()]
    assert counts == [0, 0]
