"""Toxicity: a bidirectional gated recurrent network with attention pooling, over character and word inputs.

A word's input is a hashed word embedding beside the sum of its hashed character n-grams' embeddings. Windows of
WINDOW words that overlap by half run through a gated recurrent network in both directions; attention pools the
states, and a text's score is that of its highest window. All of it is numpy. Training gets labelled documents
only (their labels say nothing about where in a text the matter is): windows of label 1 documents begin with
the window whose words and n-grams are most frequent in such documents and least in others, then the network's
own highest windows take their place; windows of label 0 documents are random ones and then the highest.

Training reads a bounded sample of labelled rows (SAMPLE documents of either label, the least by hash of doc_id);
every text is scored whole. The model is a few MB whatever the corpus holds, and scoring is one scan and one Arrow map.
Null and empty texts are one window without words, whose score is the model's for no input. Repeated rows are scored each.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, filter_texts, held, map_texts
from .shingles import mix

WINDOW, STRIDE = 32, 16
WORD_BITS, CHAR_BITS = 15, 15
WORD_SIZE, CHAR_SIZE, HIDDEN, ATTENTION = 8, 16, 8, 8
GRAMS = (3, 4, 5)
#: Documents of either label that training reads at most.
SAMPLE = 1000
#: Windows of a training document that are looked at in one step.
TRAIN_WINDOWS = 400
#: Documents that a word or n-gram must be in for training to learn it.
LEAST_DOCUMENTS = 4
#: What may stand around a word without being part of it.
_AROUND = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’…–—"
#: Characters of a word at most.
LONGEST = 64
#: Thai, Lao, Tibetan, Burmese, Khmer, kana and Chinese characters.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_JOINED = re.compile(r"[^\W_]+[\W_]*|[\W_]+")
_U = np.uint64
_IN = WORD_SIZE + CHAR_SIZE


def words_of(text: str) -> list[str]:
    """Words of LONGEST characters at most that leave out nothing but white space.

    Characters of scripts without spaces are words each. Longer runs are split where words are joined by
    other characters, and what is longer still into pieces that overlap by half.
    """
    lower = text.lower()
    words = (lower if lower.isascii() else _UNSPACED.sub(r" \g<0> ", lower)).split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [p for w in words for p in ((w,) if len(w) <= LONGEST else itertools.chain.from_iterable(map(pieces_of, _JOINED.findall(w))))]


def pieces_of(run: str) -> list[str]:
    half = LONGEST // 2
    return [run[a : a + LONGEST] for a in range(0, max(len(run) - half, 1), half)]


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bucket for each word; buckets of all its character n-grams, word by word, and their number."""
    parts = [_features(words[a : a + 20_000]) for a in range(0, max(len(words), 1), 20_000)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = [b"\x02" + (w.strip(_AROUND) or w).encode("utf-8", "replace") + b"\x03" for w in words]
    lengths = np.array([len(d) for d in data], np.int64)
    codes = np.frombuffer(b"".join(data), np.uint8).astype(_U)
    row = np.repeat(np.arange(len(words)), lengths)
    rows, grams = [], []
    for n in GRAMS:
        if len(codes) < n:
            continue
        value = np.full(len(codes) - n + 1, n, _U)
        for k in range(n):
            value = value * _U(0x100000001B3) + codes[k : len(codes) - n + 1 + k]
        inside = row[: len(value)] == row[n - 1 :]
        rows.append(row[: len(value)][inside])
        grams.append((mix(value[inside]) >> _U(64 - CHAR_BITS)).astype(np.int32))
    row_all, gram_all = np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(grams or [np.zeros(0, np.int32)])
    order = np.argsort(row_all, kind="stable")
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    whole = np.zeros(len(words), _U)
    if len(words):
        whole = np.add.reduceat(mix(codes + (place.astype(_U) << _U(8))), np.cumsum(lengths) - lengths)
    return (mix(whole) >> _U(64 - WORD_BITS)).astype(np.int32), gram_all[order], np.bincount(row_all, minlength=len(words))


class Model(NamedTuple):
    word: np.ndarray
    char: np.ndarray
    inputs: np.ndarray  # word input -> gates of both directions
    bias: np.ndarray
    forward: np.ndarray
    backward: np.ndarray
    attend: np.ndarray
    focus: np.ndarray
    out: np.ndarray
    base: np.ndarray

    def vectors(self, words: list[str]) -> np.ndarray:
        """The inputs of words."""
        bucket, grams, counts = word_features(words)
        out = np.empty((len(words), _IN), np.float32)
        out[:, :WORD_SIZE] = self.word[bucket]
        if len(words):
            sums = np.add.reduceat(self.char[grams], np.cumsum(counts) - counts, axis=0)
            out[:, WORD_SIZE:] = sums / np.sqrt(counts)[:, None]
        return out


def fresh(seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    zero = lambda *shape: np.zeros(shape, np.float32)
    return Model(
        zero(1 << WORD_BITS, WORD_SIZE), zero(1 << CHAR_BITS, CHAR_SIZE), draw(_IN, 6 * HIDDEN), zero(6 * HIDDEN), draw(HIDDEN, 3 * HIDDEN), draw(HIDDEN, 3 * HIDDEN),
        draw(2 * HIDDEN, ATTENTION), draw(ATTENTION), draw(2 * HIDDEN), np.full(1, -1, np.float32),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def run_direction(gates: np.ndarray, mask: np.ndarray | None, u: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (time, row, HIDDEN) for gates of inputs (time, row, 3 * HIDDEN); steps of mask 0 leave the state as it is."""
    steps, rows = gates.shape[:2]
    h, out, saved = np.zeros((rows, HIDDEN), np.float32), np.empty((steps, rows, HIDDEN), np.float32), []
    for t in range(steps):
        inner = h @ u
        zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + inner[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = np.tanh(gates[t, :, 2 * HIDDEN :] + r * inner[:, 2 * HIDDEN :])
        following = new + z * (h - new)
        if mask is not None:
            following = np.where(mask[t][:, None], following, h)
        if keep:
            saved.append((h, z, r, new, inner[:, 2 * HIDDEN :]))
        h = following
        out[t] = h
    return out, saved


def back_direction(d_out: np.ndarray, saved: list, mask: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates and of u."""
    steps, rows = d_out.shape[:2]
    d_gates, d_u, d_h = np.zeros((steps, rows, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((rows, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, new, inner = saved[t]
        on = mask[t][:, None]
        total = d_h + d_out[t]
        d = total * on
        d_new = d * (1 - z) * (1 - new * new)
        d_z = d * (h - new) * z * (1 - z)
        d_r = d_new * inner * r * (1 - r)
        d_inner = np.concatenate([d_z, d_r, d_new * r], axis=1)
        d_gates[t] = np.concatenate([d_z, d_r, d_new], axis=1)
        d_u += h.T @ d_inner
        d_h = d * z + d_inner @ u.T + total * ~on
    return d_gates, d_u


def pooled_logits(model: Model, forward: np.ndarray, backward: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, tuple]:
    states = np.concatenate([forward, backward], axis=2)
    hidden = np.tanh(states @ model.attend)
    score = hidden @ model.focus
    if mask is not None:
        score = np.where(mask, score, np.float32(-1e9))
    weight = np.exp(score - score.max(axis=0))
    if mask is not None:
        weight = weight * mask
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    return pooled @ model.out + model.base[0], (states, hidden, weight, pooled)


def window_logits(model: Model, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """Logits of windows: ids (row, time) of words, gates of words (word, both directions)."""
    by_time = ids.T
    forward, _ = run_direction(gates[by_time, : 3 * HIDDEN], None if mask is None else mask.T, model.forward)
    backward, _ = run_direction(gates[by_time[::-1], 3 * HIDDEN :], None if mask is None else mask.T[::-1], model.backward)
    return pooled_logits(model, forward, backward[::-1], None if mask is None else mask.T)[0]


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and first words of all windows of texts of so many words; the last window ends with its text."""
    steps = np.maximum(-(-(counts - WINDOW) // STRIDE), 0) + 1
    text = np.repeat(np.arange(len(counts)), steps)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(steps) - steps, steps)) * STRIDE
    return text, np.minimum(first, np.maximum(counts[text] - WINDOW, 0))


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.gates = np.zeros((0, 6 * HIDDEN), np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        new = list(set().union(*split).difference(self.index))
        if len(self.index) + len(new) > CACHE_ENTRIES // 2:
            self.clear()
            new = list(set().union(*split))
        if new or not len(self.gates):
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.gates = np.concatenate([self.gates, self.model.vectors(new) @ self.model.inputs + self.model.bias])
        counts = np.array([len(s) for s in split], np.int64)
        of = self.index.__getitem__
        ids = np.fromiter(map(of, itertools.chain.from_iterable(split)), np.int32, int(counts.sum()))
        return self.highest(ids, counts)

    def highest(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        begin = np.cumsum(counts) - counts
        text, first = windows(counts)
        logits = np.full(len(counts), -np.inf, np.float32)
        full = counts[text] >= WINDOW
        for whole in (True, False):
            mine = np.flatnonzero(full == whole)
            for a in range(0, len(mine), 2048):
                some = mine[a : a + 2048]
                place = (begin[text[some]] + first[some])[:, None] + np.arange(WINDOW)[None, :]
                mask = None
                if not whole:
                    mask = np.arange(WINDOW)[None, :] < counts[text[some]][:, None]
                    place = np.where(mask, place, 0)
                window = ids[place] if len(ids) else np.zeros(place.shape, np.int32)
                gates = self.gates if len(self.gates) else np.zeros((1, 6 * HIDDEN), np.float32)
                np.maximum.at(logits, text[some], window_logits(self.model, gates, window, mask))
        return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -40, 40)))


class Examples(NamedTuple):
    """Training documents as numbers of words."""

    vocabulary: list[str]
    ids: list[np.ndarray]
    label: np.ndarray


def examples(texts: list[str], labels: list[int]) -> Examples:
    index: dict[str, int] = {}
    ids = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int32) for t in texts]
    return Examples(list(index), ids, np.array(labels))


def _summed(rows: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
    """Rows added up by index."""
    return np.stack([np.bincount(index, rows[:, k], size) for k in range(rows.shape[1])], axis=1).astype(np.float32)


def document_counts(data: Examples, bucket: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """In how many documents of label 0 and 1 each word bucket and, after these, each n-gram bucket is."""
    seen, starts = np.zeros((2, (1 << WORD_BITS) + (1 << CHAR_BITS))), np.cumsum(counts) - counts
    for ids, y in zip(data.ids, data.label, strict=True):
        words = np.unique(ids)
        n = counts[words]
        own = grams[np.repeat(starts[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        seen[y, np.unique(np.concatenate([bucket[words], own + (1 << WORD_BITS)]))] += 1
    return seen


class Trainer:
    """Adagrad over windows; embeddings learn at a higher rate, being touched rarely."""

    def __init__(self, data: Examples, seed: int = 7) -> None:
        self.data, self.rng, self.model = data, np.random.default_rng(seed), fresh()
        self.bucket, self.grams, self.counts = word_features(data.vocabulary)
        self.first = np.cumsum(self.counts) - self.counts
        self.seen = document_counts(data, self.bucket, self.grams, self.counts)
        # Features of few documents would be learned by heart; they stay at zero, as what training never saw does.
        often = self.seen.sum(axis=0) >= LEAST_DOCUMENTS
        self.often = (often[: 1 << WORD_BITS], often[1 << WORD_BITS :])
        self.squares = [np.full_like(p, 1e-8) for p in self.model]

    def apply(self, k: int, gradient: np.ndarray, rate: float, at: np.ndarray | slice = slice(None)) -> None:
        self.squares[k][at] += gradient * gradient
        self.model[k][at] -= rate * gradient / np.sqrt(self.squares[k][at])

    def vectors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The inputs of words of the vocabulary, their n-grams and the number of these."""
        m, counts = self.model, self.counts[words]
        grams = self.grams[np.repeat(self.first[words] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
        sums = np.add.reduceat(m.char[grams], np.cumsum(counts) - counts, axis=0) / np.sqrt(counts)[:, None]
        return np.concatenate([m.word[self.bucket[words]], sums], axis=1).astype(np.float32), grams, counts

    def step(self, ids: np.ndarray, mask: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
        m = self.model
        words, local = np.unique(ids, return_inverse=True)
        local = local.reshape(ids.shape)
        vectors, grams, counts = self.vectors(words)
        owner = np.repeat(np.arange(len(words)), counts)
        gates = (vectors @ m.inputs + m.bias)[local.T]
        on = mask.T
        forward, saved_f = run_direction(gates[:, :, : 3 * HIDDEN], on, m.forward, True)
        backward, saved_b = run_direction(np.ascontiguousarray(gates[::-1, :, 3 * HIDDEN :]), on[::-1], m.backward, True)
        logit, (states, hidden, attention, pooled) = pooled_logits(m, forward, backward[::-1], on)
        p = _sigmoid(logit)
        d_logit = ((p - label) * weight / weight.sum()).astype(np.float32)
        d_pooled = d_logit[:, None] * m.out[None, :]
        d_states = attention[:, :, None] * d_pooled[None]
        d_attention = np.einsum("tbh,bh->tb", states, d_pooled)
        d_score = attention * (d_attention - (attention * d_attention).sum(axis=0))
        d_hidden = d_score[:, :, None] * m.focus * (1 - hidden * hidden)
        d_states += d_hidden @ m.attend.T
        g_f, d_uf = back_direction(d_states[:, :, :HIDDEN], saved_f, on, m.forward)
        g_b, d_ub = back_direction(d_states[::-1, :, HIDDEN:], saved_b, on[::-1], m.backward)
        d_gates = np.concatenate([g_f, g_b[::-1]], axis=2).reshape(-1, 6 * HIDDEN)
        d_word_gates = _summed(d_gates, local.T.ravel(), len(words))
        d_vectors = d_word_gates @ m.inputs.T
        rate = 0.03
        self.apply(2, vectors.T @ d_word_gates, rate)
        self.apply(3, d_gates.sum(axis=0), rate)
        self.apply(4, d_uf, rate)
        self.apply(5, d_ub, rate)
        self.apply(6, np.einsum("tbh,tba->ha", states, d_hidden), rate)
        self.apply(7, np.einsum("tb,tba->a", d_score, hidden), rate)
        self.apply(8, d_logit @ pooled, rate)
        self.apply(9, d_logit.sum(keepdims=True), rate)
        for k, index, rows in ((0, self.bucket[words], d_vectors[:, :WORD_SIZE]), (1, grams, (d_vectors[:, WORD_SIZE:] / np.sqrt(counts)[:, None])[owner])):
            at, inverse = np.unique(index, return_inverse=True)
            self.apply(k, _summed(rows, inverse, len(at)) * self.often[k][at][:, None], 0.1, at)
        return float(-(weight * np.log(np.where(label > 0.5, p, 1 - p) + 1e-7)).sum() / weight.sum())

    def cut(self, doc: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        ids = self.data.ids[doc][first : first + WINDOW]
        return np.pad(ids, (0, WINDOW - len(ids))), np.arange(WINDOW) < len(ids)

    def fit(self, chosen: list[tuple[int, int, int]], epochs: int) -> None:
        """chosen: document, first word and label of each window."""
        cut = [self.cut(d, f) for d, f, _ in chosen]
        ids, mask = np.stack([c[0] for c in cut]), np.stack([c[1] for c in cut])
        label = np.array([y for _, _, y in chosen], np.float32)
        weight = np.where(label > 0.5, max(1.0, 0.5 * float((label < 0.5).sum()) / max(float(label.sum()), 1.0)), 1.0).astype(np.float32)
        for _ in range(epochs):
            order = self.rng.permutation(len(chosen))
            for a in range(0, len(order), 256):
                some = order[a : a + 256]
                self.step(ids[some], mask[some], label[some], weight[some])

    def highest_windows(self) -> list[tuple[int, float]]:
        """First word and logit of the model's highest window of each document."""
        out = []
        for ids in self.data.ids:
            words, local = np.unique(ids, return_inverse=True)
            gates = self.vectors(words)[0] @ self.model.inputs + self.model.bias

            def logits(place: np.ndarray) -> np.ndarray:
                mask = place < len(ids)
                return window_logits(self.model, gates, local[np.minimum(place, len(ids) - 1)], None if mask.all() else mask)

            out.append(best_window(len(ids), logits))
        return out


def best_window(words: int, value: Callable[[np.ndarray], np.ndarray]) -> tuple[int, float]:
    """First word and value of the first window of the highest value, of all windows of a text of so many words.

    value gets the places of the words of TRAIN_WINDOWS windows at most, which may be beyond the end of a short text.
    """
    _, first = windows(np.array([words]))
    found = (0, -np.inf)
    for a in range(0, len(first), TRAIN_WINDOWS):
        some = first[a : a + TRAIN_WINDOWS]
        got = value(some[:, None] + np.arange(WINDOW)[None, :])
        k = int(got.argmax())
        if got[k] > found[1]:
            found = (int(some[k]), float(got[k]))
    return found


def seeds(trainer: Trainer) -> list[int]:
    """First word of the window of each document with the features most frequent in documents of label 1."""
    data, seen = trainer.data, trainer.seen
    total = np.array([max(int((data.label == y).sum()), 1) for y in (0, 1)])
    odds = np.log((seen[1] + 0.3) / (total[1] + 1)) - np.log((seen[0] + 0.3 * total[0] / total[1]) / (total[0] + 1))
    odds *= np.sqrt(np.minimum(seen[1], 20)) * (seen.sum(axis=0) >= LEAST_DOCUMENTS)
    odds = odds.astype(np.float32)
    best = np.maximum(odds[trainer.bucket], np.maximum.reduceat(odds[1 << WORD_BITS :][trainer.grams], trainer.first))
    return [best_window(len(ids), lambda place, ids=ids: np.sort(best[ids[np.minimum(place, len(ids) - 1)]], axis=1)[:, -3:].sum(axis=1))[0] for ids in data.ids]


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """The model for documents of these labels; it is the same for the same documents in the same order."""
    kept = [(t, y) for t, y in zip(texts, labels, strict=True) if words_of(t)]
    if len({y for _, y in kept}) < 2:
        return fresh()
    data = examples([t for t, _ in kept], [y for _, y in kept])
    trainer = Trainer(data, seed)
    begin = seeds(trainer)
    several = max(1, min(6, 4 * int((data.label == 1).sum()) // max(int((data.label == 0).sum()), 1)))

    def random_windows(d: int) -> list[int]:
        _, first = windows(np.array([len(data.ids[d])]))
        return [int(first[k]) for k in trainer.rng.integers(0, len(first), several)]

    chosen = [(d, begin[d], int(y)) for d, y in enumerate(data.label)] + [(d, f, 0) for d, y in enumerate(data.label) if not y for f in random_windows(d)]
    rounds = 3
    epochs = int(np.clip(9000 // len(chosen), 4, 30))
    trainer.fit(chosen, epochs)
    for _ in range(rounds):
        top = trainer.highest_windows()
        hard = [(d, top[d][0], 0) for d, y in enumerate(data.label) if not y]
        positive = [(d, top[d][0], 1) for d, y in enumerate(data.label) if y] + [(d, begin[d], 1) for d, y in enumerate(data.label) if y and top[d][1] < 0]
        chosen = list(dict.fromkeys([*[c for c in chosen if not c[2]], *hard, *positive]))
        trainer.fit(chosen, max(2, epochs // 3))
    return trainer.model


def held_out(key: str) -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def train_on(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Train on labelled documents that aren't held out."""
    usable = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    picked = [r for y in (0, 1) for r in usable.filter(F.col("label") == y).orderBy(F.xxhash64(key), key).limit(sample).collect()]
    if not picked:
        return fresh()
    spark = documents.sparkSession
    few = F.broadcast(spark.createDataFrame([(r[0], r[1]) for r in picked], usable.schema))  # 2 * sample rows at most
    rows = documents.select(key, text).join(few, key).groupBy(key).agg(F.min(text).alias("text"), F.max("label").alias("label")).collect()
    rows.sort(key=lambda r: (r["label"], r[key]))
    return train([r["text"] or "" for r in rows], [r["label"] for r in rows])


def _scorer(token: bytes) -> Scorer:
    import pickle

    return held(("scorer", token), lambda: Scorer(pickle.loads(token)))


def score(df: DataFrame, model: Model, *keep: str, text: str = "text") -> DataFrame:
    """Columns keep, score and predicted."""
    import pickle

    token = pickle.dumps(model)
    sent = df.sparkSession.sparkContext.broadcast(token)  # of fixed size

    def run(texts: list[str]) -> dict[str, object]:
        found = _scorer(sent.value).scores(texts)
        return {"score": found, "predicted": (found >= 0.5).astype(np.int32)}

    return map_texts(df, [F.col(k) for k in keep], F.col(text), "score double, predicted int", run)


def without_toxic(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of df that score below 0.5."""
    import pickle

    sent = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    return filter_texts(df, text, lambda texts: _scorer(sent.value).scores(texts) < 0.5)
