"""Removal of repeated byte strings by suffix arrays.

A byte is removed if a string of LENGTH bytes that covers it also starts anywhere else, in the same or another text.

1. Starts are gathered in runs with a common anchor (anchors.py). Equal strings have the anchor at the same place,
   so a string can repeat only within the runs whose bytes from the anchor on (`sure`) hash alike. Runs whose hash
   occurs once are done, as are runs of which all bytes occur twice: every string in them is repeated.
2. What is left are runs that agree at the anchor and differ somewhere in reach, one for each distinct content. These
   go, by `sure`, to tasks that hold some thousands of them; each cuts them into blocks of BLOCK bytes, counted
   from the anchor, and sorts all suffixes of the blocks by linear grouping (suffix_array.py). Neighbours in the
   array with a common prefix of LENGTH // BLOCK - 1 blocks are the starts that can repeat, up to less than a block
   at either end; an exact check of the whole strings of these settles the bytes at the ends.
3. A hash that more than LARGEST distinct runs share would not fit a task. Its runs are cut into aligned ranges of
   starts, which are grouped by the bytes that all strings of the range hold, so that equal strings still meet; ranges
   whose group has one content are done, as are those that occur wholly twice. What is left goes to the suffix sort
   as the runs do, by groups that fit; groups that still do not are cut to narrower ranges (RANGES). In
   ranges of one start all contents of a group are equal, so every group comes to fit.

4. Passages are also told by their words, whatever bytes these take: each word goes in as a code of CODE bytes, so that
   LENGTH bytes are WORDS words, and steps 1 to 3 find the strings of words that repeat (word_codes, without_repeats).

All counts are over all texts, however large; texts are never cut. Null and empty texts have no bytes. Equality of
strings is judged by 128 bits of hash (64 within the runs that agree at the anchor), of words by 48 bits. Repeated rows repeat each other's bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import LENGTH, SPAN, prefix_sums, runs
from .common import CACHE_ENTRIES, STEP_CHARS, Batches, T1, T2, checkpoint, held, keyed, release, slices, worker
from .shingles import mix
from .suffix_array import suffix_array

BLOCK = 16
#: Distinct runs of one hash that a task sorts; of contents that it sorts at a time.
LARGEST, AT_ONCE = 2000, 1500
#: Widths of ranges, in starts, to which groups that are too large are cut in turn.
RANGES = (64, 16, 4, 1)
#: Texts whose digests are sent to every executor to pick them; more are joined by a shuffle.
SENT_KEYS = 300_000
_U = np.uint64
_WIDTH = -(-(SPAN + LENGTH) // BLOCK) * BLOCK + BLOCK
SPANS, WORD_SPANS = "__spans", "__word_spans"
#: Bytes of a word's code, and the words that LENGTH bytes of codes are.
CODE = 8
WORDS = LENGTH // CODE
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _utf8(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "replace") for t in texts]


def _code(word: bytes) -> bytes:
    return base64.b64encode(hashlib.blake2b(word, digest_size=CODE * 3 // 4).digest())


def word_codes(texts: list[str]) -> list[bytes]:
    """The words of each text, CODE bytes each."""
    split = [t.encode("utf-8", "replace").split() for t in texts]
    codes = held(("codes",), dict)
    new = set().union(*split).difference(codes)
    if len(codes) + len(new) > CACHE_ENTRIES:
        codes.clear()
        new = set().union(*split)
    codes.update((w, _code(w)) for w in new)
    of = codes.__getitem__
    return [b"".join(map(of, words)) for words in split]


def _pack(first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return first << 18 | (last - first) << 9 | (anchor - first)


def run_rows(texts: DataFrame, data: Callable[[list[str]], list[bytes]] = _utf8) -> DataFrame:
    """T1, T2, place (first start, length and anchor of the run), sure and whole, of each run of the data of each text (column text)."""
    step = STEP_CHARS if data is _utf8 else 2 * STEP_CHARS // CODE  # codes of the shortest words with their white space: the same bytes

    def run(batches: Batches) -> Batches:
        for batch in batches:
            t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, _, strings in slices(batch.column(2), step):
                r = runs(data(strings))
                columns = (t1[a + r.text], t2[a + r.text], _pack(r.first, r.last, r.anchor), r.sure.view(np.int64), r.whole.view(np.int64))
                for at in range(0, len(r.text), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000]) for c in columns], names=[T1, T2, "place", "sure", "whole"])

    return texts.select(T1, T2, "text").mapInArrow(worker(run), f"{T1} long, {T2} long, place long, sure long, whole long")


def _positions(place: Column) -> tuple[Column, Column]:
    first = F.shiftright(place, 18)
    return first, first + F.shiftright(place, 9).bitwiseAND(511)


def cut_out(texts: DataFrame, wanted: DataFrame, data: Callable[[list[str]], list[bytes]] = _utf8) -> DataFrame:
    """wanted (T1, T2, sure, place, own), with the bytes of each run's strings."""
    keys = wanted.select(T1, T2).distinct()
    few = keys.count() <= SENT_KEYS
    chosen = texts.join(F.broadcast(keys) if few else keys, [T1, T2], "left_semi").dropDuplicates([T1, T2])
    lists = wanted.groupBy(T1, T2).agg(F.collect_list(F.struct("sure", "place", "own")).alias("runs"))

    def run(batches: Batches) -> Batches:
        names = [T1, T2, "sure", "place", "own", "bytes"]
        for batch in batches:
            for k in range(batch.num_rows):
                t1, t2, whole = (batch.column(c)[k].as_py() for c in range(3))
                whole = data([whole])[0]
                items = batch.column(3)[k].values.flatten()
                sure, place, own = (c.to_numpy(zero_copy_only=False) for c in items)
                first = place >> 18
                last = first + (place >> 9 & 511)
                for at in range(0, len(sure), 2000):
                    some = slice(at, at + 2000)
                    cut = [whole[x : y + LENGTH] for x, y in zip(first[some].tolist(), last[some].tolist(), strict=True)]
                    n = len(cut)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t1] * n, pa.int64()), pa.array([t2] * n, pa.int64()), pa.array(sure[some]), pa.array(place[some]), pa.array(own[some]), pa.array(cut, pa.binary())], names=names
                    )

    joined = chosen.select(T1, T2, "text").join(lists, [T1, T2])
    return joined.mapInArrow(worker(run), f"{T1} long, {T2} long, sure long, place long, own boolean, bytes binary")


def repeated_starts(group: np.ndarray, place: np.ndarray, contents: list[bytes]) -> list[np.ndarray]:
    """For each run, which of its starts have a string that another run of its group has at the same place from its anchor."""
    m = len(contents)
    length, lead = (place >> 9 & 511) + 1, place & 511
    begin = SPAN - lead  # where the run begins, counted from SPAN bytes before its anchor
    grid = np.zeros((m, _WIDTH), np.uint8)
    for k, content in enumerate(contents):
        grid[k, begin[k] : begin[k] + len(content)] = np.frombuffer(content, np.uint8)
    # Symbols: blocks that a run fills, told apart by group and place.
    columns = np.arange(_WIDTH // BLOCK)
    low, high = -(-begin // BLOCK), (begin + length - 1 + LENGTH) // BLOCK
    full = (columns[None, :] >= low[:, None]) & (columns[None, :] < high[:, None])
    halves = grid.view(_U).reshape(m, -1, 2)
    value = mix(mix(halves[:, :, 0] + _U(1)) + halves[:, :, 1] * _U(0x9E3779B97F4A7C15) + mix((group.astype(_U)[:, None] << _U(16)) + columns.astype(_U)[None, :]))
    counts = full.sum(axis=1)
    starts = np.cumsum(counts + 1) - counts - 1
    symbols = np.zeros(int((counts + 1).sum()), np.int64)  # 0 ends a run
    inside = np.ones(len(symbols), bool)
    inside[starts + counts] = False
    symbols[inside] = np.unique(value[full], return_inverse=True)[1] + 1
    array = suffix_array(symbols)
    need = LENGTH // BLOCK - 1
    ahead = np.zeros(len(symbols), np.int64)
    ahead[inside] = (np.repeat(starts + counts, counts + 1) - np.arange(len(symbols)))[inside]
    a, b = array[:-1], array[1:]
    ok = np.flatnonzero((ahead[a] >= need) & (ahead[b] >= need))
    for k in range(need):
        ok = ok[symbols[a[ok] + k] == symbols[b[ok] + k]]
    near = np.zeros(len(symbols), bool)
    near[a[ok]] = True
    near[b[ok]] = True
    # Starts whose first whole block is near another's; their strings are checked whole.
    run = np.repeat(np.arange(m), length)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(length) - length, length) + begin[run]
    candidate = np.flatnonzero(near[starts[run] + -(-offset // BLOCK) - low[run]])
    found = np.zeros(len(run), bool)
    if len(candidate):
        flat, where = grid.ravel(), run[candidate] * _WIDTH + offset[candidate]
        h1, h2 = (prefix_sums(flat, seed).hash(where, where + LENGTH) for seed in (0, 7))
        key = mix(h1 ^ mix((group[run[candidate]].astype(_U) << _U(16)) + offset[candidate].astype(_U)))
        order = np.argsort(key)
        same = (key[order][1:] == key[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        found[candidate[order[1:][same]]] = True
        found[candidate[order[:-1][same]]] = True
    return np.split(found, np.cumsum(length)[:-1])


def _ranges(first: int, marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.diff(marks.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    return [(first + int(a), first + int(b) - 1) for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True)]


def sorted_out(contents: DataFrame) -> DataFrame:
    """T1, T2, low, high: ranges of starts of repeated strings, of runs with own set; contents in one task by sure."""

    def run(batches: Batches) -> Batches:
        held: list[tuple] = []

        def settle() -> pa.RecordBatch:
            sure = np.array([h[0] for h in held], np.int64)
            marks = repeated_starts(np.unique(sure, return_inverse=True)[1], np.array([h[1] for h in held], np.int64), [h[3] for h in held])
            rows = [(h[4], h[5], x, y) for h, found in zip(held, marks, strict=True) if h[2] for x, y in _ranges(h[1] >> 18, found)]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=[T1, T2, "low", "high"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("sure", "place", "own", "bytes", T1, T2)), strict=True):
                if len(held) >= AT_ONCE and held[-1][0] != row[0]:
                    yield settle()
                    held.clear()
                held.append(row)
        if held:
            yield settle()

    dealt = contents.repartition("sure").sortWithinPartitions("sure")
    return dealt.mapInArrow(worker(run), f"{T1} long, {T2} long, low long, high long")


def narrowed(contents: DataFrame, width: int) -> DataFrame:
    """contents cut to aligned ranges of width starts; sure: of the bytes that all strings of a range hold, whole: of all its bytes."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                out: list[tuple] = []
                for t1, t2, sure, place, own, content in zip(*(part.column(c).to_pylist() for c in (T1, T2, "sure", "place", "own", "bytes")), strict=True):
                    first, length, lead = place >> 18, (place >> 9 & 511) + 1, place & 511
                    begin = SPAN - lead
                    for t in range(begin // width, (begin + length - 1) // width + 1):
                        low, high = max(t * width, begin), min(t * width + width, begin + length)
                        # A string with a start in the range holds these bytes, whether or not the run has all of its starts.
                        core = content[t * width + width - 1 - begin : t * width + LENGTH - begin]
                        bytes_ = content[low - begin : high - begin - 1 + LENGTH]
                        keys = (_digest(b"%d,%d," % (sure, t) + core), _digest(b"%d,%d," % (low, high) + bytes_))
                        at = first + low - begin
                        out.append((t1, t2, keys[0], at << 18 | (high - low - 1) << 9 | (first + lead - at), own, bytes_, keys[1]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_NAMES)

    return contents.mapInArrow(worker(run), f"{T1} long, {T2} long, sure long, place long, own boolean, bytes binary, whole long")


_NAMES = [T1, T2, "sure", "place", "own", "bytes", "whole"]
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64())


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def settled(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks of the pieces that occur wholly twice; and what stays open: each other piece of a hash that several contents share, and one of each of these."""
    found = pieces.groupBy("sure", "whole").agg(F.count("*").alias("n"), F.max("own").alias("asked"), F.min(F.struct(T1, T2, "place")).alias("at"))
    found = checkpoint(found.withColumn("asked", F.col("asked") & (F.col("n") == 1)))
    sizes = found.groupBy("sure").agg(F.count("*").alias("size"), F.max("asked").alias("open")).filter((F.col("size") > 1) & F.col("open"))
    facts = checkpoint(found.join(sizes.select("sure", "size"), "sure", "left").filter((F.col("n") > 1) | F.col("size").isNotNull()).select("sure", "whole", "n", "at", "size"))
    known = pieces.join(facts, ["sure", "whole"])
    first, last = _positions(F.col("place"))
    marks = known.filter((F.col("n") > 1) & F.col("own")).select(T1, T2, first.alias("low"), last.alias("high"))
    left = known.filter(F.col("size").isNotNull() & (F.struct(T1, T2, "place") == F.col("at")))
    return marks, left.select(T1, T2, "sure", "place", (F.col("own") & (F.col("n") == 1)).alias("own"), "bytes", (F.col("size") > LARGEST).alias("large"))


def repeated(df: DataFrame, text: str, data: Callable[[list[str]], list[bytes]] = _utf8) -> DataFrame:
    """T1, T2 and SPANS (low and high starts of repeated strings of data) of every text that has any; df: with T1 and T2."""
    least = LENGTH if data is _utf8 else 2 * WORDS - 1
    texts = df.select(T1, T2, F.col(text).cast("string").alias("text")).filter(F.octet_length("text") >= least)
    all_runs = run_rows(texts, data)
    by_sure = all_runs.groupBy("sure").agg(F.count("*").alias("n"), F.min("whole").alias("x"), F.max("whole").alias("y")).filter(F.col("n") > 1)
    # Cut off from its aggregation, so that Spark can split a hash that a large part of all runs has.
    by_sure = checkpoint(by_sure.select("sure", (F.col("x") != F.col("y")).alias("mixed")))
    release(df.sparkSession)
    kept = checkpoint(all_runs.join(by_sure, "sure"))
    distinct = kept.filter("mixed").groupBy("sure", "whole").agg(F.count("*").alias("n"), F.min(F.struct(T1, T2, "place")).alias("at"))
    distinct = checkpoint(distinct)
    sizes = distinct.groupBy("sure").agg(F.count("*").alias("size"), F.min("n").alias("least"))
    # Only hashes of which some content occurs once are open; the others serve them for comparison.
    open_ = distinct.join(sizes.filter(F.col("least") == 1), "sure")
    wanted = checkpoint(open_.select("at.*", "sure", (F.col("n") == 1).alias("own"), (F.col("size") > LARGEST).alias("large")))
    first, last = _positions(F.col("place"))
    once = distinct.filter(F.col("n") == 1).select("sure", "whole")
    whole = kept.filter(~F.col("mixed")).select(T1, T2, "place").union(kept.filter("mixed").join(once, ["sure", "whole"], "left_anti").select(T1, T2, "place"))
    found = [whole.select(T1, T2, first.alias("low"), last.alias("high")), sorted_out(cut_out(texts, wanted.filter(~F.col("large")), data))]
    if not (many := wanted.filter("large")).isEmpty():
        left = cut_out(texts, many, data)
        for width in RANGES:
            marks, rest = settled(checkpoint(narrowed(left, width)))
            rest = checkpoint(rest)
            found += [marks, sorted_out(rest.filter(~F.col("large")))]
            left = rest.filter("large")
            if left.isEmpty():
                break
    marks = functools.reduce(DataFrame.union, found)
    return marks.distinct().groupBy(T1, T2).agg(F.collect_list(F.struct("low", "high")).alias(SPANS))


def removed(length: int, spans: pa.ListScalar) -> np.ndarray:
    """Which bytes the strings that start in spans (structs of low and high) cover."""
    low, high = (c.to_numpy(zero_copy_only=False) for c in spans.values.flatten())
    change = np.zeros(length + 1, np.int32)
    np.add.at(change, low, 1)
    np.add.at(change, high + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def removed_words(data: bytes, spans: pa.ListScalar) -> np.ndarray:
    """Which bytes lie within the words, and between those that follow each other, that the strings of codes that start in spans cover."""
    low, high = (c.to_numpy(zero_copy_only=False) for c in spans.values.flatten())
    first, last = -(-low // CODE), high // CODE  # a string of codes starts where a word's does
    first, last = first[first <= last], last[first <= last] + WORDS - 1
    at = np.array([m.span() for m in _WORD.finditer(data)], np.int64).reshape(-1, 2)
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, at[first, 0], 1)
    np.add.at(change, at[last, 1], -1)
    return np.cumsum(change[:-1]) > 0


def _marked(df: DataFrame, text: str, words: bool = False) -> DataFrame:
    own = keyed(df, text)
    found = own.join(repeated(own, text), [T1, T2], "left")
    return found.join(repeated(own, text, word_codes).withColumnRenamed(SPANS, WORD_SPANS), [T1, T2], "left") if words else found


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that are left, joined) and touched (if any byte is removed)."""
    marked = _marked(df.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), "text").select(key, "text", SPANS)

    def run(batches: Batches) -> Batches:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                out = []
                for text_, spans in zip(texts, batch.column(2).slice(a, b - a), strict=True):
                    whole = text_.encode("utf-8", "replace")
                    gone, n, kept = 0, 0, whole
                    if spans.is_valid:
                        mask = removed(len(whole), spans)
                        gone, n = int(mask.sum()), int((np.diff(mask.astype(np.int8), prepend=np.int8(0)) == 1).sum())
                        kept = np.frombuffer(whole, np.uint8)[~mask].tobytes()
                    out.append((len(whole), gone, n, hashlib.sha256(kept).hexdigest(), gone > 0))
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "touched"]
                )

    kind = df.schema[key].dataType.simpleString()
    return marked.mapInArrow(worker(run), f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, touched boolean")


def without_repeats(df: DataFrame, text: str = "text", words: bool = False) -> DataFrame:
    """df with the repeated bytes taken out of its texts; characters that lose some of their bytes go.

    words: with the repeated strings of WORDS words too (of words `[^\\x20\\x09-\\x0D]+`, whatever white space is between them).
    """
    names = df.columns
    marked = _marked(df, text, words).select(*names, SPANS, *[WORD_SPANS] * words)
    at = names.index(text)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for a, b, _ in slices(batch.column(at)):
                part, out = batch.slice(a, b - a), []
                for whole, *spans in zip(part.column(at).to_pylist(), *part.columns[len(names) :], strict=True):
                    if any(s.is_valid for s in spans):
                        data = whole.encode("utf-8", "replace")
                        gone = np.zeros(len(data), bool)
                        for cover, found in zip((lambda d, s: removed(len(d), s), removed_words), spans, strict=False):
                            if found.is_valid:
                                gone |= cover(data, found)
                        whole = np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
                    out.append(whole)
                columns = [part.column(c) if c != at else pa.array(out, part.column(at).type) for c in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return marked.mapInArrow(worker(run), df.schema)
