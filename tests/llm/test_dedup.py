"""Suffix arrays, repeated strings, set joins, embeddings and components against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tidemark.llm import anchors, common, components, embedding_dedup, ngram_join, shingles, suffix_dedup
from tidemark.llm.suffix_array import suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(symbols):
    assert suffix_array(symbols).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_anchors_depend_on_their_string_alone():
    rng = random.Random(3)
    core = bytes(rng.choice(b"abcd ") for _ in range(900))
    places = []
    for k in range(5):
        text = bytes(rng.choice(b"xyz") for _ in range(k * 37)) + core + bytes(rng.choice(b"uvw") for _ in range(90))
        r = anchors.runs([b"pad", text])
        lead = {s - k * 37: a - k * 37 for f, last, a in zip(r.first, r.last, r.anchor, strict=True) for s in range(f, last + 1)}
        places.append([lead[s] for s in range(900 - anchors.LENGTH + 1)])
    assert all(p == places[0] for p in places)


def plain_removed(texts):
    data = [(t or "").encode() for t in texts]
    n = suffix_dedup.LENGTH
    seen = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def passages(rng):
    word = lambda k: "".join(rng.choice("abcdefg hij\n") for _ in range(k))
    base, other = word(900), word(500)
    texts = [None, "", base[:399], base[:400], "z" * 399, "z" * 401, "z" * 900, "ab" * 300, base + other, other + base, "é" * 250, "é" * 250 + "x"]
    texts += [word(rng.randint(0, 300)) + base[rng.randint(0, 300) : rng.randint(500, 900)] + word(rng.randint(0, 300)) for _ in range(25)]
    return texts + [texts[8], texts[14]]


@pytest.mark.parametrize("largest", [2000, 2])
def test_repeated_strings(spark, documents, rng, monkeypatch, largest):
    monkeypatch.setattr(suffix_dedup, "LARGEST", largest)
    texts = passages(rng) + [r["text"] for r in documents.orderBy("doc_id").limit(40).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = suffix_dedup.digests(df).collect()
    found = {r["doc_id"]: tuple(r)[1:5] for r in rows}
    assert all(r["touched"] == (r["n_removed"] > 0) for r in rows)
    assert [found[k] for k in range(len(texts))] == plain_removed(texts)


def test_near_copies_of_one_passage_in_narrow_ranges(spark, rng, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LARGEST", 3)
    base = [rng.choice("abcdefgh ") for _ in range(700)]
    texts = []
    for _ in range(60):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            own[rng.randrange(len(own))] = rng.choice("xyz")
        texts.append("".join(own)[rng.randrange(200) :])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = suffix_dedup.digests(df).collect()
    found = {r["doc_id"]: tuple(r)[1:5] for r in rows}
    assert all(r["touched"] == (r["n_removed"] > 0) for r in rows)
    assert [found[k] for k in range(len(texts))] == plain_removed(texts)


def test_texts_without_repeats_keep_their_columns(spark):
    shared = "".join(random.Random(1).choice("abcdé ") for _ in range(600))
    df = spark.createDataFrame([(1, "x" + shared + "y", "k"), (2, shared, "k"), (2, shared, "k"), (None, None, None)], "doc_id long, text string, spans string")
    found = sorted(map(tuple, suffix_dedup.without_repeats(df).collect()), key=repr)
    assert found == sorted([(1, "xy", "k"), (2, "", "k"), (2, "", "k"), (None, None, None)], key=repr)
    assert suffix_dedup.without_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("largest", [2000, 2])
def test_repeated_passages_of_words_go(spark, rng, monkeypatch, largest):
    monkeypatch.setattr(suffix_dedup, "LARGEST", largest)
    n = suffix_dedup.WORDS
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(3, 6)))
    some = lambda k: [word() for _ in range(k)]
    shared = some(n + 5)
    assert n == 50 and len(" ".join(shared).encode()) < suffix_dedup.LENGTH
    lists = [some(k) + shared + some(30) for k in (0, 7, 60)] + [some(9) + shared[: n - 1] + some(9), some(20) + shared[2 : n + 2], some(300), ["z"] * (n - 1), ["y"] * (n + 1)]
    lists += [some(rng.randint(0, 40)) + shared[k % 6 : k % 6 + n] + some(5) for k in range(8)]
    texts = [None, "", *("".join(w + rng.choice([" ", "\n", " \t"]) for w in words) for words in lists), "\n".join(some(10) + lists[5] + some(4))]
    counts = Counter(tuple(w[i : i + n]) for w in ((t or "").split() for t in texts) for i in range(len(w) - n + 1))
    kept = []
    for t in texts:
        w = (t or "").split()
        gone = {i + k for i in range(len(w) - n + 1) if counts[tuple(w[i : i + n])] > 1 for k in range(n)}
        kept.append([x for i, x in enumerate(w) if i not in gone])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = dict(map(tuple, suffix_dedup.without_repeats(df, words=True).collect()))
    assert found[0] is None and [(found[k] or "").split() for k in range(len(texts))] == kept
    assert suffix_dedup.without_repeats(df.limit(0), words=True).count() == 0


def test_pipeline_drops_passages_of_words_below_the_bytes(spark, data, rng):
    passage = " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(52))
    df = spark.createDataFrame([(k, f"{rng.random()} {passage} {rng.random()}", "en", "s", 0) for k in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert len(passage) < suffix_dedup.LENGTH
    rows = corpus_pipeline.drop_repeated_passages(spark, df, data).collect()
    assert len(rows) == 3 and all(passage not in r["text"] and r["n_chars"] == len(r["text"]) for r in rows)


def plain_set(text, width):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def plain_groups(rows, width, percent):
    sets = [(k, plain_set(t, width)) for k, t in rows]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if None not in (a, b) and x and y and 100 * len(x & y) >= percent * len(x | y)]
    root = dict(zip(*components.forest([a for a, _ in links], [b for _, b in links]), strict=True))
    return {k: (len(s), root.get(k, k)) for k, s in sets}


def near_copies(rng):
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(120):
        size = rng.choice([1, 3, 4, 5, 6, 9, 14, 20, 33, 60, 130])
        text = [rng.choice(words) for _ in range(size)] if k % 3 == 0 or not rows else rows[rng.randrange(len(rows))][1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + [rng.choice(words)] + text[at + rng.randint(0, 1) :]
        rows.append((k, " ".join(text)))
    return rows


@pytest.mark.parametrize(("width", "percent", "block"), [(4, 85, 256), (5, 80, 3), (2, 60, 256)])
def test_groups(spark, rng, monkeypatch, width, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "ORDERS", 1)
    monkeypatch.setattr(ngram_join, "FIRST", 1 if block == 3 else 16)
    rows = near_copies(rng) + [(500, None), (501, ""), (502, " \t"), (503, "A b C"), (504, "a B c"), (505, "w1 w2 w3"), (3, "w1 w2 w3 w4 w5 w6"), (None, "a b c")]
    rows = [r for r in rows if r[0] != 3 or r[1].startswith("w1 w2 w3 w4 w5 w6")]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent).collect()}
    assert found == plain_groups(rows, width, percent) | {None: (len(plain_set("a b c", width)), None)}


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(4)
    for percent in (85, 80, 60):
        for _ in range(800):
            n = int(rng.choice([6, 7, 8, 10, 15, 31, 32, 33, 64, 100, 128, 300]))
            a = np.unique(rng.integers(1, 2**62, n).astype(np.uint64))
            d = int(rng.integers(0, max(1, n * (110 - percent) // 100) + 1))
            b = np.unique(np.concatenate([a[d:], rng.integers(1, 2**62, int(rng.integers(0, d + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert len(np.intersect1d(ngram_join.part_keys(a, percent), ngram_join.part_keys(b, percent)))


def test_one_of_each_group_stays(spark):
    text = "a b c d e f g h i j"
    df = spark.createDataFrame([(3, text, 1), (2, text, 2), (2, text, 2), (7, "other words of a text here", 3), (8, None, 4), (None, text, 5), (None, None, 6)], "doc_id long, text string, n long")
    found = sorted(((r["doc_id"], r["n"]) for r in ngram_join.keep_one(df).collect()), key=repr)
    # A row without an id is a copy like any other; a row without words never is one.
    assert found == sorted([(2, 2), (7, 3), (8, 4), (None, 6)], key=repr)
    assert ngram_join.groups(df.limit(0)).count() == 0


def test_rows_that_share_an_id_go_by_their_own_text(spark):
    a, b, c = "a b c d e f g h i j", "k l m n o p q r s t", "u v w x y z 1 2 3 4"
    rows = [(1, a, 1), (2, b, 2), (2, a + " k", 3), (2, c, 4), (2, c, 5), (None, c, 6), (None, "5 6 7 8 9 10", 7), (None, "5 6 7 8 9 10", 8), (3, "", 9), (3, None, 10)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, n long, component_id string, lead string").repartition(3)
    found = ngram_join.keep_one(df)
    assert found.columns == df.columns
    kept = sorted(r["n"] for r in found.collect())
    assert kept in ([1, 2, x, y, 9, 10] for x in (4, 5) for y in (7, 8))


def test_copies_are_dropped_without_bloom_filters(spark, documents, monkeypatch):
    plans = []
    monkeypatch.setattr(ngram_join, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or common.checkpoint(df))
    kept = ngram_join.keep_one(documents)
    plans.append(kept._jdf.queryExecution().optimizedPlan().toString())
    assert not [p for p in plans if "might_contain" in p] and len(plans) > 10 and kept.count() < documents.count()


def test_long_texts_are_hashed_in_pieces(monkeypatch, rng):
    texts = [" ".join(rng.choice("abcdef") * rng.randint(1, 5) for _ in range(n)).encode() for n in (0, 3, 400, 50)] + [b"x" * 90 + b" y"]
    whole = shingles.shingle_sets(texts, 3)
    cut = anchors.runs([t * 3 for t in texts])
    monkeypatch.setattr(shingles, "PIECE", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, shingles.shingle_sets(texts, 3), strict=True))
    monkeypatch.setattr(anchors, "PIECE", 150)
    for text, k in ((t * 3, i) for i, t in enumerate(texts)):
        starts = lambda r, n=k: {s: (a, h) for i, f, l, a, h in zip(r.text, r.first, r.last, r.anchor, r.sure, strict=True) if i == n for s in range(f, l + 1)}  # noqa: E731, E741
        assert starts(anchors.runs([t * 3 for t in texts])) == starts(cut) and len(starts(cut)) == max(len(text) - anchors.LENGTH + 1, 0)


def test_equal_sets_have_equal_digests(rng):
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(400)]
    keys = list(zip(*map(np.ndarray.tolist, shingles.set_keys(shingles.shingle_sets([t.encode() for t in texts], 3))), strict=True))
    by_set = {}
    for text, key in zip(texts, keys, strict=True):
        by_set.setdefault(frozenset(plain_set(text, 3)), set()).add(key)
    assert all(len(v) == 1 for v in by_set.values()) and len(set.union(*by_set.values())) == len(by_set)


@pytest.mark.parametrize("few", [0, 200_000])
def test_components(spark, rng, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    links = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(300 + k, 301 + k) for k in range(40)] + [(900, 901 + k) for k in range(50)]
    found = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()))
    root = dict(zip(*components.forest([a for a, _ in links], [b for _, b in links]), strict=True))
    assert found == {v: root.get(v, v) for a, b in links for v in (a, b) if a != b}


def plain_embeddings(rows, least):
    def sound(v, g):
        return v and g is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, links = {}, []
    for i, (a, v, g) in enumerate(rows):
        n.setdefault(i, 0)
        for j, (b, w, h) in enumerate(rows[:i]):
            if a is not None and b is not None and sound(v, g) and sound(w, h) and g == h and len(v) == len(w):
                x, y = np.asarray(v, float), np.asarray(w, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links.append((a, b))
                    n[i] += 1
                    n[j] += 1
    root = dict(zip(*components.forest([a for a, _ in links], [b for _, b in links]), strict=True))
    return sorted(((a, n[i], root.get(a, a)) for i, (a, _, _) in enumerate(rows)), key=repr)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "INTERVAL", 7 * 8)
    monkeypatch.setattr(embedding_dedup, "LEAF", 2)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8))
    rows = [(k, (centres[k % 12] + rng.normal(size=8) * rng.choice([0.02, 0.1, 1])).astype(np.float32).tolist(), int(k % 3)) for k in range(150)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, rows[0][1], 1), (203, None, 0), (204, [0.0] * 8, 0), (205, [1.0, None], 0), (206, [float("nan")] * 8, 0), (207, rows[0][1], None), (208, [], 0), (209, [1.0, 2.0], 0), (210, [2.0, 4.0], 0), (None, rows[0][1], 0), (211, [1e30, 1e30], 0), (212, [1e-30, 1e-30], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = df.selectExpr("*", "'clash' AS n", "'clash' AS class", "1 AS cell", "'clash' AS component_id")
    found = embedding_dedup.near_duplicates(df).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=repr) == plain_embeddings(rows, 0.98)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found if r["vec_id"] is not None)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Some

    context = Some(getCheckpointDir=lambda: None, getConf=lambda: Some(get=lambda _: None), master="spark://cluster:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.checkpoint(Some(sparkSession=Some(sparkContext=context)))
