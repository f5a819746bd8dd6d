"""Toxicity and quality rules: gradients, held-out accuracy and brute-force counts; and the pipeline."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import quality_rules, toxicity
from tidemark.llm.queries import BYTE_RANKS, PIECES, op1_toxicity




def prose(rng, n, bad):
    words = ["".join(rng.choice(["ta", "ri", "mo", "len", "su", "qua"]) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    for _ in range(2 if bad else 0):
        words[rng.randrange(n)] = rng.choice(["grolk", "vrazz", "grolkish"])
    return " ".join(words)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(8)
    return [(prose(rng, rng.choice([20, 60, 150]), k % 2 == 0), int(k % 2 == 0)) for k in range(240)]


def test_gradients(monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_DOCUMENTS", 1)
    data = toxicity.examples(["aa bb cc dd ee", "bb ff gg"], [1, 0])
    trainer = toxicity.Trainer(data)
    rng = np.random.default_rng(0)
    trainer.model = trainer.model._replace(**{f: getattr(trainer.model, f).astype(np.float64) + rng.normal(0, 0.1, getattr(trainer.model, f).shape) for f in toxicity.Model._fields})
    cut = [trainer.cut(0, 0), trainer.cut(1, 0)]
    ids, mask, label, weight = np.stack([c[0] for c in cut]), np.stack([c[1] for c in cut]), np.array([1.0, 0.0]), np.array([2.0, 1.0])
    got = {}
    monkeypatch.setattr(trainer, "apply", lambda k, g, rate, at=slice(None): got.__setitem__(k, (g, at)))
    trainer.step(ids, mask, label, weight)
    gradients = {k: np.array(v[0]) for k, v in got.items()}
    for k in (2, 4, 5, 6, 7, 8, 9):
        array = trainer.model[k]
        for place in list(np.ndindex(array.shape))[:: max(1, array.size // 6)]:
            kept, e = array[place], 1e-3
            array[place] = kept + e
            up = trainer.step(ids, mask, label, weight)
            array[place] = kept - e
            down = trainer.step(ids, mask, label, weight)
            array[place] = kept
            assert gradients[k][place] == pytest.approx((up - down) / (2 * e), abs=2e-3)


def test_held_out_accuracy(labelled):
    model = toxicity.train([t for t, _ in labelled[:180]], [y for _, y in labelled[:180]])
    scores = toxicity.Scorer(model).scores([t for t, _ in labelled[180:]])
    assert np.mean((scores >= 0.5) == np.array([y for _, y in labelled[180:]])) > 0.9
    again = toxicity.train([t for t, _ in labelled[:180]], [y for _, y in labelled[:180]])
    assert all(np.array_equal(a, b) for a, b in zip(model, again, strict=True))


def test_a_score_is_that_of_the_highest_window(labelled):
    own = toxicity.Scorer(toxicity.train([t for t, _ in labelled[:120]], [y for _, y in labelled[:120]]))
    words = labelled[1][0].split() * 3 + ["grolk"] + labelled[3][0].split() * 3
    _, first = toxicity.windows(np.array([len(words)]))
    each = own.scores([" ".join(words[f : f + toxicity.WINDOW]) for f in first])
    assert own.scores([" ".join(words)])[0] == pytest.approx(each.max(), abs=1e-5)
    assert first[-1] == len(words) - toxicity.WINDOW and (np.diff(first) <= toxicity.STRIDE).all()


def test_no_part_of_a_long_run_is_left_out(labelled):
    own = toxicity.Scorer(toxicity.train([t for t, _ in labelled[:180]], [y for _, y in labelled[:180]]))
    clean = next(t for t, y in labelled if not y and len(t.split()) >= 60).split()[:60]
    for joint in (",", "/", "_"):
        mild, bad = own.scores([joint.join(clean), joint.join([*clean[:40], "grolk", "vrazz", *clean[40:]])])
        assert mild < 0.5 <= bad
    chinese, thai, unbroken = "".join(map(chr, range(0x4E00, 0x4E00 + 300))), "".join(chr(0x0E01 + k % 46) for k in range(300)), "".join(chr(97 + k * k % 26) for k in range(300))
    assert toxicity.words_of(chinese) == list(chinese) and toxicity.words_of(thai) == list(thai)
    for text in (chinese, thai, unbroken, "a" * 64, "a" * 65, "a" * 97, ",".join(clean), "-" * 200 + unbroken):
        words = toxicity.words_of(text)
        assert max(map(len, words)) <= toxicity.LONGEST
        assert all(any(text[k : k + 20] in w for w in words) for k in range(len(text) - 19)) if text in (unbroken, "a" * 97) else set(text) == set("".join(words))
    assert toxicity.words_of("One two-three 🙂 x_y") == "one two-three 🙂 x_y".split()
    a, b = own.model.vectors(["x" * 64 + "grolk"]), own.model.vectors(["x" * 64 + "plain"])
    assert not np.array_equal(a, b)


def test_a_very_long_text_is_scored_to_its_end(labelled):
    own = toxicity.Scorer(toxicity.train([t for t, _ in labelled[:180]], [y for _, y in labelled[:180]]))
    clean = next(t for t, y in labelled if not y and len(t.split()) >= 60 and own.scores([t])[0] < 0.3)
    long = " ".join([clean] * 3000)
    mild, bad, glued = own.scores([long, long + " grolk vrazz grolkish", long.replace(" ", ",") + ",grolk,vrazz,grolkish"])
    assert len(long) > 1_000_000 and mild < 0.5 <= min(bad, glued)


def test_training_looks_at_all_windows():
    rng = random.Random(3)
    texts, at = [], toxicity.TRAIN_WINDOWS * toxicity.STRIDE + 400
    for k in range(12):
        words = prose(rng, at + 200, False).split()
        words[at : at + 3] = ["grolk", "vrazz", "grolkish"] if k % 2 else words[at : at + 3]
        texts.append(" ".join(words))
    trainer = toxicity.Trainer(toxicity.examples(texts, [k % 2 for k in range(12)]))
    begin = toxicity.seeds(trainer)
    assert all(at - toxicity.WINDOW < begin[k] <= at + 2 for k in range(1, 12, 2))
    trainer.fit([(k, begin[k], k % 2) for k in range(12)], 30)
    assert all(at - toxicity.WINDOW < trainer.highest_windows()[k][0] <= at + 2 for k in range(1, 12, 2))


def test_odd_texts_have_scores(odd, nothing):
    found = toxicity.score(odd, toxicity.fresh(), "doc_id").collect()
    assert len(found) == 10 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert toxicity.score(nothing, toxicity.fresh(), "doc_id").count() == 0
    assert toxicity.train([], []).base[0] == toxicity.train(["a", "b"], [0, 0]).base[0]


def test_whole_table(spark, data):
    found = op1_toxicity(spark, data).toPandas()
    assert len(found) == spark.read.parquet(f"{data}/documents.parquet").count() and found.score.between(0, 1).all()


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    marked = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(marked)


def test_counts(texts, rng):
    made = ["", "a b c", "a b c a b c", "x\nx\n\n \n \nx", "a\x1cb a\x1cb c\xa0d\x85 e", *(" ".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(60))]
    every = made + list(texts.values())
    found = quality_rules.measure(every, PIECES)
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(found[c][k]) for c in columns) for k in range(len(every))] == [plain_counts(t) for t in every]


def test_fertility_of_plain_texts():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in ("the quick brown fox " * 3, "日本語 テキスト 😀", "один два три"):
        found = quality_rules.measure([text], PIECES)
        ids = [i for w in text.split() for i in model.encode(w)]
        share = np.array(list(Counter(ids).values())) / len(ids)
        assert found["n_tokens"][0] == len(ids) and found["token_entropy"][0] == pytest.approx(-(share * np.log2(share)).sum())
        assert found["fallback_share"][0] == pytest.approx(np.mean([model.is_byte(i) for i in ids]))


def test_bands_by_script():
    english = "The committee met on Tuesday to discuss the new budget, and several members raised questions about how the money would be spent over the next year. " * 1
    english += "Others argued that schools and roads should come first, since both had waited for repairs while costs kept rising every single month of that long winter season."
    russian = "Вчера вечером мы долго гуляли по набережной и говорили о том, как изменился город за последние годы, сколько построили новых домов и открыли кафе, музеев и библиотек. " + "Потом пошёл снег, и нам пришлось вернуться домой пешком через старый парк, где уже горели фонари, играла тихая музыка, а дети катались на коньках вместе с родителями и друзьями до ночи. Утром всё вокруг стало белым и чистым."
    noise = " ".join(chr(0x10A00 + k % 90) * 3 for k in range(80))
    found = quality_rules.verdicts([english, russian, noise, "word " * 80, ""], PIECES, quality_rules.BANDS)
    assert found["script"][:2] == ["latin", "cyrillic"] and found["kept"].tolist()[:2] == [True, True] and not found["kept"][3] and not found["kept"][4]
    tight = {k: quality_rules.Band(100, 101, 0, 0) for k in quality_rules.BANDS}
    assert not quality_rules.verdicts([english], PIECES, tight)["kept"][0]


def test_floors_reject_junk_of_a_language(spark):
    rng = random.Random(4)
    common = ["time", "people", "house", "water", "school", "garden", "music", "winter", "market", "letter", "road", "city", "story", "friend", "morning", "window", "river", "teacher", "question", "country"]
    plain = lambda: " ".join(rng.choice(common) + rng.choice(["", "", "s", ","]) for _ in range(100))
    junk = lambda: " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) + " |" for _ in range(100))
    rows = [(k, plain() if k % 10 else junk(), "en") for k in range(100)] + [(k, junk(), "xx") for k in range(100, 110)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in quality_rules.judge(docs, PIECES, "doc_id", second=BYTE_RANKS, language="lang").collect()}
    assert len(found) == 110 and not any(r["base_failed"] for r in found.values())
    assert not any(found[k]["kept"] for k in range(0, 100, 10)) and sum(found[k]["kept"] for k in range(100) if k % 10) >= 88
    assert all(found[k]["kept"] for k in range(100, 110))  # too few texts for floors: the bands alone
    left = quality_rules.without_rejected(docs, PIECES, second=BYTE_RANKS, language="lang")
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(k for k, r in found.items() if r["kept"])


def test_judge_takes_odd_rows(odd, nothing):
    found = quality_rules.judge(odd, PIECES, "doc_id").collect()
    assert len(found) == 10 and not any(r["kept"] for r in found) and quality_rules.judge(nothing, PIECES, "doc_id").count() == 0


def test_pipeline(spark, data):
    docs = before = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, data)
        assert after.columns == docs.columns and 0 < after.count() <= before.count(), name
        before = spark.createDataFrame(after.toPandas(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, data)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_and_empty_tables(spark, data, k):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b", None, "s", 3), (3, "word " * 100, "en", None, 500)]
    stage = corpus_pipeline.STAGES[k][1]
    assert stage(spark, spark.createDataFrame(rows, schema), data).count() <= 5
    assert stage(spark, spark.createDataFrame([], schema), data).count() == 0
