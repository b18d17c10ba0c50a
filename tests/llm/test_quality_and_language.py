"""Held-out accuracy of the two learnt operators, and awkward rows."""

import random
import zlib

import numpy as np
import pandas as pd

from lotgrid.llm import language_id, quality

SYLLABLES = {"aa": "the ing er on an re".split(), "bb": "ción os la de ñ es".split(), "cc": "über sch ein ch ß ge".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


def test_language(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, lang := rng.choice(sorted(SYLLABLES)), rng.randint(5, 60)), lang, "x") for k in range(400)]
    rows += [(1000, None, "aa", "x"), (1001, "", "aa", "x"), (1002, "12 34 !!", "bb", "x"), (1003, "no label", None, "x"), (None, prose(rng, "aa", 20), "aa", "x"), (1004, prose(rng, "bb", 20) * 20_000, None, "x")]
    rows += [rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language_id.identify(df).collect()
    assert len(got) == len(rows)
    held = {r["doc_id"]: r for r in got if r["held_out"]}
    assert set(held) == {k for k, *_ in rows if k is not None and zlib.crc32(str(k).encode()) % 4 == 2}
    truth = {k: lang for k, _, lang, _ in rows[:400]}
    assert all(held[k]["lang_pred"] == truth[k] for k in held if k in truth)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 for k in (1000, 1001, 1002))
    assert by_id[1004]["lang_pred"] == "bb" and all(0 <= r["score"] <= 1 for r in got)


def test_language_code_lengths():
    """A tiny tree by hand: order 0 and 1 after the text 'abab'."""
    texts = {"x": "abab"}
    rows = []
    for lang, text in texts.items():
        data = np.frombuffer(language_id.START + text.encode(), "u1")
        for n in range(1, language_id.MAX_ORDER + 2):
            grams, counts = np.unique(language_id._grams(data[language_id.MAX_ORDER + 1 - n :], n), return_counts=True)
            rows += [(lang, n, g, c) for g, c in zip(grams, counts, strict=True)]
    model = language_id.Model(pd.DataFrame(rows, columns=["lang", "n", "gram", "count"]))
    # 'a' after the start: seen once of one in the order-3 context, escape share 1/2
    assert np.isclose(model.code_lengths(["a"])[0, 0], 1.0)
    # 'z' escapes from every known context (each has one kind once or twice), then costs 8 bits
    orders = [1 / 2, 1 / 2, 1 / 2, 2 / 6]
    assert np.isclose(model.code_lengths(["z"])[0, 0], 8 - sum(np.log2(orders)))
    parts = ["ab", "", "ba zz", "abab" * 3]
    assert np.allclose(model.code_lengths(parts), np.concatenate([model.code_lengths([p]) for p in parts]))


def test_language_nothing_learnt(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language_id.identify(df).select("lang_pred", "score").collect()] == [("und", 0.0)]
    assert language_id.identify(df.limit(0)).collect() == []


def corpus(rng):
    rows, labels = [], []
    for k in range(500):
        text, good = prose(rng, "aa", rng.randint(20, 120)), k % 3 > 0
        if not good:
            text = [text.upper().replace(" ", "!! "), " ".join(w + " " + w for w in [text.split()[0]] * 40), text.replace(" ", "### ")][k // 3 % 3]
        rows.append((k, text, "s"))
        labels.append((k, int(good)))
    return rows, labels


def test_quality(spark):
    rows, labels = corpus(random.Random(2))
    odd = [(9000, None, "s"), (9001, "", "s"), (None, "a text without an id", "s"), (9002, rows[1][1] * 3000, "s"), rows[5]]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, predicted string")
    model = quality.train(docs, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, quality int"))
    got = quality.score_documents(docs, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["predicted"])


def test_preferences_by_hand(spark):
    """The differences of a plain version: partners at even steps through the other label's list, every other one turned round."""
    rng = np.random.default_rng(3)
    rows = [(int(q), int(key), x.tolist()) for q, key, x in zip([1] * 7 + [0] * 5, rng.permutation(12) - 6, rng.random((12, len(quality.FEATURES))), strict=True)]
    sample = spark.createDataFrame(rows, "quality int, key long, features array<double>")
    mean, spread, sizes = quality.scales(sample)
    x = np.array([f for *_, f in rows])
    assert sizes == (5, 7) and np.allclose(mean, x.mean(axis=0)) and np.allclose(spread, x.std(axis=0))
    good, bad = (np.array([f for q, _, f in sorted(rows) if q == label]) / x.std(axis=0) for label in (1, 0))
    want = []
    for own, other, side in ((good, bad, 1), (bad, good, -1)):
        for turn in range(len(own) * quality.PARTNERS):
            gap = side * (own[turn // quality.PARTNERS] - other[turn * 7919 % len(other)])
            want.append((1.0, *gap) if turn % 2 == 0 else (0.0, *-gap))
    got = [(r["label"], *r["gap"]) for r in quality.preferences(sample, spread, sizes).collect()]
    assert np.allclose(sorted(got), sorted(want))
    flat = spark.createDataFrame([(q, k, [2.0] * len(quality.FEATURES)) for q, k, _ in rows], "quality int, key long, features array<double>")
    assert (quality.scales(flat)[1] == 1).all()


def test_training_rows_stay_off_the_driver(spark, monkeypatch):
    """Neither the sample nor its pairs pass through the driver."""
    rows, labels = corpus(random.Random(4))
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int")
    passed = []

    def counted(kind, name, size):
        plain = getattr(kind, name)

        def run(self, *args, **named):
            out = plain(self, *args, **named)
            passed.append(size(out, *args))
            return out

        monkeypatch.setattr(kind, name, run)

    for name in ("collect", "toPandas"):
        counted(type(docs), name, lambda out, *_: len(out))
    counted(type(spark), "createDataFrame", lambda _, data, *__: len(data))
    assert quality.train(docs, marked) is not None
    assert passed and max(passed) < 20


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert model is None and [r["score"] for r in quality.score_documents(docs, model).collect()] == [0.5]
    assert quality.score_documents(docs.limit(0), None).collect() == []


def test_features_have_no_holes():
    x = quality.text_features([None, "", " \n ", "!!!", "a", "A B C D E", "x " * 100_000, "é" * 10])
    assert np.isfinite(x).all() and not x[:3].any()
