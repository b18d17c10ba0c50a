"""Interpolated scores against a plain model with the same weights, and weights against a search."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotgrid.llm import interpolated_lm as lm


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + ["</end>"]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def plain(rows, weights, order):
    grams = [Counter() for _ in range(order)]
    train = [words(t) for k, t in rows if not held(k)]
    for w in train:
        full = ["</end>"] * (order - 1) + w
        for i in range(order - 1, len(full)):
            for n in range(order):
                grams[n][tuple(full[i - n : i + 1])] += 1
    total, kinds = sum(grams[0].values()), len(grams[0])
    out = []
    for k, t in rows:
        w = words(t)
        full = ["</end>"] * (order - 1) + w
        base = score = 0.0
        for i in range(order - 1, len(full)):
            p = 1.0 / (kinds + 1)
            for n in range(order):
                context = total if n == 0 else len(train) if i == order - 1 else grams[n - 1][tuple(full[i - n : i])]
                if context:
                    v = weights[n][int(math.floor(2 * math.log2(context))) + 1]
                    p = v * grams[n][tuple(full[i - n : i + 1])] / context + (1 - v) * p
            score += math.log10(p)
            base += math.log10((grams[0][(full[i],)] + 1) / (total + kinds + 1))
        out.append((k, held(k), len(w), sum(grams[0][(x,)] > 0 for x in w), total, base, score))
    return out


def close(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a[:5]) == tuple(b[:5])
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9, abs=1e-9)


def corpus(n=120, seed=3):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(n):
        at, text = rnd.randrange(40), []
        for _ in range(rnd.randrange(1, 40)):
            at = (at + rnd.choice([1, 1, 1, 2, 7])) % 40 if rnd.random() < 0.9 else rnd.randrange(40)
            text.append(vocabulary[at].upper() if rnd.random() < 0.2 else vocabulary[at])
        rows.append((k, rnd.choice([" ", "\n", " \t"]).join(text)))
    return [*rows, (500, None), (501, ""), (None, "w1 w2 w3"), (3, rows[3][1]), (3, rows[3][1]), (502, "never seen words"), (503, "é w1 é")]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_same_as_plain_model_with_the_same_weights(spark, monkeypatch, order):
    rows, seen = corpus(), []
    learnt = lm._learnt
    monkeypatch.setattr(lm, "_learnt", lambda *a: seen.append(learnt(*a)) or seen[-1])
    monkeypatch.setattr(lm, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 2000)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("role", F.lit("x")).repartition(3)
    got = [tuple(r) for r in lm.score_texts(df, order=order).collect()]
    close(got, plain(rows, seen[0], order))


def test_longer_orders_say_more_about_held_out_texts(spark):
    df = spark.createDataFrame(corpus(400), "doc_id long, text string")
    total = [lm.score_texts(df, order=n).where("held_out").agg(F.sum("score")).first()[0] for n in (1, 2)]
    base = lm.score_texts(df, order=1).where("held_out").agg(F.sum("base_score")).first()[0]
    assert total[1] > total[0] + 0.05 * abs(total[0])
    assert total[0] > base - 0.02 * abs(base)


def test_weights_are_the_most_likely_ones():
    rnd = random.Random(1)
    own = {rnd.randrange(-400, 700): rnd.randrange(1, 50) for _ in range(60)} | {None: 700}
    w = lm.fit_weights({4: own}, steps=2000)
    ratio = np.array([0.0 if k is None else 2.0 ** (k / lm.RATIO_STEPS) for k in own])
    number = np.array(list(own.values()), "f8")
    grid = np.linspace(0.001, 0.999, 999)
    best = grid[np.argmax([(number * np.log(v * ratio + 1 - v)).sum() for v in grid])]
    assert w[4] == pytest.approx(best, abs=2e-3)
    assert w[0] == 0 and w[7] == w[4] and w[3] == 0.5


def test_nothing_learnt_and_nothing_to_score(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_texts(none).collect() == []
    out = [k for k in range(60) if held(k)][:2]
    rows = lm.score_texts(spark.createDataFrame([(out[0], "a b"), (out[1], None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(out[0], True, 3, 0, 0, 0.0, 0.0), (out[1], True, 1, 0, 0, 0.0, 0.0)]
