"""Collocations against a plain count, over many shards and prefix ranges; the automaton by itself."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lotgrid.llm import collocations as co


def pieces(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\x0a-\x0d]", lower)]


def plain(rows, least, top, inside=50):
    f, n, out = {}, Counter(), []
    for text, lang in rows:
        own = f.setdefault(lang or "und", Counter())
        for p in pieces(text):
            n[lang or "und"] += len(p)
            for size in (1, 2, 3):
                own.update(tuple(p[i : i + size]) for i in range(len(p) - size + 1))
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= inside * a for q, b in cand.items()):
                continue
            score, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus(seed=1, n=160):
    rnd = random.Random(seed)
    vocabulary = ["the", "then", "theory", "of", "offer", "a", "é", "ñandú", "日本", "zz", "x" * 30, "x" * 30 + "y"]
    fixed = ["the theory of", "a ñandú offer", "日本 zz é", "X" * 30 + " of a"]
    rows = []
    for k in range(n):
        text = "".join(
            (rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice(vocabulary)) + rnd.choice([" ", " ", " ", "\t ", ". ", "\n", ", ", "!"]) for _ in range(rnd.randrange(40))
        )
        rows.append((text, rnd.choice(["en", "en", "en", "de", None, "und"])))
    return [*rows, (None, "en"), ("", "fr"), ("... ,,", None), ("one two three", "it")] + [("same words again, same words again", "es")] * 12


@pytest.mark.parametrize("shard", [400, 1 << 24])
@pytest.mark.parametrize("tokens", [300, 1 << 20])
def test_same_as_plain_count(spark, monkeypatch, shard, tokens):
    monkeypatch.setattr(co, "SHARD_BYTES", shard)
    monkeypatch.setattr(co, "MARK_EVERY", 3)
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "text string, lang string, phrase string").repartition(3)
    got = co.collocations(df, least=5, top=30, range_tokens=tokens)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 5, 30)


def test_no_rows(spark):
    assert co.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert co.collocations(spark.createDataFrame([("a b", None)], "text string, lang string")).collect() == []


def phrases(text):
    p = co.split_pieces([text])
    return co.count_phrases(p.hashes, p.goes_on, {h: p.word(k) for k, h in enumerate(p.hashes.tolist())})


def spelled(p):
    names = p.words.cast(pa.string()).to_pylist()
    out = {(names[w],): f for w, f in zip(p.one, p.f1.tolist()) if f}
    two = [(names[p.one[a]], names[b]) for a, b in zip(*p.two)]
    out |= dict(zip(two, p.f2.tolist()))
    return out | {(*two[a], names[b]): f for a, b, f in zip(*p.three, p.f3.tolist())}


def test_automaton_shares_states_and_keeps_weights():
    text = "a b c d. a b c d. x b c d. y q c. z q c"
    p = phrases(text)
    t = co.Transducer.build(p)
    assert spelled(t.unfold()) == spelled(p)
    # y and z continue alike, so they lead to one state.
    names = p.words.to_pylist()
    target = dict(zip(names, t.layers[0][3].tolist()))
    assert target[b"y"] == target[b"z"] and target[b"a"] != target[b"x"]
    again = co.Transducer.opened({k: v for k, v in t.packed().items()})
    assert spelled(again.unfold()) == spelled(p)


def test_union_of_cut_shards_is_the_count_of_all():
    rnd = random.Random(4)
    words = ["aa", "ab", "abcdefgh", "abcdefgi", "b", "é"]
    shards = [" ".join(rnd.choice(words) if rnd.random() < 0.9 else "." for _ in range(300)) for _ in range(4)]
    limits = np.unique(co.prefix_code(*[np.array([int.from_bytes(w.ljust(n, b"\0")[:n], "big") for w in ws], "u8") for n, ws in ((5, [b"ab", b"abcde", b"b"]), (3, [b"", b"b", b"aa"]))]))
    by_range = {}
    for s in shards:
        for r, own in co.cut(phrases(s), limits):
            by_range.setdefault(r, []).append(co.Transducer.build(own))
    got = {}
    for parts in by_range.values():
        for k, v in spelled(co.Transducer.union(parts)).items():
            got[k] = got.get(k, 0) + v
    want = spelled(phrases(" . ".join(shards)))
    assert got == want and len(by_range) > 2
    t = co.Transducer.build(phrases(" . ".join(shards)))
    asked = [*want, ("aa", "none"), ("none",), ("é", "é", "none")]
    assert t.compose([[w.encode() for w in p] for p in asked]).tolist() == [*want.values(), 0, 0, 0]
