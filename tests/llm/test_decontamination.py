"""Leaks against all windows, fingerprint blocks, and awkward rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lotgrid.llm.decontamination import drop_leaking, find_leaks, simhash

BENCH = "item_id long, text string, size int"
DOCS = "doc_id long, text string, key string"


def word_list(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w):
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(docs, items):
    out = {}
    for d, text in docs:
        w = word_list(text)
        for i, item in items:
            v = word_list(item)
            if not w or not v:
                continue
            b, n = shingles(v), min(len(v), len(w))
            for at in range(len(w) - n + 1):
                a = shingles(w[at : at + n])
                s = sum((a & b).values()) / sum((a | b).values())
                if s >= 0.75 and s > out.get((d, i), (0, 0, 0))[2]:
                    out[(d, i)] = (at, n, s)
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 15, 36, 60])))) for k in range(8)]
    items += [(8, " ".join([word()] * 20)), (9, "same same other same same other " * 4)]
    docs = []
    for k in range(40):
        w = [word() for _ in range(rng.randint(0, 150))]
        if k % 2:
            p = items[k % 10][1].split()
            if k % 3 == 0:
                p[len(p) // 2] = word()
            if k % 5 == 0:
                p.insert(len(p) // 3, word())
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() if k % 7 == 0 else x for x in p]
        docs.append((k, ("\n" if k % 4 == 0 else ", ").join(w)))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_windows(spark, seed):
    docs, items = corpus(seed)
    got = find_leaks(spark.createDataFrame([(*d, "c") for d in docs], DOCS), spark.createDataFrame([(*i, 1) for i in items], BENCH)).collect()
    assert {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.similarity) for r in got} == brute(docs, items)


def test_simhash_votes(spark):
    row = spark.createDataFrame([(["a", "b", "c", "a"],)], "words array<string>").select(simhash("words").alias("s"), F.transform("words", lambda w: F.xxhash64(w)).alias("h")).first()
    want = sum(1 << b for b in range(64) if sum(1 if h >> b & 1 else -1 for h in row.h) > 0)
    assert row.s & (2**64 - 1) == want


def test_awkward_rows(spark):
    text = "one two three four five six seven eight nine ten"
    docs = [(None, "x " + text, "c"), (1, None, "c"), (2, "", "c"), (3, text, "c"), (3, text, "c"), (3, "clean words only", "c"), (4, "w " * 30_000 + text, None)]
    df = spark.createDataFrame(docs, DOCS)
    bench = spark.createDataFrame([(1, text, 1), (1, text, 1), (None, text, 1), (2, None, 1), (3, "", 1)], BENCH)
    got = sorted(str((r.doc_id, r.item_id, r.first_word)) for r in find_leaks(df, bench).collect())
    assert got == sorted(str((d, i, f)) for d, f in ((None, 1), (3, 0), (4, 30_000)) for i in (1, None))
    kept = drop_leaking(df, bench)
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(map(str, df.where("text IS NULL OR text IN ('', 'clean words only')").collect()))
    assert find_leaks(df.limit(0), bench).collect() == [] and find_leaks(df, bench.limit(0)).collect() == []
    assert drop_leaking(df, bench.limit(0)).count() == len(docs)
    with pytest.raises(ValueError):
        find_leaks(df, bench, min_similarity=0.5)


def test_changed_heads_and_tails(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 8)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([20, 50, 60, 75, 100] * 12)]
    docs = []
    for k, text in items:
        w = text.split()
        cut = (len(w) - 4) // 7  # similarity 0.75 to 0.78
        new = [word() for _ in range(cut)]
        docs.append((k, " ".join([word() for _ in range(9)] + (new + w[cut:] if k % 2 else w[:-cut] + new) + [word() for _ in range(9)])))
    got = find_leaks(spark.createDataFrame([(*d, "c") for d in docs], DOCS), spark.createDataFrame([(*i, 1) for i in items], BENCH)).collect()
    want = {(k, k): brute([docs[k]], [items[k]]).get((k, k)) for k, _ in items}
    assert all(want.values())
    assert {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.similarity) for r in got} == want


def test_documents_shorter_than_the_item(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 8)))
    items = [(k, " ".join(word() for _ in range(8 + k % 20))) for k in range(60)]
    docs = []
    for k, text in items:
        w = text.split()
        cut = (len(w) - 4) // 4
        docs.append((k, " ".join(w[cut:] if k % 2 else w[:-cut])))
    got = find_leaks(spark.createDataFrame([(*d, "c") for d in docs], DOCS), spark.createDataFrame([(*i, 1) for i in items], BENCH)).collect()
    want = brute(docs, items)
    assert len(want) == 60
    assert {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.similarity) for r in got} == want


def shuffled_bytes(spark):
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_without_an_anchor_are_not_shuffled(spark):
    """Only documents that may leak are moved, however small the tables are that Spark broadcasts by itself."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"{rng.getrandbits(40):x}" for _ in range(n))
    passage = text(30)
    docs = [(k, text(300) + (" " + passage if k % 100 == 0 else "")) for k in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        start = shuffled_bytes(spark)
        assert {r.doc_id for r in find_leaks(frame, items).collect()} == {0, 100, 200, 300}
        assert drop_leaking(frame, items).count() == 396
        moved = shuffled_bytes(spark) - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved < 0.3 * sum(len(t) for _, t in docs)
