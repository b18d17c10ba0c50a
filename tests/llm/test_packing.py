"""Packing: every piece once, gapless, near the fewest sequences; ids as the tokenizer gives them."""

import random
import zlib

import numpy as np
import pytest

from lotgrid.llm.common import tokenizer_path
from lotgrid.llm.packing import WordIds, best_fit, improve, pack, pack_documents

ODD = ["", "  ", "a\x1cb c\x1d d", "İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ", "é ́x  y z\x85q", "<|endoftext|> a<|startoftext|>b", "it's we'll ​zero", "한국어 テスト 漢字 🙂", "\x00nul \x0b\x0cff", " lead trail "]


def test_ids_equal_the_tokenizer():
    pytest.importorskip("tokenizers")
    words = WordIds(tokenizer_path())
    texts = ODD + [" ".join(ODD)] + ["Plain words, twice. plain words, twice!! IT'S, x., .. X.. é. É, <|ENDOFTEXT|>, <|endoftext|>. ab<|ENDOFTEXT|>A."]
    for _ in range(2):
        for text, ids in zip(texts, words.encode(texts), strict=True):
            assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(30))
def test_local_search(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 100) if seed % 2 else rng.randint(25, 70) for _ in range(rng.randint(0, 80))]
    first = best_fit(lengths, 100)
    better = improve(first, lengths, 100)
    for bins in (first, better):
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(0 < sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(better) <= len(first)


def test_swaps_empty_a_bin():
    lengths = [6, 6, 5, 5, 4, 4]  # best fit pairs 6+4, 6+4 and 5+5; spoilt by hand
    bins = improve([[0, 2 + 2], [1], [2], [3, 5]], lengths, 10)
    assert len(bins) == 3


def test_pack(spark):
    rng = random.Random(5)
    rows = [(k, 0, rng.choice([2048, rng.randint(1, 700)])) for k in range(3000)]
    got = pack(spark.createDataFrame(rows, "doc_id long, piece int, length long"), group_bins=128).toPandas()
    assert sorted(got["doc_id"]) == list(range(3000))
    used = 0
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        ends = np.cumsum(part["length"])
        assert ends.iloc[-1] <= 2048 and (part["offset"] == ends - part["length"]).all()
        used += 1
    assert used <= 1.02 * got["length"].sum() / 2048 + 1


def test_documents(spark):
    pytest.importorskip("tokenizers")
    texts = {1: "Some words here.", 2: None, 3: "", 4: "long " * 5000, None: "no id"}
    rows = [(k, t, 0) for k, t in texts.items()] + [(1, texts[1], 0)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length long"), tokenizer_path()).toPandas()
    words = WordIds(tokenizer_path())
    for (doc, text), times in zip(texts.items(), (2, 1, 1, 1, 1), strict=True):
        ids = np.append(words.encode([text or ""])[0], 0).astype("<u4")
        own = got[got["doc_id"].isna() if doc is None else got["doc_id"] == doc].sort_values("piece")
        want = [(p, p * 2048, len(part), zlib.crc32(part.tobytes())) for p, part in enumerate(np.split(ids, range(2048, len(ids), 2048)))]
        assert sorted(own[["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want * times)
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).collect() == []


def test_remembered_words_are_small():
    pytest.importorskip("tokenizers")
    import tracemalloc

    words = WordIds(tokenizer_path())
    words.encode(["one"])
    tracemalloc.start()
    try:
        for k in range(20):
            words.encode([" ".join(f"w{n}" for n in range(k * 5000, (k + 1) * 5000))])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 80 * 100_000
