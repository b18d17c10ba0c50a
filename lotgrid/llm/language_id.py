"""Language identification by prediction by partial matching over bytes.

For every language a context tree of byte counts up to order ``MAX_ORDER`` is learnt from a
bounded sample of labelled documents and then frozen.  A byte is coded in its longest known
context; where the context has not seen it, the escape probability of that context is paid
and the next shorter context tries.  A text goes to the language with the shortest code.

The trees of all languages are kept as one table of byte strings per order with one code
length per language, so a byte is looked up once for all languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotgrid.llm.common import map_texts

# Production parameters.
TRAIN_DOCS = 800  # labelled documents per language, whole texts, the only bounded sample here
MAX_ORDER = 3
FOLDS, HELD_FOLD = 4, 2
UNKNOWN = "und"
SHARES = 64  # parts in which the training documents of a language are ranked first
CHUNK = 1 << 20  # bytes scored at once

START = b"\n" * MAX_ORDER  # context before the first byte
LETTER = regex.compile(r"\p{L}")  # categories L*: neither digits nor numbers such as one half or Roman eight


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds))


def _encode(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """Big-endian integers of all ``n``-byte strings, by last byte; ``data`` starts with the context."""
    size = len(data) - n + 1
    out = np.zeros(max(0, size), "i8")
    for k in range(n):
        out = (out << 8) | data[k : k + size]
    return out


def count_contexts(train: DataFrame) -> DataFrame:
    """``lang, n, gram, count``: all byte strings of up to ``MAX_ORDER + 1`` bytes of ``train(lang, text)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                data = [np.frombuffer(START + _encode(t), "u1") for t in texts if t]
                for n in range(1, MAX_ORDER + 2):
                    own = [_grams(d[MAX_ORDER + 1 - n :], n) for d in data]
                    if own:
                        gram, count = np.unique(np.concatenate(own), return_counts=True)
                        yield pd.DataFrame({"lang": lang, "n": n, "gram": gram, "count": count})

    counts = train.select("lang", "text").mapInPandas(run, "lang string, n int, gram long, count long")
    return counts.groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))


class Model:
    """Frozen code lengths.  ``tables[n]`` holds the sorted strings of ``n`` bytes and, per language, the bits of the last one."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.escapes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        width = len(self.langs)
        shorter, bits_below = np.zeros(0, "i8"), np.full((0, width), 8.0)
        for n in range(1, MAX_ORDER + 2):
            own = counts[counts["n"] == n]
            grams = np.unique(own["gram"].to_numpy("i8"))
            contexts = np.unique(grams >> 8)
            seen, total, kinds = np.zeros((len(grams), width)), np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            for k, lang in enumerate(self.langs):
                mine = own[own["lang"] == lang]
                g, c = mine["gram"].to_numpy("i8"), mine["count"].to_numpy("f8")
                seen[np.searchsorted(grams, g), k] = c
                at = np.searchsorted(contexts, g >> 8)
                total[:, k] = np.bincount(at, c, len(contexts))
                kinds[:, k] = np.bincount(at, minlength=len(contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                context = np.searchsorted(contexts, grams >> 8)
                known = -np.log2(seen / (total + kinds)[context])
            if n == 1:
                below = np.full((len(grams), width), 8.0)
            else:
                below = bits_below[np.searchsorted(shorter, grams & ((1 << (8 * (n - 1))) - 1))]
            bits = np.where(seen > 0, known, escape[context] + below)
            self.tables[n], self.escapes[n] = (grams, bits.astype("f4")), (contexts, escape.astype("f4"))
            shorter, bits_below = grams, bits

    def _index(self) -> None:
        """Direct tables: context to its number, number and byte to the row of bits."""
        self.number, self.row = {}, {}
        for n, (grams, _) in self.tables.items():
            contexts = self.escapes[n][0]
            number = np.full(1 << (8 * (n - 1)), -1, "i4")
            number[contexts] = np.arange(len(contexts), dtype="i4")
            row = np.full(len(contexts) * 256, -1, "i4")
            row[number[grams >> 8].astype("i8") * 256 + (grams & 255)] = np.arange(len(grams), dtype="i4")
            self.number[n], self.row[n] = number, row

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte after the first ``MAX_ORDER``, per language."""
        if not hasattr(self, "row"):
            self._index()
        grams = _grams(data, MAX_ORDER + 1)
        out = np.zeros((len(grams), len(self.langs)), "f4")
        left = np.arange(len(grams))
        for n in range(MAX_ORDER + 1, 0, -1):
            own = grams[left] & ((1 << (8 * n)) - 1)
            number = self.number[n][own >> 8].astype("i8")
            row = np.where(number >= 0, self.row[n][np.maximum(number, 0) * 256 + (own & 255)], -1) if len(self.row[n]) else np.full(len(own), -1)
            hit = row >= 0
            out[left[hit]] += self.tables[n][1][row[hit]]
            miss = ~hit
            known = miss & (number >= 0)
            out[left[known]] += self.escapes[n][1][number[known]]
            left = left[miss]
        out[left] += 8.0
        return out

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of every text under every language."""
        total = np.zeros((len(texts), len(self.langs)))
        encoded = [_encode(t) for t in texts]
        at = 0
        while at < len(encoded):
            last, size = at, 0
            while last < len(encoded) and (size == 0 or size + len(encoded[last]) <= CHUNK):
                size += len(encoded[last])
                last += 1
            part = encoded[at:last]
            if size > CHUNK:  # one very long text
                data = START + part[0]
                for k in range(0, size, CHUNK):
                    total[at] += self.bits(np.frombuffer(data[k : k + CHUNK + MAX_ORDER], "u1")).sum(axis=0, dtype="f8")
            elif size:
                bits = self.bits(np.frombuffer(START + START.join(part), "u1"))
                doc = np.repeat(np.arange(at, last), [len(p) + MAX_ORDER for p in part])[: len(bits)]
                begin = np.cumsum([0] + [len(p) + MAX_ORDER for p in part[:-1]])
                text = np.ones(len(bits), bool)
                for k, p in zip(begin, part, strict=True):
                    text[k + len(p) : k + len(p) + MAX_ORDER] = False
                for k in range(len(self.langs)):
                    total[:, k] += np.bincount(doc[text], bits[text, k], len(texts))
            at = last
        return total


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, folds: int = FOLDS, held_fold: int = HELD_FOLD) -> Model:
    """Learn from ``docs(doc_id, text, lang)`` outside the held fold.

    At most ``train_docs`` documents per language, those with the smallest text hash, are
    read; equal texts count once.  Rows with a null id, text or lang teach nothing.
    """
    usable = docs.where((fold_of("doc_id", folds) != held_fold) & F.col("lang").isNotNull() & (F.col("text") != "")).select("lang", "text", "doc_id")
    share = F.pmod("key", F.lit(SHARES))
    in_share, order = Window.partitionBy("lang", "share").orderBy("key"), Window.partitionBy("lang").orderBy("key")
    # Only hashes and ids are ranked; the chosen texts are fetched by id.
    chosen = (
        usable.groupBy("lang", F.xxhash64("text").alias("key"))
        .agg(F.min("doc_id").alias("doc_id"))
        # First the smallest of every share of a language, then the smallest of those: no task has a whole language.
        .withColumn("share", share)
        .withColumn("rank", F.row_number().over(in_share))
        .where(F.col("rank") <= train_docs)
        .drop("share")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= train_docs)
        .drop("rank")
    )
    sample = usable.withColumn("key", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "key", "doc_id"], "left_semi").dropDuplicates(["lang", "key"])
    return Model(count_contexts(sample).toPandas())


def predict(docs: DataFrame, model: Model, folds: int = FOLDS, held_fold: int = HELD_FOLD) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs(doc_id, text)``.

    The score is the posterior of the best language under equal priors; equal code lengths
    go to the first name.  Texts of any length are read whole, a megabyte at a time, and
    repeated rows are predicted each.  A null text, one without a letter, and any text when nothing was
    learnt are ``und`` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(sources: list[str | None]) -> tuple[None, dict[str, list]]:
        model = shared.value
        texts = [t or "" for t in sources]
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        live = [k for k, t in enumerate(texts) if LETTER.search(t)] if model.langs else []
        bits = model.code_lengths([texts[k] for k in live])
        for k, b in zip(live, bits, strict=True):
            best = int(np.argmin(b))
            lang[k], score[k] = model.langs[best], float(1.0 / np.exp2(b[best] - b).sum())
        return None, {"lang_pred": lang, "score": score}

    held = F.coalesce(fold_of("doc_id", folds) == held_fold, F.lit(False))
    made = {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64())}
    return map_texts(docs.select("doc_id", held.alias("held_out"), "text"), ["doc_id", "held_out"], "text", made, run, at_once=1024)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))
