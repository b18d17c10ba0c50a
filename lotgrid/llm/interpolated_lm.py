"""Language-model scores by deleted interpolation.

A word's probability mixes maximum-likelihood estimates of growing order:
``p_k = w(b) * count(k-gram) / count(context) + (1 - w(b)) * p_{k-1}``, down to the uniform
``1 / (V + 1)``.  The weight depends on the order and on the bucket ``b`` of the context's
frequency.  Weights are learnt by expectation-maximisation on counts of a part of the
training documents that is deleted from the counts for this purpose.

Counts never pass the driver and are broadcast nowhere.  Texts are tokenised into stored
blocks of word numbers.  Every block asks once for each of its distinct n-grams: the
requests are dealt by n-gram into buckets, summed there over all blocks, and the answers go
back to the blocks, packed as bytes both ways.  The number of buckets grows with the text.

The end of a document is a token; it is also the context in which a document starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotgrid.llm.common import byte_lengths, dropped, fresh, pack_integers, released, small_integers, stored, text_parts, trimmed, unpack_integers
from lotgrid.llm.language_id import fold_of
from lotgrid.llm.wordhash import mix, split_words

# Production parameters.
ORDER = 2
FOLDS, HELD_FOLD = 7, 2
DELETED = 10  # one of so many text hashes is deleted from the counts that weights are learnt on
BLOCK_BYTES = 8 << 20  # text of a block; a longer document is a block alone
BUCKET_BYTES = 8 << 20  # text for which there is one bucket of requests
STEPS = 40  # of expectation-maximisation at most
RATIO_STEPS = 64  # ratios of two estimates are told apart to this part of a doubling

END = np.uint64(0x6A09E667F3BCC909)
_FACTOR = np.uint64(0x9FB21C651E98DF25)
LEFT_OUT, KEPT, PART = 0, 1, 2  # of a document: held out, counted, deleted part


def hash_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends included, and the number of tokens per text."""
    words = split_words(texts)
    sizes = np.diff(words.bounds) + 1
    hashes = np.full(int(sizes.sum()), END, "u8")
    ends = np.zeros(len(hashes), bool)
    ends[np.cumsum(sizes) - 1] = True
    hashes[~ends] = words.hashes
    return hashes, sizes


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes by falling count, and the number of every token's hash."""
    kinds, number, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    by_count = np.argsort(-counts, kind="stable")
    place = np.empty(len(kinds), "u4")
    place[by_count] = np.arange(len(kinds), dtype="u4")
    return kinds[by_count], place[number]


def _grams(words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each token, for n = 1 to ``order``; ends fill up before a document's start."""
    first = words[tokens]
    place = np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, before, inner = [first], first, np.full(1, END, "u8")
    with np.errstate(over="ignore"):
        for _ in range(order - 1):
            # Shift the shorter n-grams by one token; before a document's start stand n-grams of ends alone.
            shifted = np.concatenate([before[:1], before[:-1]]) if len(before) else before
            shifted = np.where(place == 0, inner, shifted)
            before = mix(shifted * _FACTOR + first)
            inner = mix(inner * _FACTOR + END)
            out.append(before)
    return out


def _blocks(docs: DataFrame, key: str) -> DataFrame:
    """Stored blocks: documents' ids and parts, token counts, word numbers and words of about ``BLOCK_BYTES`` of text."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0

        def block(ids: list, role: list, parts: list) -> pa.RecordBatch:
            nonlocal made
            made += 1
            words, tokens = numbered(np.concatenate([h for h, _ in parts]))
            sizes = np.concatenate([s for _, s in parts])
            columns = [
                pa.array([(part << 32) + made], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.concat_arrays(ids)),
                pa.array([pack_integers(np.array(role, "u1"))], pa.binary()),
                pa.array([pack_integers(small_integers(sizes))], pa.binary()),
                pa.array([pack_integers(tokens)], pa.binary()),
                pa.array([words.tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "ids", "role", "sizes", "tokens", "words"])

        ids, role, parts, size = [], [], [], 0
        for batch in batches:
            lengths = byte_lengths(batch.column("text"))
            for start, count in text_parts(lengths, batch.num_rows):
                held = sum(lengths[start : start + count])
                if parts and size + held > BLOCK_BYTES:
                    yield block(ids, role, parts)
                    ids, role, parts, size = [], [], [], 0
                own = batch.slice(start, count)
                ids.append(own.column("id"))
                role += own.column("role").to_pylist()
                parts.append(hash_tokens(own.column("text").to_pylist()))
                size += held
        if parts:
            yield block(ids, role, parts)
        trimmed()

    schema = f"block long, ids array<{kind}>, role binary, sizes binary, tokens binary, words binary"
    return stored(docs.select(F.col(key).alias("id"), "role", "text").mapInArrow(run, schema), "lm_blocks")


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = unpack_integers(row["sizes"]).astype("i8")
    return np.frombuffer(row["words"], "u8"), unpack_integers(row["tokens"]).astype("i8"), sizes, unpack_integers(row["role"])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: a row is a block, and only one is unpacked at once."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _distinct(words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per n: the distinct n-gram hashes of a block, ascending, and the number of each token's n-gram."""
    for n, gram in enumerate(_grams(words, tokens, sizes, order), 1):
        kinds, number = np.unique(gram, return_inverse=True)
        yield n, kinds, number


def _requests(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """Per (bucket, n, block): the block's n-grams of the bucket with their counts in kept and deleted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            words, tokens, sizes, role = _opened(row)
            of = np.repeat(role, sizes)
            for n, kinds, number in _distinct(words, tokens, sizes, order):
                kept = np.bincount(number[of == KEPT], minlength=len(kinds))
                deleted = np.bincount(number[of == PART], minlength=len(kinds))
                # Hashes ascend, and a bucket is a range of hashes.
                edge = np.searchsorted(kinds, _edges(buckets))
                out = [(k, n, row["block"], a, b) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
                for at in range(0, len(out), 64):
                    part = out[at : at + 64]
                    columns = [
                        pa.array([p[0] for p in part], pa.int32()),
                        pa.array([n] * len(part), pa.int32()),
                        pa.array([p[2] for p in part], pa.int64()),
                        pa.array([pack_integers(np.diff(kinds[a:b], prepend=np.uint64(0))) for *_, a, b in part], pa.binary()),
                        pa.array([pack_integers(small_integers(kept[a:b])) for *_, a, b in part], pa.binary()),
                        pa.array([pack_integers(small_integers(deleted[a:b])) for *_, a, b in part], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["bucket", "n", "block", "grams", "kept", "deleted"])
            trimmed()

    return blocks.select("block", "role", "sizes", "tokens", "words").mapInArrow(run, "bucket int, n int, block long, grams binary, kept binary, deleted binary")


def _edges(buckets: int) -> np.ndarray:
    return np.array([(k << 64) // buckets for k in range(buckets)] + [(1 << 64) - 1], "u8") if buckets > 1 else np.array([0, (1 << 64) - 1], "u8")


def _answer(table: pa.Table) -> pa.Table:
    """Sum the requests of one (bucket, n) over all blocks; one answer per request and one row of totals."""
    rows = table.to_pylist()
    grams = [np.cumsum(unpack_integers(r["grams"]), dtype="u8") for r in rows]
    sizes = [len(g) for g in grams]
    kinds, number = np.unique(np.concatenate(grams), return_inverse=True)
    total = []
    for name in ("kept", "deleted"):
        held = np.zeros(len(kinds), "i8")
        np.add.at(held, number, np.concatenate([unpack_integers(r[name]) for r in rows]).astype("i8"))
        total.append(held)
    kept, both = total[0], total[0] + total[1]
    ends = np.cumsum(sizes)
    out = {
        "block": [r["block"] for r in rows] + [None],
        "n": [r["n"] for r in rows] + [rows[0]["n"]],
        "bucket": [r["bucket"] for r in rows] + [rows[0]["bucket"]],
        "deleted": [pack_integers(small_integers(total[1][number[e - s : e]])) for s, e in zip(sizes, ends, strict=True)] + [b""],
        "both": [pack_integers(small_integers(both[number[e - s : e]])) for s, e in zip(sizes, ends, strict=True)] + [b""],
        "sums": [None] * len(rows) + [[int((both > 0).sum()), int(both.sum()), int(kept.sum())]],
    }
    return pa.table(out, schema=_ANSWER)


_ANSWER = pa.schema(
    [("block", pa.int64()), ("n", pa.int32()), ("bucket", pa.int32()), ("deleted", pa.binary()), ("both", pa.binary()), ("sums", pa.list_(pa.int64()))]
)


def _counted(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    """Blocks with their tokens' counts, one packed array per n.  Rows of totals have no block.

    ``both`` counts over all that is learnt from; ``kept`` without the deleted documents, and
    for tokens of deleted documents only.
    """
    answers = _requests(blocks, order, buckets).groupBy("bucket", "n").applyInArrow(_answer, "block long, n int, bucket int, deleted binary, both binary, sums array<long>")
    # Stored, so that the requests' shuffle, the largest of all, can be let go before the next one.
    answers = stored(answers, "lm_answers")
    released(blocks.sparkSession)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            n = right.num_rows
            empty = {"ids": left.schema.field("ids").type, "role": pa.binary(), "sizes": pa.binary(), "kept": pa.list_(pa.binary()), "both": pa.list_(pa.binary())}
            return pa.table({c: pa.nulls(n, kind) for c, kind in empty.items()} | {"n": right["n"], "sums": right["sums"]})
        row = left.drop_columns(["ids"]).to_pylist()[0]
        words, tokens, sizes, role = _opened(row)
        deleted = np.repeat(role == PART, sizes)
        given: dict[tuple[int, str], dict[int, bytes]] = {}
        for r in right.to_pylist():
            for name in ("deleted", "both"):
                given.setdefault((r["n"], name), {})[r["bucket"]] = r[name]
        packed: dict[str, list[bytes]] = {"kept": [], "both": []}
        for n, _, number in _distinct(words, tokens, sizes, order):
            gone, both = (np.concatenate([unpack_integers(data) for _, data in sorted(given[n, name].items())]) for name in ("deleted", "both"))
            packed["both"].append(pack_integers(small_integers(both[number])))
            mine = number[deleted]
            packed["kept"].append(pack_integers(small_integers(both[mine].astype("i8") - gone[mine])))
        columns = {
            "ids": left["ids"],
            "role": left["role"],
            "sizes": left["sizes"],
            "kept": pa.array([packed["kept"]], pa.list_(pa.binary())),
            "both": pa.array([packed["both"]], pa.list_(pa.binary())),
            "n": pa.nulls(1, pa.int32()),
            "sums": pa.nulls(1, pa.list_(pa.int64())),
        }
        return pa.table(columns)

    kind = dict(blocks.dtypes)["ids"]
    schema = f"ids {kind}, role binary, sizes binary, kept array<binary>, both array<binary>, n int, sums array<long>"
    counted = stored(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, schema), "lm_counts")
    dropped(blocks, answers)
    return counted


def context_bucket(count: np.ndarray) -> np.ndarray:
    """Bucket of a context by its frequency: two per doubling, 0 for one never seen."""
    with np.errstate(divide="ignore"):
        return np.where(count > 0, np.floor(2.0 * np.log2(np.maximum(count, 1))).astype("i8") + 1, 0)


BUCKETS = 130


def _estimates(counts: list[np.ndarray], sizes: np.ndarray, total: int, docs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per n: maximum-likelihood estimate of every token and frequency of its context."""
    start = np.cumsum(sizes) - sizes
    for n, count in enumerate(counts, 1):
        if n == 1:
            context = np.full(len(count), total, "f8")
        else:
            context = np.concatenate([[0.0], counts[n - 2][:-1].astype("f8")])[: len(count)]
            context[start] = docs  # as many as documents: each starts once
        yield np.where(context > 0, count / np.maximum(context, 1.0), 0.0), context


def mixed(counts: list[np.ndarray], sizes: np.ndarray, total: int, docs: int, kinds: int, weights: list[np.ndarray]) -> np.ndarray:
    """Probability of every token by the orders whose weights are given."""
    p = np.full(len(counts[0]), 1.0 / (kinds + 1))
    for (estimate, context), weight in zip(_estimates(counts, sizes, total, docs), weights, strict=False):
        w = weight[context_bucket(context)]
        p = w * estimate + (1.0 - w) * p
    return p


def fit_weights(events: dict[int, dict[int, int]], steps: int = STEPS) -> np.ndarray:
    """Mixture weights per context bucket by expectation-maximisation.

    ``events[bucket][ratio]`` counts deleted tokens whose estimate is ``2 ** (ratio /
    RATIO_STEPS)`` times what lower orders say; ``None`` as ratio stands for an estimate of 0.
    A bucket without events takes the weight of the next rarer one; contexts never seen have 0.
    """
    out = np.zeros(BUCKETS)
    last = 0.5
    for bucket in range(1, BUCKETS):
        own = events.get(bucket)
        if own:
            keys = list(own)
            number = np.array([own[k] for k in keys], "f8")
            ratio = np.array([0.0 if k is None else 2.0 ** (k / RATIO_STEPS) for k in keys])
            w = 0.5
            for _ in range(steps):
                # Expected share of tokens that come from the longer n-gram.
                step = float((number * (w * ratio / (w * ratio + 1.0 - w))).sum() / number.sum())
                step = min(max(step, 1e-6), 1.0 - 1e-6)  # every word stays possible
                if abs(step - w) < 1e-9:
                    break
                w = step
            last = w
        out[bucket] = last
    return out


def _learnt(counted: DataFrame, order: int, totals: dict[str, int]) -> list[np.ndarray]:
    """Weights of every order, shortest first; each order takes one pass over the deleted documents."""
    weights: list[np.ndarray] = []
    for n in range(1, order + 1):
        given = list(weights)

        def run(batches: Iterator[pa.RecordBatch], n: int = n, given: list[np.ndarray] = given) -> Iterator[pa.RecordBatch]:
            for row in _each(batches):
                sizes, role = unpack_integers(row["sizes"]).astype("i8"), unpack_integers(row["role"])
                if not (role == PART).any():
                    continue
                own = sizes[role == PART]
                counts = [unpack_integers(c) for c in row["kept"][:n]]
                below = mixed(counts, own, totals["kept"], totals["kept_docs"], totals["kinds"], given)
                *_, (estimate, context) = _estimates(counts, own, totals["kept"], totals["kept_docs"])
                bucket = context_bucket(context)
                with np.errstate(divide="ignore"):
                    ratio = np.log2(estimate / below) * RATIO_STEPS
                ratio = np.where(estimate > 0, np.round(ratio), -(2**20)).astype("i8")
                both, times = np.unique(bucket * 2**24 + ratio + 2**21, return_counts=True)
                columns = [pa.array(both >> 24, pa.int64()), pa.array((both & (2**24 - 1)) - 2**21, pa.int64()), pa.array(times, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "ratio", "times"])

        found = counted.where(F.col("role").isNotNull()).select("sizes", "role", "kept").mapInArrow(run, "bucket long, ratio long, times long")
        events: dict[int, dict[int | None, int]] = {}
        # Bounded: buckets times steps of the ratio.
        for r in found.groupBy("bucket", "ratio").agg(F.sum("times").alias("times")).collect():
            events.setdefault(r["bucket"], {})[r["ratio"] if r["ratio"] > -(2**20) else None] = r["times"]
        weights.append(fit_weights(events))
    return weights


def score_texts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    order: int = ORDER,
    folds: int = FOLDS,
    held_fold: int = HELD_FOLD,
    deleted: int = DELETED,
) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Learns from rows outside the held fold; a null id is in no fold and is learnt from.  A
    null or empty text is the end token alone.  Repeated rows are learnt from and scored as
    often as they stand there.  A text of any length is scored whole; one longer than
    ``BLOCK_BYTES`` is a block alone.  If nothing is learnt, all words are equally likely
    and both scores are 0.  An empty table gives an empty one.  ``base_score`` is the
    unigram score with one added to every count.
    """
    held_out = F.coalesce(fold_of(key, folds) == held_fold, F.lit(False))
    # Equal texts are deleted together, so that none is learnt from its own copy.
    deletes = F.pmod(F.xxhash64(F.col(text)), F.lit(deleted)) == 0
    role = F.when(held_out, LEFT_OUT).when(F.coalesce(deletes, F.lit(False)), PART).otherwise(KEPT)
    name = fresh("id")
    plain = docs.select(F.col(key).alias(name), role.cast("int").alias("role"), F.col(text).alias("text"))
    blocks = _blocks(plain, name)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    counted = _counted(blocks, order, max(1, size // BUCKET_BYTES))
    sums = counted.where(F.col("n") == 1).agg(*[F.sum(F.col("sums")[k]).alias(c) for k, c in enumerate(("kinds", "both", "kept"))]).first()
    totals = {c: sums[c] or 0 for c in ("kinds", "both", "kept")}
    in_part = plain.agg(F.count_if(F.col("role") == KEPT), F.count_if(F.col("role") == PART)).first()
    totals |= {"kept_docs": in_part[0], "both_docs": in_part[0] + in_part[1]}
    weights = _learnt(counted, order, totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column("ids").slice(k, 1).flatten()
                role, sizes = (unpack_integers(batch.column(c)[k].as_py()) for c in ("role", "sizes"))
                sizes = sizes.astype("i8")
                counts = [unpack_integers(c) for c in batch.column("both")[k].as_py()]
                doc = np.repeat(np.arange(len(sizes)), sizes)
                base = np.log10((counts[0] + 1.0) / (totals["both"] + totals["kinds"] + 1.0))
                score = np.log10(mixed(counts, sizes, totals["both"], totals["both_docs"], totals["kinds"], weights))
                columns = [
                    ids,
                    pa.array(role == LEFT_OUT),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.bincount(doc, counts[0] > 0, len(sizes)).astype("i8"), pa.int64()),
                    pa.array(np.full(len(sizes), totals["both"], "i8"), pa.int64()),
                    pa.array(np.bincount(doc, base, len(sizes)), pa.float64()),
                    pa.array(np.bincount(doc, score, len(sizes)), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [name, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"`{name}` {dict(plain.dtypes)[name]}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = counted.where(F.col("role").isNotNull()).select("ids", "role", "sizes", "both").mapInArrow(run, schema)
    return scored.withColumnRenamed(name, key)
