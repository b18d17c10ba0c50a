"""Quality scores learnt from preference pairs (Bradley-Terry).

A document of quality 1 is preferred to one of quality 0.  The chance of that preference is
the logistic function of the difference of two scores, and a score is linear in text
features, so fitting is a logistic regression without intercept on feature differences.
Scores are cut at the quantile that leaves as many labelled documents below as have label 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgrid.llm.common import byte_lengths, dropped, map_texts, stored, text_parts, trimmed
from lotgrid.llm.language_id import fold_of
from lotgrid.llm.wordhash import Words, shingle_sets, split_words
from lotgrid.operators.ranking import column_quantiles, running_totals

# Production parameters.
TRAIN_ROWS = 20_000  # labelled rows that are learnt from, about half per label; the only bounded sample
PARTNERS = 4  # preferences in which each sampled document takes part from its own side
FOLDS, HELD_FOLD = 5, 0
CUT = 0.3  # score at the quantile threshold
REGULARISATION = 1e-4
TEXTS_AT_ONCE = 256
BROADCAST_LABELS = 1_000_000  # rows of an id and a label: 16 MB
BYTES_AT_ONCE = 256 << 10  # of text; features take about a hundred times as much for a moment

FEATURES = [
    "log_words",
    "mean_word_bytes",
    "upper_share",
    "digit_share",
    "mark_share",
    "other_byte_share",
    "marked_words",
    "shouted_words",
    "lone_marks",
    "repeated_neighbours",
    "longest_repeat",
    "repeated_shingles",
    "worst_line_marks",
    "worst_line_upper",
    "worst_line_repeats",
    "log_line_words",
    "sentence_ends",
    "top_word_share",
]

_UPPER, _LETTER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
# Marks that are rare in prose; sentence punctuation and quotes are not among them.
_MARK[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = True


def _sums(flags: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype="i8")])
    return total[end] - total[begin]


def text_features(texts: list[str | None]) -> np.ndarray:
    """One row of ``FEATURES`` per text; all zero for a text without words."""
    w: Words = split_words(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    if not len(w.hashes):
        return out
    size = w.end - w.begin
    upper, letters = _sums(_UPPER[w.data], w.begin, w.end), _sums(_LETTER[w.data], w.begin, w.end)
    digits, marks = _sums(_DIGIT[w.data], w.begin, w.end), _sums(_MARK[w.data], w.begin, w.end)
    high = _sums(w.data >= 128, w.begin, w.end)
    last = w.data[w.end - 1]
    same = np.concatenate([[False], w.hashes[1:] == w.hashes[:-1]])
    doc = np.repeat(np.arange(len(texts)), np.diff(w.bounds))
    same[w.bounds[:-1][w.bounds[:-1] < len(same)]] = False
    run_start = np.flatnonzero(~same)
    runs = np.diff(np.append(run_start, len(same)))
    breaks = np.concatenate([[0], np.cumsum(w.data == 10)])
    line = breaks[w.begin]
    new_line = np.concatenate([[True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])])
    lines = np.flatnonzero(new_line)
    line_doc, line_words = doc[lines], np.diff(np.append(lines, len(doc)))
    per_line = lambda v: np.add.reduceat(v, lines)
    line_bytes = per_line(size)
    whole = line_words >= 4  # a heading of a few words says little
    n = np.bincount(doc, minlength=len(texts)).astype("f8")
    has = n > 0
    per_doc = lambda v: np.bincount(doc, v, len(texts))
    nb = np.maximum(per_doc(size), 1.0)
    n1 = np.maximum(n, 1.0)

    def worst(share: np.ndarray) -> np.ndarray:
        best = np.zeros(len(texts))
        np.maximum.at(best, line_doc[whole], share[whole])
        return best

    longest = np.ones(len(texts))
    np.maximum.at(longest, doc[run_start], runs)
    shingles = shingle_sets(w)
    kinds = np.array([len(s) for s in shingles], "f8")
    top = np.array([np.unique(w.hashes[a:b], return_counts=True)[1].max(initial=0) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)], "f8")
    columns = [
        np.log1p(n),
        np.minimum(nb / n1, 40.0),
        per_doc(upper) / np.maximum(per_doc(letters), 1.0),
        per_doc(digits) / nb,
        per_doc(marks) / nb,
        per_doc(high) / nb,
        per_doc((_MARK[last] & (letters + high > 0)).astype("f8")) / n1,
        per_doc(((upper == letters) & (letters > 2)).astype("f8")) / n1,
        per_doc((marks == size).astype("f8")) / n1,
        per_doc(same.astype("f8")) / n1,
        np.log(longest),
        1.0 - kinds / np.maximum(n - 4.0, 1.0),
        worst(per_line(marks) / line_bytes),
        worst(per_line(upper) / line_bytes),
        worst(per_line(same.astype("i8")) / line_words),
        np.log1p(n / np.maximum(np.bincount(line_doc, minlength=len(texts)), 1.0)),
        per_doc(np.isin(last, np.frombuffer(b".!?", "u1")).astype("f8")) / n1,
        top / n1,
    ]
    out[has] = np.stack(columns, axis=1)[has]
    return np.clip(out, 0.0, 100.0)


def with_features(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``features array<double>``, in Arrow batches."""

    made = {"features": ("array<double>", pa.list_(pa.float64()))}
    return map_texts(docs, keep, text, made, lambda texts: (None, {"features": text_features(texts).tolist()}), TEXTS_AT_ONCE, BYTES_AT_ONCE)


@dataclass(frozen=True)
class Ranking:
    """Score weights over scaled features, the quantile threshold and the slope of the score."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def strength(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.spread) @ self.weights

    def score(self, features: np.ndarray) -> np.ndarray:
        """0 to 1; ``CUT`` at the threshold."""
        z = (self.strength(features) - self.threshold) * self.slope + np.log(CUT / (1.0 - CUT))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, folds: int = FOLDS, held_fold: int = HELD_FOLD) -> Ranking | None:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, quality)`` outside the held fold.

    At most ``train_rows // 2`` documents per label, those of the smallest text hashes, are
    read; equal texts with one label count once and contradictory labels of an id count as
    given; the threshold is taken over all labelled documents, not the sample.  None when one
    of the labels is missing.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & (fold_of("doc_id", folds) != held_fold)).select("doc_id", "quality").distinct()
    hashed = docs.select("doc_id", F.xxhash64("text").alias("key"))
    known = hashed.join(marked, "doc_id").groupBy("quality", "key").agg(F.min("doc_id").alias("doc_id"))
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(sizes) < 2:
        return None
    half = train_rows // 2
    chosen = known.where("quality = 0").orderBy("key").limit(half).unionByName(known.where("quality = 1").orderBy("key").limit(half))
    # At most train_rows short rows: bounded by the parameter.
    sample = docs.join(F.broadcast(chosen), "doc_id").where(F.xxhash64("text") == F.col("key")).dropDuplicates(["quality", "key"])
    sample = stored(with_features(sample.select("doc_id", "text", "quality", "key"), "text", ["quality", "key"]), "quality_sample")
    mean, spread, sizes = scales(sample)
    pairs = stored(preferences(sample, spread, sizes), "quality_pairs")
    vectors = pairs.select(array_to_vector("gap").alias("gap"), "label")
    fit = LogisticRegression(featuresCol="gap", labelCol="label", fitIntercept=False, standardization=False, regParam=REGULARISATION, maxIter=100).fit(vectors)
    dropped(sample, pairs)
    ranking = Ranking(mean, spread, fit.coefficients.toArray(), 0.0, 1.0)
    return replace(ranking, threshold=cut_point(docs, marked, ranking))


def scales(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Mean and spread of every feature of ``sample(quality, features)``, and its rows of quality 0 and of 1.

    A feature that is the same everywhere has spread 1.
    """
    each = [F.col("features")[k] for k in range(len(FEATURES))]
    n_bad, n_good, *found = sample.agg(F.count_if(F.col("quality") == 0), F.count_if(F.col("quality") == 1), *map(F.avg, each), *map(F.stddev_pop, each)).first()
    mean, spread = np.array(found).reshape(2, -1)
    spread[spread < 1e-9] = 1.0
    return mean, spread, (n_bad, n_good)


def preferences(sample: DataFrame, spread: np.ndarray, sizes: tuple[int, int]) -> DataFrame:
    """``gap, label``: differences of scaled features, ``PARTNERS`` from the side of every row of ``sample(quality, key, features)``.

    A document meets partners of the other label at even steps through their list, ordered
    by key; (quality, key) is unique.  Half of the differences are turned round, so that both
    outcomes occur.  They are made and stay on the executors.
    """
    placed = running_totals(sample.withColumn("one", F.lit(1)), "key", {"place": "one"}, by=("quality",))
    placed = placed.select(F.col("quality").cast("int").alias("quality"), (F.col("place") - 1).alias("place"), "features")
    own = placed.withColumn("turn", F.explode(F.array(*map(F.lit, range(PARTNERS))))).withColumn("turn", F.col("place") * PARTNERS + F.col("turn"))
    others = F.when(F.col("quality") == 1, F.lit(sizes[0])).otherwise(F.lit(sizes[1]))
    own = own.select("quality", "turn", "features", (F.col("turn") * 7919 % others).alias("place"))
    met = own.join(placed.select((1 - F.col("quality")).alias("quality"), "place", F.col("features").alias("other")), ["quality", "place"])
    label = (F.col("turn") % 2 == 0).cast("double")
    sign = (label * 2 - 1) * (F.col("quality") * 2 - 1)
    gap = F.zip_with(F.zip_with("features", "other", lambda x, y: sign * (x - y)), F.array(*map(F.lit, spread.tolist())), lambda d, s: d / s)
    return met.select(gap.alias("gap"), label.alias("label"))


def strengths(texts: Column, model: Ranking) -> Column:
    """Strength of every text under a model; only texts go to Python and one number comes back."""

    @F.arrow_udf("double")
    def strength(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = text_parts(byte_lengths(batch), TEXTS_AT_ONCE, BYTES_AT_ONCE)
            found = [model.strength(text_features(batch.slice(a, n).to_pylist())) for a, n in parts]
            yield pa.array(np.concatenate([np.zeros(0), *found]), pa.float64())
        trimmed()

    return strength(texts)


def cut_point(docs: DataFrame, marked: DataFrame, model: Ranking) -> float:
    """Strength with as many labelled documents below as have label 0, over all of ``marked(doc_id, quality)``.

    All labelled texts are scored where they lie; the quantile is exact and distributed.  It
    lies half way between the two neighbours.
    """
    marked = stored(marked, "quality_labels")
    if marked.count() <= BROADCAST_LABELS:
        scored = docs.join(F.broadcast(marked), "doc_id").select("quality", strengths(F.col("text"), model).alias("strength"))
    else:
        # Too many labels to send about: numbers are shuffled to them, not texts.
        scored = docs.select("doc_id", strengths(F.col("text"), model).alias("strength")).join(marked, "doc_id").select("quality", "strength")
    scored = stored(scored, "quality_strengths")
    low, n = scored.agg(F.count_if(F.col("quality") == 0), F.count(F.lit(1))).first()
    at = min(max((low - 0.5) / max(n - 1, 1), 0.0), 1.0)
    threshold = column_quantiles(scored, ["strength"], [at])["strength"][at]
    dropped(scored, marked)
    return threshold


def score_documents(docs: DataFrame, model: Ranking | None, folds: int = FOLDS, held_fold: int = HELD_FOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    A null or empty text has the features of no words and is scored like any other.  Without
    a model every score is 0.5.  A null id is in no fold and so not held out.  Repeated rows
    are scored each.
    """

    def run(texts: list[str | None]) -> tuple[None, dict[str, list]]:
        score = np.full(len(texts), 0.5) if model is None else model.score(text_features(texts))
        return None, {"score": score.tolist(), "predicted": (score >= CUT).astype("i4").tolist()}

    held = F.coalesce(fold_of("doc_id", folds) == held_fold, F.lit(False))
    made = {"score": ("double", pa.float64()), "predicted": ("int", pa.int32())}
    return map_texts(docs.select("doc_id", held.alias("held_out"), "text"), ["doc_id", "held_out"], "text", made, run, TEXTS_AT_ONCE, BYTES_AT_ONCE)


def keep_good(docs: DataFrame, model: Ranking | None, text: str = "text") -> DataFrame:
    """Rows of ``docs`` with a score of at least ``CUT``; all columns stay as they are.

    A null or empty text is scored as one without words; repeated rows are kept or dropped
    together.  Without a model (a label is missing) all rows stay.
    """
    if model is None:
        return docs
    return docs.where(strengths(F.col(text), model) >= F.lit(model.threshold))
