"""Scoring tables and blending overlapping patch predictions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotgrid.functions.grid import encode_probability
from lotgrid.functions.spectral import clamp
from lotgrid.operators import tiles as TL

CELL = ["prow", "pcol"]

# Outcome colours (red, green, blue, alpha) of the error map.
OUTCOME_RGBA = {"TP": (0, 255, 0, 255), "FP": (255, 0, 0, 255), "FN": (0, 0, 255, 255), "TN": (0, 0, 0, 255), "ignore": (255, 255, 255, 0)}


def hann(i: Column, size: int) -> Column:
    """numpy's ``hanning(size)`` at position i."""
    return 0.5 - 0.5 * F.cos(2.0 * pi * i / (size - 1))


def hann_weight(patch: int, *, floor: float = 1e-3, trim_ends: bool = False) -> Column:
    """Separable Hann weight of patch cell (i, j), never below ``floor``.

    ``trim_ends`` uses a window two longer without its zero ends.
    """
    size, shift = (patch + 2, 1) if trim_ends else (patch, 0)
    return F.greatest(hann(F.col("i") + shift, size) * hann(F.col("j") + shift, size), F.lit(floor))


def global_cells(patch_scores: DataFrame) -> DataFrame:
    """Patch cells placed on the raster."""
    return patch_scores.withColumns(
        {"prow": (F.col("row_off") + F.col("i")).cast("int"), "pcol": (F.col("col_off") + F.col("j")).cast("int")}
    )


def blend(patch_scores: DataFrame, weight: Column, *, by=()) -> DataFrame:
    """Weighted mean probability per cell: two partial sums, combined before the shuffle."""
    placed = global_cells(patch_scores.withColumn("_w", weight)).where(F.col("prob").isNotNull())
    return placed.groupBy(*by, *CELL).agg((F.sum(F.col("prob") * F.col("_w")) / F.sum("_w")).alias("prob"))


def blend_hann(patch_scores: DataFrame, patch: int, *, by=()) -> DataFrame:
    return blend(patch_scores, hann_weight(patch), by=by)


def blend_buildings(patch_scores: DataFrame, patch: int) -> DataFrame:
    """Building variant: trimmed window, floor 0.05, clipped, stored as a byte."""
    out = blend(patch_scores, hann_weight(patch, floor=0.05, trim_ends=True))
    return out.select(*CELL, clamp(F.col("prob"), 0.0, 1.0).alias("prob"), encode_probability(F.col("prob")).alias("prob_byte"))


def class_zero_softmax(logits, target: int = 0) -> Column:
    """Probability of one class from a list of logit columns."""
    top = F.greatest(*logits)
    terms = [F.exp(x - top) for x in logits]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return terms[target] / total


def coverage_report(blended: DataFrame, patch_scores: DataFrame, total_cells) -> DataFrame:
    """Covered share of the raster and mean of the per-patch mean probabilities."""
    total = total_cells if isinstance(total_cells, Column) else F.lit(total_cells)
    per_patch = patch_scores.groupBy("row_off", "col_off").agg(F.avg("prob").alias("_m"))
    means = per_patch.agg(F.avg("_m"), F.count("*"))
    m = means.select(F.struct(F.col("avg(_m)").alias("mean"), F.col("count(1)").alias("n"))).scalar()
    return blended.agg((100.0 * F.count("*") / F.max(total)).alias("coverage_pct")).select(
        "coverage_pct", m["mean"].alias("mean_prob"), m["n"].alias("patches")
    )


def overlap_average(patch_scores: DataFrame, *, by=()) -> DataFrame:
    """Plain mean and number of predictions per cell."""
    return global_cells(patch_scores).groupBy(*by, *CELL).agg(F.avg("prob").alias("prob"), F.count("prob").alias("overlap"))


def overlap_report(averaged: DataFrame) -> DataFrame:
    return averaged.agg(F.max("overlap").alias("max_overlap"), F.avg("overlap").alias("mean_overlap"), F.count("*").alias("cells"))


def outcome(label: Column, prob: Column, threshold) -> Column:
    """TP/FP/FN/TN by ``prob > threshold``; "ignore" for unlabelled or unscored cells."""
    hit = prob > threshold
    return (
        F.when((label == 255) | label.isNull() | prob.isNull(), "ignore")
        .when(label == 1, F.when(hit, "TP").otherwise("FN"))
        .otherwise(F.when(hit, "FP").otherwise("TN"))
    )


OUTCOMES = ["ignore", "TN", "FP", "FN", "TP"]


def outcome_map(scores: DataFrame, mask: DataFrame, threshold: float, side: int = TL.SIDE) -> DataFrame:
    """Outcome per scored cell, ``prow, pcol, prob, label, outcome``.

    Scores and mask are cells or tiles; they meet tile by tile.  Stored scores can be re-cut
    at any threshold without scoring again.  A score row without a probability is "ignore";
    score tiles that have such cells need a band ``scored`` of 1 where a score row stands.
    """
    if "trow" not in scores.columns:
        scores = scores.withColumn("scored", F.lit(1))
    elif "scored" not in scores.columns:
        scores = scores.withColumn("scored", F.transform("prob", lambda p: F.when(F.isnan(p), TL.ABSENT).otherwise(1).cast("bigint")))
    tiles = TL.stack(TL.as_tiles(scores, ["prob", "scored"], side), TL.as_tiles(mask, ["label"], side), side)

    def compare(_r: int, _c: int, prob: np.ndarray, scored: np.ndarray, label: np.ndarray) -> dict:
        known = (label != TL.ABSENT) & (label != 255) & ~np.isnan(prob)
        code = np.where(known, 1 + 2 * (label == 1) + (prob > threshold), 0)
        keep = np.flatnonzero(scored == 1)
        at = {"prow": _r * side + keep // side, "pcol": _c * side + keep % side}
        values = {"prob": prob.reshape(-1)[keep], "label": label.reshape(-1)[keep], "code": code.reshape(-1)[keep]}
        return {k: v.astype("i4") for k, v in at.items()} | values

    cells = TL.map_tiles(tiles, ["prob", "scored", "label"], compare, "prow int, pcol int, prob double, label long, code long", side)
    names = F.array(*[F.lit(o) for o in OUTCOMES])
    return cells.select(
        *CELL,
        F.nanvl("prob", F.lit(None).cast("double")).alias("prob"),
        F.when(F.col("label") != TL.ABSENT, F.col("label")).cast("smallint").alias("label"),
        F.get(names, F.col("code").cast("int")).alias("outcome"),
    )


def outcome_rgba(code: Column) -> Column:
    colours = F.create_map(
        *[x for k, v in OUTCOME_RGBA.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))]
    )
    return F.try_element_at(colours, code)


def score_with_model(features: DataFrame, model, *, label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Apply a fitted pipeline; ignore cells get prediction 255 and no probability."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(features).withColumn("prob", vector_to_array("probability")[1])
    unlabelled = F.col(label) == 255
    return scored.withColumn("pred", F.when(unlabelled, 255).otherwise((F.col("prob") > threshold).cast("int"))).withColumn(
        "prob", F.when(~unlabelled, F.col("prob"))
    )


@dataclass(frozen=True)
class FlatForest:
    """Trees of a classifier as flat arrays: a node's feature (-1 at a leaf), threshold, children and P(1) of a leaf."""

    features: tuple[str, ...]
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray

    @staticmethod
    def of(features, trees: list[list[tuple]]) -> FlatForest:
        """From trees of nodes ``(feature, threshold, left, right, P(1))``, children numbered inside their tree, root first."""
        at = np.cumsum([0] + [len(t) for t in trees])
        rows = [(f, t, a + lo if f >= 0 else 0, a + hi if f >= 0 else 0, p) for a, tree in zip(at, trees) for f, t, lo, hi, p in tree]
        columns = [np.array(c) for c in zip(*rows)]
        kinds = ["i4", "f8", "i4", "i4", "f8"]
        return FlatForest(tuple(features), at[:-1].astype("i4"), *[c.astype(k) for c, k in zip(columns, kinds)])

    @staticmethod
    def stored(spark: SparkSession, path: str, features) -> FlatForest:
        """From a saved pipeline whose tree ensemble is the only stage with data.  The model's nodes come to the driver."""
        nodes = spark.read.parquet(f"{path}/model/stages/*/data")
        n = F.col("nodeData") if "nodeData" in nodes.columns else F.struct("*")
        tree = F.col("treeID") if "treeID" in nodes.columns else F.lit(0)
        rows = nodes.select(tree.alias("tree"), n["id"].alias("id"), n["leftChild"].alias("lo"), n["rightChild"].alias("hi"), n["split"].alias("split"), n["impurityStats"].alias("stats"))
        split = F.col("split.leftCategoriesOrThreshold")
        flat = rows.select("tree", "id", "lo", "hi", F.col("split.featureIndex").alias("f"), F.get(split, F.lit(0)).alias("t"), (F.get("stats", F.lit(1)) / (F.get("stats", F.lit(0)) + F.get("stats", F.lit(1)))).alias("p"))
        trees: dict[int, list] = {}
        for r in flat.orderBy("tree", "id").collect():
            trees.setdefault(r["tree"], []).append((r["f"] if r["lo"] >= 0 else -1, r["t"] if r["lo"] >= 0 else 0.0, r["lo"], r["hi"], r["p"]))
        return FlatForest.of(features, [trees[k] for k in sorted(trees)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean P(1) over the trees of rows ``(row, feature)``; all rows of a tree go down one level at a time."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            live = every
            while len(live):
                at = node[live]
                inner = self.feature[at] >= 0
                live, at = live[inner], at[inner]
                down = np.where(x[live, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
                node[live] = down
            total += self.leaf[node]
        return total / len(self.roots)


SCORE_ROWS = 16_384


def score_with_forest(features: DataFrame, forest: FlatForest, *, label: str = "label", threshold: float = 0.5) -> DataFrame:
    """``score_with_model`` with a flat forest, over Arrow batches.

    The forest is sent to every executor once; its size is that of the model, whatever the
    rows.  A null or NaN feature goes right, as it does in the fitted trees.
    """
    shared = features.sparkSession.sparkContext.broadcast(forest)

    @F.arrow_udf("double")
    def probability(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in columns:
            x = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), "f8") for c in batch], axis=1)
            parts = [model.score(x[k : k + SCORE_ROWS]) for k in range(0, len(x), SCORE_ROWS)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]))

    scored = features.withColumn("prob", probability(*[F.col(f) for f in forest.features]))
    unlabelled = F.col(label) == 255
    return scored.withColumn("pred", F.when(unlabelled, 255).otherwise((F.col("prob") > threshold).cast("int"))).withColumn("prob", F.when(~unlabelled, F.col("prob")))


def patch_tensors(cells: DataFrame, bands, patch: int, *, by=("row_off", "col_off")) -> DataFrame:
    """One row per patch with a row-major ``array<double>`` per band (patch*patch values, absent cells 0).

    A group is one patch.  Absent positions are added as zeros and everything is
    sorted once, so the work stays close to linear in the patch.
    """
    position = (F.col("i") * patch + F.col("j")).cast("int").alias("p")
    values = [F.col(b).cast("double").alias(b) for b in bands]
    packed = cells.groupBy(*by).agg(F.collect_list(F.struct(position, *values)).alias("_cells"))
    every = F.sequence(F.lit(0), F.lit(patch * patch - 1))
    absent = F.array_except(every, F.transform("_cells", lambda c: c.p))
    zeros = F.transform(absent, lambda p: F.struct(p.alias("p"), *[F.lit(0.0).alias(b) for b in bands]))
    filled = packed.select(*by, F.sort_array(F.concat("_cells", zeros)).alias("_cells"))

    def channel(band: str) -> Column:
        return F.transform("_cells", lambda c: F.coalesce(c[band], F.lit(0.0)))

    return filled.select(*by, *[channel(b).alias(b) for b in bands])


def score_patches(tensors: DataFrame, make_scorer, bands, patch: int, *, batch_size: int = 8, by=("row_off", "col_off")) -> DataFrame:
    """Score patch tensors with a user function, in Arrow batches.

    ``make_scorer()`` runs once per Python worker and returns a function from a
    float array (batch, bands, patch, patch) to probabilities (batch, patch, patch).
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    size = patch * patch
    n = len(bands)

    def make_predict():
        import numpy as np

        scorer = make_scorer()

        def predict(stacked):
            images = np.asarray(stacked).reshape(-1, n, patch, patch)
            return np.asarray(scorer(images), dtype=np.float64).reshape(len(images), size)

        return predict

    run = predict_batch_udf(make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[n * size]])
    scored = tensors.select(*by, run(F.concat(*[F.col(b) for b in bands])).alias("_p"))
    return scored.select(*by, F.posexplode("_p").alias("_pos", "prob")).select(
        *by, F.floor(F.col("_pos") / patch).cast("int").alias("i"), (F.col("_pos") % patch).cast("int").alias("j"), "prob"
    )
