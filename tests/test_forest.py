"""The forest that tasks grow: large nodes split by histograms, small ones in groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotgrid.operators import ml
from lotgrid.operators.forest import forest_scores, grow_and_score
from lotgrid.plans import ml_queries as M


def _table(spark, n=600):
    noise = F.xxhash64("id") % 1000 / 1000.0
    df = spark.range(n).select(F.col("id").alias("bbl"), (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), noise.alias("c"))
    return df.withColumn("y", ((F.col("a") >= 7) | (F.col("b") == 3)).cast("int"))


@pytest.mark.parametrize("group_rows", [40, 100_000])
def test_forest_learns_a_rule_in_large_and_small_nodes(spark, group_rows):
    df = _table(spark)
    out = forest_scores(df, ["a", "b", "c"], trees=12, depth=12, group_rows=group_rows).collect()
    assert sorted(r.bbl for r in out) == list(range(600))
    assert np.mean([r.prediction == r.y for r in out]) > 0.98
    assert all(0.0 <= r.prob <= 1.0 for r in out)


def test_folds_are_scored_by_the_forests_of_the_others(spark):
    """A label that only the row's own key tells is learnt by heart, not by the other folds."""
    df = _table(spark, 60).withColumn("y", (F.xxhash64("bbl") % 2 == 0).cast("int")).withColumn("a", F.col("bbl").cast("double")).withColumn("fold", (F.col("bbl") % 3).cast("int"))
    own = forest_scores(df, ["a"], trees=12).collect()
    others = forest_scores(df, ["a"], trees=12, fold="fold").collect()
    assert len(others) == 60
    right, right_apart = (np.mean([r.prediction == r.y for r in rows]) for rows in (own, others))
    assert right > 0.7 and right_apart < right - 0.15


def test_no_depth_left_gives_the_share():
    x, y, drawn = np.zeros((4, 1), "u1"), np.array([0, 0, 1, 1]), np.array([1, 1, 2, 0])
    prob = grow_and_score(x, y, drawn, (1.0, 1.0), 1, 0, 1, np.random.default_rng(0))
    assert prob.tolist() == [0.5] * 4


def test_registered_forests_fit_no_ensemble_on_the_driver(monkeypatch, spark):
    monkeypatch.setattr(ml.RandomForestClassifier, "fit", lambda *_: pytest.fail("trees grown on the driver"))
    cells = _table(spark, 60)
    monkeypatch.setattr(M, "COLS", ["a", "b", "c"])
    small = ml.SharedForest(lambda: ml.forest(["a", "b", "c"], trees=3, depth=30, min_leaf=1))
    folds = ml.cross_validate(cells, {"forest": small}, folds=2)
    assert folds.count() == 2
    assert isinstance(M.MODELS["forest"], ml.SharedForest)
