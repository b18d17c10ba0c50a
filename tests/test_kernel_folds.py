"""Kernel machines of all folds of a cross-validation, fitted together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotgrid.operators import ml
from lotgrid.plans import ml_queries as M


def _table(spark, n=300):
    values = [(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 500.0 - 1.0).alias(c) for k, c in enumerate("ab")]
    df = spark.range(n).select(F.col("id").alias("bbl"), *values, (F.col("id") % 3).cast("int").alias("fold"))
    return df.withColumn("y", (F.col("a") * F.col("a") + F.col("b") * F.col("b") < 0.5).cast("int"))


def test_a_cross_validation_fits_no_machine_by_itself(monkeypatch, spark):
    monkeypatch.setattr(ml, "fit_kernel_svm", lambda *_, **__: pytest.fail("one fold after the other"))
    passes, summed = [], ml._summed
    monkeypatch.setattr(ml, "_summed", lambda *a: passes.append(None) or summed(*a))
    assert isinstance(M.MODELS["kernel_svm"], ml.SharedKernel)
    out = ml.cross_validate(_table(spark).drop("fold"), {"kernel_svm": ml.SharedKernel(("a", "b"))}, folds=3).collect()
    assert sorted(r.fold for r in out) == [0, 1, 2]
    assert all(r.average_precision > 0.8 for r in out)
    assert len(passes) <= 1 + 100 + 100  # moments, steps of the machines and of their maps, whatever the number of folds


def test_a_fold_is_scored_by_the_machine_of_the_others(spark):
    df = _table(spark)
    together = {r.bbl: r.prob for r in ml.kernel_fold_scores(df, ["a", "b"], size=32).where("fold = 1").collect()}
    alone = ml.fit_kernel_svm(ml.balanced_weights(df.where("fold <> 1")), ["a", "b"], size=32)
    one = {r.bbl: r.prob for r in ml.positive_score(alone.transform(df.where("fold = 1"))).collect()}
    assert together.keys() == one.keys() and len(one) == 100
    assert np.mean([abs(together[k] - p) for k, p in one.items()]) < 0.05
    assert np.mean([(together[k] > 0.5) == (p > 0.5) for k, p in one.items()]) > 0.95


def test_rows_without_a_label_or_a_feature(spark):
    df = _table(spark, 90).withColumn("a", F.when(F.col("bbl") != 5, F.col("a"))).withColumn("y", F.when(F.col("bbl") != 7, F.col("y")))
    out = {r.bbl: r.prob for r in ml.kernel_fold_scores(df, ["a", "b"], size=16).collect()}
    assert len(out) == 90 and out[5] is None and out[7] is not None
    one_kind = ml.kernel_fold_scores(df.withColumn("y", F.lit(1)), ["a", "b"], size=16).collect()
    assert len(one_kind) == 90 and all(r.prob is None for r in one_kind)
