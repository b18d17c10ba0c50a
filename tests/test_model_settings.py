"""Registered model queries run with the full settings."""

import inspect

import pytest

from lotgrid.plans import ml_queries as M
from lotgrid.plans.catalog import QUERIES


class Called(Exception):
    pass


@pytest.fixture
def settings(monkeypatch):
    """Settings, defaults included, with which a query calls an operator."""

    def of(operator, run):
        signature = inspect.signature(getattr(M.ml, operator))

        def record(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            raise Called(dict(bound.arguments))

        monkeypatch.setattr(M.ml, operator, record)
        with pytest.raises(Called) as got:
            run()
        return got.value.args[0]

    for inputs in ("_vectors", "_scaled"):
        monkeypatch.setattr(M, inputs, lambda t: None)
    return of


class Tables:
    features_with_gaps = None


def test_clusters(settings):
    assert settings("fit_clusters", lambda: M._clusters(Tables))["restarts"] == 10
    sweep = settings("sweep_clusters", lambda: QUERIES["cluster_sweep_M6"].run(None, "none"))
    assert list(sweep["ks"]) == list(range(2, 11)) and sweep["restarts"] == 10


def test_classifiers(settings):
    forest = settings("forest", lambda: M.MODELS["forest"](None))
    assert (forest["trees"], forest["depth"], forest["min_leaf"]) == (200, 30, 1)
    machine = settings("fit_kernel_svm", lambda: M.MODELS["kernel_svm"](None))
    assert (machine["size"], machine["max_iter"]) == (128, 100)
    folds = settings("cross_validate", lambda: QUERIES["cross_validation_M14"].run(None, "none"))
    assert folds["folds"] == 5 and set(folds["models"]) == {"logistic", "kernel_svm", "forest"}


def test_round_trip_scores_the_rows_it_scaled_once(spark, monkeypatch):
    """A scaling whose last digits differ from one call to the next changes no row of the round trip."""
    from pyspark.sql import functions as F

    scalings = []

    def scaled(t):
        scalings.append(None)
        nudge = 1.0 + len(scalings) * 1e-15
        values = [(F.col("id") % (3 + i) * 0.37 * nudge).alias(c) for i, c in enumerate(M.COLS)]
        return spark.range(200).select(F.col("id").alias("bbl"), (F.col("id") % 4 == 0).cast("int").alias("y"), *values)

    class Session:
        pass

    Session.spark = spark
    monkeypatch.setattr(M, "_scaled", scaled)
    out = QUERIES["model_round_trip_same_M16"].build(Session)
    assert out.where("NOT same").count() == 0
    assert len(scalings) == 1
