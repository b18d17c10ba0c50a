"""Tiles: distances, halos, spans and zone sums against plain arrays; exact selection by digits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotgrid.functions import geometry as G
from lotgrid.functions.grid import Grid
from lotgrid.operators import ml, ranking, scoring, zonal
from lotgrid.operators import raster as R
from lotgrid.operators import tiles as TL


def table(spark, values, name="label", kind="int"):
    rows = [(i, j, None if v is None else v) for (i, j), v in np.ndenumerate(np.array(values, object))]
    return spark.createDataFrame(rows, f"prow int, pcol int, {name} {kind}")


def brute_distance(target):
    at = np.argwhere(target)
    out = np.full(target.shape, 10**6)
    for (i, j), _ in np.ndenumerate(target):
        if len(at):
            out[i, j] = ((at - (i, j)) ** 2).sum(axis=1).min()
    return out


@pytest.mark.parametrize("reach", [1, 2, 5])
def test_distance_is_exact_within_reach(reach):
    rng = np.random.default_rng(reach)
    target = rng.random((30, 25)) < 0.04
    got, want = TL.squared_distance(target, reach), brute_distance(target)
    near = want <= reach * reach
    assert (got[near] == want[near]).all() and (got[~near] > reach * reach).all()


@pytest.mark.parametrize(("side", "radius"), [(8, 2), (8, 11), (64, 3)])
def test_erosion_over_tile_edges(spark, side, radius):
    rng = np.random.default_rng(side)
    values = rng.choice([0, 1, 1, 1, 1, 1, 1, 255], (21, 19))
    values[4:9, 3:12] = 1
    want = np.where((values == 1) & (brute_distance(values == 0) <= radius * radius), 255, values)
    out = R.erode_boundary(table(spark, values), radius, side=side).collect()
    assert len(out) == values.size and all(want[r.prow, r.pcol] == r.label for r in out)
    grown = {(r.prow, r.pcol) for r in R.dilate(table(spark, values).where("label = 0"), 2, side=64).where("prow < 21 AND pcol < 19").collect()}
    assert grown == {tuple(p) for p in np.argwhere(brute_distance(values == 0) <= 4)}


def test_cells_and_tiles_round_trip(spark, rows):
    df = spark.createDataFrame([(0, 0, 1, 0.5), (3, 9, 2, None), (20, 1, None, 0.25)], "prow int, pcol int, a smallint, p double")
    back = TL.to_cells(TL.from_cells(df.withColumn("seen", F.lit(1)), ["a", "p", "seen"], 8), {"a": "smallint", "p": "double", "seen": "int"}, 8, present="seen")
    assert rows(back, "prow", "pcol", "a", "p") == rows(df)
    assert TL.to_cells(TL.from_cells(df.limit(0), ["a"], 8), {"a": "int"}, 8).count() == 0


@pytest.mark.parametrize("side", [4, 64])
def test_zones_of_polygons_and_rasters(spark, side):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 50, (12, 12))
    px = table(spark, [[None if v > 45 else int(v) for v in row] for row in values], "v").withColumn("x", F.col("v") / 2.0)
    boxes = {1: (0, 0, 7, 5), 2: (3, 3, 12, 12), 3: (30, 30, 40, 40)}
    lots = spark.createDataFrame([(k,) for k in boxes], "bbl bigint")
    geom = None
    for k, b in boxes.items():
        geom = F.when(F.col("bbl") == k, G.box(*b)).otherwise(geom) if geom is not None else F.when(F.col("bbl") == k, G.box(*b))
    lots, grid = lots.withColumn("geom", geom), Grid(12, 12, 0.0, 12.0)
    for levels in (None, 50):
        out = {r.bbl: r for r in zonal.zonal_by_polygon(px, lots, grid, ["v", "x"], levels=levels, side=side).collect()}
        assert set(out) == {1, 2}
        for k, r in out.items():
            x0, y0, x1, y1 = boxes[k]
            own = [int(v) for v in values[12 - y1 : 12 - y0, x0:x1].ravel() if v <= 45]
            assert (r.v_count, r.v_mean, r.v_median, r.v_stdDev) == (len(own), pytest.approx(np.mean(own)), np.median(own), pytest.approx(np.std(own)))
            assert (r.x_count, r.x_mean, r.x_median) == (len(own), pytest.approx(np.mean(own) / 2), np.median(own) / 2)
    scores = px.select("prow", "pcol", (F.col("v") / 50).alias("prob"))
    got = {r.bbl: (r.valid_pixels, r.pred_pixels) for r in zonal.prediction_fraction(lots, scores, grid, pixel_threshold=0.5, min_pixels=0, side=side).collect()}
    for k, (x0, y0, x1, y1) in boxes.items():
        own = [v for v in values[max(0, 12 - y1) : max(0, 12 - y0), x0:x1].ravel() if v <= 45]
        assert got[k] == (len(own), sum(v >= 25 for v in own))


def test_outcomes_by_tile(spark, rows):
    scores = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.1), (0, 2, None), (9, 9, 0.9), (9, 8, 0.2), (5, 5, 0.7)], "prow int, pcol int, prob double")
    mask = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 2, 1), (9, 9, 0), (9, 8, 0)], "prow int, pcol int, label smallint")
    out = scoring.outcome_map(scores, mask, 0.5, side=8)
    want = [(0, 0, "TP"), (0, 1, "FN"), (0, 2, "ignore"), (5, 5, "ignore"), (9, 8, "TN"), (9, 9, "FP")]
    assert rows(out, "prow", "pcol", "outcome") == want


def test_selection_by_digits(spark):
    rng = np.random.default_rng(8)
    values = [*rng.normal(0, 1e6, 200), *rng.normal(0, 1e-300, 50), 0.0, -0.0, math.inf, -math.inf, 1e308, -5e-324, 3.0, 3.0, 3.0]
    df = spark.createDataFrame([(float(v), float(k % 7)) for k, v in enumerate(values)] + [(None, None)], "a double, b double").repartition(3)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = ranking.column_quantiles(df, ["a", "b"], probs)
    for c, own in (("a", sorted(values)), ("b", sorted(float(k % 7) for k in range(len(values))))):
        for p in probs:
            at = p * (len(own) - 1)
            low, high = own[math.floor(at)], own[math.ceil(at)]
            assert got[c][p] == (low if low == high else low + (high - low) * (at - math.floor(at)))


def test_many_kmeans_reach_fixed_points(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in ((0, 0, 0), (4, 0, 1), (0, 5, 2))])
    df = ml.assemble(spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id long, a double, b double, c double").repartition(3), ["a", "b", "c"])
    fitted, sums = ml.fit_many_kmeans(df, [2, 3], restarts=4, key="id")
    for k, model in fitted.items():
        at = ((x[:, None] - model.values) ** 2).sum(-1).argmin(1)
        assert model.inertia == pytest.approx(((x - model.values[at]) ** 2).sum())
        assert np.allclose(model.values, [x[at == c].mean(0) for c in range(k)])
    assert sorted(sums[3]["n"]) == [40, 40, 40]
    d = ((x[:, None] - x) ** 2).sum(-1)
    at = ((x[:, None] - fitted[3].values) ** 2).sum(-1).argmin(1)
    own = []
    for i in range(len(x)):
        a = d[i][at == at[i]].sum() / (np.sum(at == at[i]) - 1)
        b = min(d[i][at == c].mean() for c in range(3) if c != at[i])
        own.append((b - a) / max(a, b))
    assert ml.silhouettes(df, fitted, sums)[3] == pytest.approx(np.mean(own))
    assert ml.fit_many_kmeans(df.limit(1), [2], restarts=2, key="id")[0][2].inertia == 0.0


def test_logistic_folds_are_optimal(spark):
    rng = np.random.default_rng(5)
    rows = [(k, *map(float, rng.normal(size=2)), k % 3) for k in range(90)]
    rows = [(k, a, b, int(a - b + rng.normal() > 0.8), f) for k, a, b, f in rows]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int, fold int").repartition(3)
    models = ml.fit_logistic_folds(df, ["a", "b"], fold="fold")
    assert sorted(models) == [-1, 0, 1, 2]
    for f, m in models.items():
        own = [r for r in rows if r[4] != f]
        x, y = np.array([[a, b, 1.0] for _, a, b, _, _ in own]), np.array([r[3] for r in own])
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
        beta = np.array([*m.coefficients, m.intercept])
        gradient = x.T @ (w * (1 / (1 + np.exp(-x @ beta)) - y)) + np.array([beta[0], beta[1], 0.0])
        assert np.abs(gradient).max() < 1e-6
    assert ml.fit_logistic_folds(df.where("y = 1"), ["a", "b"]) == {}


def test_only_zones_of_several_tiles_have_their_values_counted(spark, monkeypatch):
    px = spark.createDataFrame([(i, j, (i * 5 + j * 3) % 17) for i in range(8) for j in range(8)], "prow int, pcol int, v int")
    boxes = [(1, 0.0, -3.0, 3.0, 0.0), (2, 2.0, -6.0, 6.0, -1.0), (3, 5.0, -7.0, 8.0, -4.0)]
    lots = spark.createDataFrame(boxes, "bbl bigint, x0 double, y0 double, x1 double, y1 double").select("bbl", G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("geom"))
    counted, rank = set(), zonal.weighted_quantiles

    def record(rows, *args, **kwargs):
        counted.update(r.zone for r in rows.select("zone").distinct().collect())
        return rank(rows, *args, **kwargs)

    monkeypatch.setattr(zonal, "weighted_quantiles", record)
    out = {r.bbl: r.v_median for r in zonal.zonal_by_polygon(px, lots, Grid(width=8, height=8), ["v"], levels=17, side=4).collect()}
    want = {k: float(np.median([(i * 5 + j * 3) % 17 for i in range(8) for j in range(8) if x0 < j + 0.5 < x1 and y0 < -(i + 0.5) < y1])) for k, x0, y0, x1, y1 in boxes}
    assert out == want
    assert counted == {2}
