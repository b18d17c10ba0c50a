"""Rasterising, label masks, patches, texture and blending on small grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotgrid.functions import geometry as G
from lotgrid.functions import spectral as SP
from lotgrid.functions.grid import Grid, decode_probability, encode_probability
from lotgrid.operators import patches as PT
from lotgrid.operators import raster as R
from lotgrid.operators import scoring, texture, zonal
from lotgrid.schemas import GEOM

GRID = Grid(width=6, height=6, x0=0.0, y0=6.0)


def shape(spark, key, geom):
    return spark.range(1).select(F.lit(key).cast("bigint").alias("bbl"), geom.alias("geom"))


def grid_table(spark, values, name="label"):
    cells = [(i, j, int(v)) for i, row in enumerate(values) for j, v in enumerate(row)]
    return spark.createDataFrame(cells, f"prow int, pcol int, {name} smallint")


def to_array(df, name="label", fill=-1, shape=(6, 6)):
    out = np.full(shape, fill)
    for r in df.collect():
        out[r["prow"], r["pcol"]] = r[name]
    return out


def test_box_hole_and_abutting_edges(spark):
    assert R.polygon_cells(shape(spark, 1, G.box(1, 1, 4, 4)), GRID).count() == 9
    ringed = G.polygon([(0, 0), (5, 0), (5, 5), (0, 5)], [(1, 1), (4, 1), (4, 4), (1, 4)])
    assert R.polygon_cells(shape(spark, 1, ringed), GRID).count() == 16
    # A border through the cell centres: every centre belongs to exactly one side.
    left, right = G.box(0, 0, 2.5, 6), G.box(2.5, 0, 6, 6)
    cells = R.polygon_cells(shape(spark, 1, left).union(shape(spark, 2, right)), GRID)
    assert cells.count() == 36 and cells.select("prow", "pcol").distinct().count() == 36


def test_later_shape_wins_and_outside_is_clipped(spark):
    both = shape(spark, 1, G.box(-3, -3, 4, 9)).union(shape(spark, 2, G.box(2, 2, 20, 20)))
    out = to_array(R.rasterise(both, GRID, "bbl", "bbl"), "bbl", 0)
    assert (out[:4, 2:] == 2).all() and (out[4:, :4] == 1).all() and (out[4:, 4:] == 0).all()


@pytest.mark.parametrize("seed", range(2))
def test_polygons_match_brute_force(spark, seed):
    """Random star polygons over several row bands, against a per-cell even-odd test."""
    rng = np.random.default_rng(seed)
    size = 200
    angles = np.sort(rng.uniform(0, 2 * np.pi, 17))
    radius = rng.uniform(20, 110, 17)
    pts = [(100 + r * np.cos(a), 100 + r * np.sin(a)) for a, r in zip(angles, radius)]
    grid = Grid(width=size, height=size, x0=0.0, y0=float(size))
    got = {(r.prow, r.pcol) for r in R.polygon_cells(shape(spark, 1, G.polygon(pts)), grid).collect()}
    want = set()
    for i in range(size):
        y = size - (i + 0.5)
        for j in range(size):
            x, inside = j + 0.5, False
            for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1]):
                if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                    inside = not inside
            if inside:
                want.add((i, j))
    assert got == want
    points = spark.createDataFrame([(i, j, j + 0.5, size - i - 0.5) for i in range(0, size, 3) for j in range(0, size, 3)], "i int, j int, x double, y double")
    joined = R.points_in_polygons(points, shape(spark, 1, G.polygon(pts)))
    assert {(r.i, r.j) for r in joined.collect()} == {(i, j) for i, j in want if i % 3 == 0 and j % 3 == 0}


def test_line_touches_every_cell_it_passes(spark):
    line = F.array(G.point(0.5, 5.5), G.point(5.2, 0.9), G.point(5.2, 0.1))
    got = {(r.prow, r.pcol) for r in R.rasterise_lines(spark.range(1).select(line.alias("geom")), GRID).collect()}
    steps = np.linspace(0, 1, 20001)
    dense = np.concatenate([np.array([0.5, 5.5]) + steps[:, None] * np.array([4.7, -4.6]), np.array([5.2, 0.9]) + steps[:, None] * np.array([0, -0.8])])
    assert got == {(int(6 - y), int(x)) for x, y in dense}


def test_erosion_of_vacant_side_only(spark):
    values = [[1, 1, 1, 1, 0, 0, 0]] * 7
    out = to_array(R.erode_boundary(grid_table(spark, values), 2), shape=(7, 7))
    assert (out[:, :2] == 1).all() and (out[:, 2:4] == 255).all() and (out[:, 4:] == 0).all()
    ignore = [[1, 1, 255, 255]] * 4
    assert (to_array(R.erode_boundary(grid_table(spark, ignore), 2), shape=(4, 4)) == np.array(ignore)).all()
    assert R.erode_boundary(grid_table(spark, values), 0).where("label = 255").count() == 0


def test_burn_order(spark):
    lots = (
        shape(spark, 1, G.box(0, 0, 3, 6)).withColumn("is_vacant", F.lit(True))
        .union(shape(spark, 2, G.box(3, 0, 5, 6)).withColumn("is_vacant", F.lit(True)))
        .union(shape(spark, 3, G.box(5, 0, 6, 1)).withColumn("is_vacant", F.lit(True)))
    )
    ov = spark.createDataFrame([(1, "force_nonvacant")], "bbl bigint, action string")
    roadbed = shape(spark, 9, G.box(0, 0, 1, 6)).select("geom")
    stages = R.label_mask(lots.select("bbl", "is_vacant", "geom"), ov, GRID, min_pixels=2, erosion=1, roadbed=roadbed)
    out = to_array(stages["final"], fill=255)
    assert (out[:, 0] == 255).all() and (out[:, 1:3] == 0).all()
    assert (out[:, 3] == 255).all() and (out[:, 4] == 1).all()  # next to forced lot / kept
    assert (out[:, 5] == 255).all()  # under the size limit, never burned


def test_class_counts_and_borough_counts(spark):
    mask = grid_table(spark, [[1, 0, 0], [255, 1, 0]])
    boro = grid_table(spark, [[1, 1, 2], [1, 2, 2], [3, 3, 3]], "boro_code")
    counts = R.class_counts(mask, "x", 9).first()
    assert (counts.vacant, counts.nonvacant, counts.ignored, counts.vacant_pct) == (2, 3, 4, 40.0)
    per = {r.boro_code: (r.vacant, r.nonvacant, r.ignored, r.vacant_fraction) for r in R.borough_counts(mask, boro).collect()}
    assert per == {1: (1, 1, 1, 0.5), 2: (1, 2, 0, pytest.approx(1 / 3)), 3: (0, 0, 3, 0.0), 4: (0, 0, 0, 0.0), 5: (0, 0, 0, 0.0)}


def test_patch_grid_and_majority(spark, rows):
    values = np.full((10, 10), 255)
    values[0:4, 0:4] = 0  # enough labelled cells
    values[5, 5] = 1  # a single vacant cell keeps its patch
    mask, grid = grid_table(spark, values), Grid(10, 10)
    assert rows(PT.patch_grid(mask, grid, 4, 4, 10), "row_off", "col_off") == [(0, 0), (4, 4)]
    boro = np.zeros((10, 10), dtype=int)
    boro[0:2, 0:4], boro[2:4, 0:4] = 3, 4  # a tie: the smaller code wins
    out = PT.split_patches(mask, grid_table(spark, boro, "boro_code"), grid, PT.borough_to_split([3], [4], []), 4, 4, 10)
    assert rows(out, "row_off", "majority_boro", "split") == [(0, 3, "train"), (4, None, "excluded")]
    assert PT.borough_to_split([1, 3], [3], [3]) == {1: "train", 3: "test"}


@pytest.mark.parametrize("patch,stride", [(4, 4), (4, 2), (6, 4), (5, 3)])
def test_patch_counts_match_windows(spark, patch, stride):
    values = np.random.default_rng(3).integers(0, 2, (23, 19))
    got = {
        (r.row_off, r.col_off): r.n
        for r in PT.patch_counts(grid_table(spark, values), Grid(19, 23), patch, stride, {"n": F.col("label").cast("bigint")}).collect()
    }
    want = {
        (i, j): values[i : i + patch, j : j + patch].sum()
        for i in range(0, 23 - patch + 1, stride)
        for j in range(0, 19 - patch + 1, stride)
    }
    assert got == want


def test_oversample(spark, rows):
    p = spark.createDataFrame([(0, 0, 10), (0, 8, 9)], "row_off int, col_off int, vacant int")
    out = PT.oversample(p, 4, 10)
    assert out.where("col_off = 0").count() == 4 and out.where("is_copy").count() == 3 and out.where("col_off = 8").count() == 1


def test_augmentation_permutes_each_copy(spark):
    cells = spark.range(16).select(
        F.lit(0).alias("row_off"), F.lit(0).alias("col_off"), F.col("id").alias("v"), (F.col("id") / 4).cast("int").alias("i"), (F.col("id") % 4).cast("int").alias("j")
    )
    copies = cells.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.lit(20)))).withColumn("is_copy", F.col("copy_no") > 0)
    out = PT.augment(copies, 4).toPandas()
    base = np.arange(16).reshape(4, 4)
    valid = [np.rot90(f, k) for f in (base, base[:, ::-1]) for k in range(4)]
    seen = set()
    for copy, part in out.groupby("copy_no"):
        image = np.full((4, 4), -1)
        image[part.i, part.j] = part.v
        match = [k for k, v in enumerate(valid) if (v == image).all()]
        assert match, image
        seen.add(match[0])
        assert copy or match == [0]
    assert len(seen) > 3


def test_reservoir_sizes_and_labels(spark):
    mask = grid_table(spark, np.random.default_rng(0).choice([0, 1, 255], (40, 40)))
    n = {r["label"]: r["count"] for r in mask.groupBy("label").count().collect()}
    out = PT.reservoir_pixels(mask, 50, 10_000)
    got = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert got == {1: 50, 0: n[0]}
    w = {r["label"]: r for r in PT.class_weights(PT.reservoir_report(mask, out)).collect()}
    assert w[1]["class_weight"] == pytest.approx(n[1] / 50) and w[0]["scale_pos_weight"] == pytest.approx(1.0 / (n[1] / 50))


def test_indices_at_the_ends(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (255, 255, 255, 255), (10, 20, 30, 200), (0, 0, 61, 200), (0, 0, 60, 200)], "r int, g int, b int, n int")
    zero, full, mixed, low, high = SP.feature_stack(df).collect()
    assert (zero.NDVI, zero.SAVI, zero.EVI, zero.GNDVI, zero.Brightness) == (0.5, 0.5, 0.5, 0.5, 0.0)
    assert (full.NDVI, full.Brightness, full.BareSoilProxy) == (0.5, 1.0, 0.5)
    r, g, b, n = 10 / 255, 20 / 255, 30 / 255, 200 / 255
    assert mixed.NDVI == pytest.approx(((n - r) / (n + r) + 1) / 2, abs=1e-6)
    assert mixed.SAVI == pytest.approx((1.5 * (n - r) / (n + r + 0.5) + 1) / 2, abs=1e-6)
    evi = 2.5 * (n - r) / (n + 6 * r - 7.5 * b + 1)
    assert mixed.EVI == pytest.approx((min(1, max(-1, evi)) + 1) / 2, abs=1e-6)
    assert (low.EVI, high.EVI) == (0.0, 1.0)


def test_missing_values_stay_missing(spark):
    df = spark.createDataFrame([(None,), (0.5,), (2.0,)], "p double")
    got = [tuple(r) for r in df.select(encode_probability(F.col("p")), SP.clamp(F.col("p"))).collect()]
    assert got == [(255, None), (127, 0.5), (254, 1.0)]
    assert spark.range(1).select(decode_probability(F.lit(255)), decode_probability(F.lit(127))).first()[:] == (0.0, 0.5)


@pytest.mark.parametrize("tile", [4, 16])
def test_texture_against_direct_counts(spark, tile):
    values = np.random.default_rng(1).integers(0, 5, (9, 11))
    present = np.ones_like(values, dtype=bool)
    present[4, 5] = False
    cells = [(i, j, int(values[i, j])) for i in range(9) for j in range(11) if present[i, j]]
    px = spark.createDataFrame(cells, "prow int, pcol int, n int")
    got = {(r.prow, r.pcol): r for r in texture.glcm_texture(px, "n", k=1, tile=tile).collect()}
    assert len(got) == 98
    for (i, j), r in got.items():
        per = []
        for di, dj in texture.DIRECTIONS:
            pairs = {}
            for a in range(i - 1, i + 2):
                for b in range(j - 1, j + 2):
                    c, d = a + di, b + dj
                    if not (abs(c - i) <= 1 and abs(d - j) <= 1):
                        continue
                    if all(0 <= p < 9 and 0 <= q < 11 and present[p, q] for p, q in ((a, b), (c, d))):
                        for key in ((values[a, b], values[c, d]), (values[c, d], values[a, b])):
                            pairs[key] = pairs.get(key, 0) + 1
            total = sum(pairs.values())
            if total:
                p = {k: v / total for k, v in pairs.items()}
                per.append((sum(v * v for v in p.values()), sum(v * (a - b) ** 2 for (a, b), v in p.items()), -sum(v * np.log(v) for v in p.values())))
        want = np.mean(per, axis=0)
        assert (r.asm, r.contrast, r.entropy) == (pytest.approx(want[0]), pytest.approx(want[1]), pytest.approx(want[2]))


def test_bilinear_up_and_down(spark):
    values = np.arange(12).reshape(3, 4) * 10
    up = R.resample_bilinear(grid_table(spark, values, "v"), "v", 3, 4, 2)
    got = np.zeros((6, 8))
    for r in up.collect():
        got[r.prow, r.pcol] = r.v

    def axis(n):
        pos = np.clip((np.arange(2 * n) + 0.5) / 2 - 0.5, 0, None)
        lo = np.minimum(np.floor(pos).astype(int), n - 1)
        return lo, np.minimum(lo + 1, n - 1), pos - lo

    (r0, r1, fr), (c0, c1, fc) = axis(3), axis(4)
    top = values[r0][:, c0] * (1 - fc) + values[r0][:, c1] * fc
    bottom = values[r1][:, c0] * (1 - fc) + values[r1][:, c1] * fc
    assert np.allclose(got, top * (1 - fr)[:, None] + bottom * fr[:, None])
    down = R.resample_bilinear(up, "v", 6, 8, 1, 2)
    assert down.count() == 12


def patch_scores(spark, origins, size, prob):
    cells = [(r, c, i, j, prob(r, c, i, j)) for r, c in origins for i in range(size) for j in range(size)]
    return spark.createDataFrame(cells, "row_off int, col_off int, i int, j int, prob double")


def test_blend_of_a_constant_and_the_corner(spark):
    constant = scoring.blend_hann(patch_scores(spark, [(0, 0), (0, 2)], 4, lambda *a: 0.4), 4)
    assert all(r.prob == pytest.approx(0.4) for r in constant.collect()) and constant.count() == 24
    varied = scoring.blend_hann(patch_scores(spark, [(0, 0), (0, 2)], 4, lambda r, c, i, j: (c + i + j) / 10), 4)
    assert {(r.prow, r.pcol): r.prob for r in varied.collect()}[0, 0] == pytest.approx(0.0)
    w = np.maximum(np.outer(np.hanning(4), np.hanning(4)), 1e-3)
    cell = {(r.prow, r.pcol): r.prob for r in varied.collect()}[1, 2]
    assert cell == pytest.approx((w[1, 2] * 0.3 + w[1, 0] * 0.3) / (w[1, 2] + w[1, 0]))


def test_building_blend_window(spark):
    out = scoring.blend_buildings(patch_scores(spark, [(0, 0), (0, 2)], 4, lambda r, c, i, j: (c * 3 + i + j) / 20), 4)
    w = np.maximum(np.outer(np.hanning(6)[1:-1], np.hanning(6)[1:-1]), 0.05)
    got = {(r.prow, r.pcol): (r.prob, r.prob_byte) for r in out.collect()}
    p = (w[1, 3] * 4 / 20 + w[1, 1] * 8 / 20) / (w[1, 3] + w[1, 1])
    assert got[1, 3] == (pytest.approx(p), int(p * 254 + 0.5))


def test_prediction_fraction_skips_unscored_cells(spark):
    lots = shape(spark, 1, G.box(0, 0, 3, 3)).union(shape(spark, 2, G.box(3, 0, 5, 2))).union(shape(spark, 3, G.box(0, 4, 6, 6)))
    probs = [(i, j, None if (i, j) in ((3, 0), (3, 1)) else 0.5 if (i, j) in ((4, 0), (4, 1), (5, 2)) else 0.1) for i in range(3, 6) for j in range(6)]
    scores = spark.createDataFrame(probs, "prow int, pcol int, prob double")
    out = zonal.prediction_fraction(lots, scores, GRID, pixel_threshold=0.5, min_pixels=0).orderBy("bbl").collect()
    assert [(r.bbl, r.valid_pixels, r.pred_pixels) for r in out] == [(1, 7, 3), (2, 4, 0), (3, 0, 0)]
    assert out[0].pred_fraction == pytest.approx(3 / 7) and out[2].pred_fraction is None
    assert [r.bbl for r in zonal.prediction_fraction(lots, scores, GRID, min_pixels=5).collect()] == [1]


def test_zonal_medians_of_wide_and_narrow_bands_agree(spark):
    rng = np.random.default_rng(2)
    px = spark.createDataFrame([(i, j, int(v)) for (i, j), v in np.ndenumerate(rng.integers(0, 200, (6, 6)))], "prow int, pcol int, r smallint")
    px = px.withColumn("x", F.col("r").cast("double"))
    lots = shape(spark, 1, G.box(0, 0, 3, 3)).union(shape(spark, 2, G.box(1, 1, 6, 5)))
    for r in zonal.zonal_by_polygon(px, lots, GRID, ["r", "x"]).collect():
        assert r.r_median == r.x_median and r.r_mean == r.x_mean and r.r_count == r.x_count
    raster, ids = R.parcel_raster(lots, GRID)
    subset = ids.where("bbl = 2").select("parcel_id")
    only = zonal.zonal_by_raster(px, raster, ["r"], subset=subset).collect()
    assert [(r.parcel_id, r.r_count) for r in only] == [(2, 20)]


def test_empty_and_missing_shapes_cover_nothing(spark):
    df = shape(spark, 1, F.lit(None).cast(GEOM)).union(shape(spark, 2, F.array().cast(GEOM))).union(shape(spark, 3, G.box(8, 8, 9, 9)))
    assert R.polygon_cells(df, GRID).count() == 0


def test_mode_composite_tie_takes_smaller_class(spark, rows):
    df = spark.createDataFrame([(0, 0, 3), (0, 0, 1), (0, 1, 2), (0, 1, 2), (0, 1, 1)], "prow int, pcol int, class int")
    assert rows(R.mode_composite(df, "class")) == [(0, 0, 1), (0, 1, 2)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shapes_with_made_geometry_do_not_pass_the_driver(spark, rows):
    shapes = spark.range(3).select(F.col("id").alias("bbl"), G.box(F.col("id") * 10.0, F.lit(0.0), F.col("id") * 10.0 + 4, F.lit(4.0)).alias("geom"))
    points = spark.createDataFrame([(1.0, 1.0), (12.0, 3.0), (8.0, 1.0)], "x double, y double")
    joined = R.points_in_polygons(points, shapes)
    assert "Broadcast" not in _plan(joined)
    assert rows(joined.select("x", "bbl")) == [(1.0, 0), (12.0, 1)]


def test_mosaic_deals_no_cells_by_scene(spark, rows):
    data = [("a", "2021-01-01", 0, c, 1) for c in range(4)] + [("b", "2022-01-01", 0, c, 2) for c in range(2)]
    cells = spark.createDataFrame(data, "scene_id string, acq_date string, prow int, pcol int, r int").withColumn("acq_date", F.to_date("acq_date"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = R.mosaic(cells, ["r"])
        assert "SortMergeJoin" not in _plan(out)
        assert rows(out) == [(0, 0, 2), (0, 1, 2), (0, 2, 1), (0, 3, 1)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("num, den", [(2, 1), (1, 2), (3, 2)])
def test_resize_sends_a_cell_to_its_tiles_only(spark, monkeypatch, num, den):
    """Against the definition, on a sparse raster that is cut into small tiles; no cell is spread over its targets."""
    monkeypatch.setattr(R, "RESAMPLE_SIDE", 8)
    h, w, s = 21, 13, num / den
    source = {(i, j): (None if (i + j) % 11 == 0 else float((i * 7 + j * 3) % 10)) for i in range(h) for j in range(w) if (i * 5 + j) % 4 and not (8 <= i < 16 and j >= 4)}
    cells = spark.createDataFrame([(i, j, v) for (i, j), v in source.items()], "prow int, pcol int, v double")
    out = R.resample_bilinear(cells, "v", h, w, num, den)
    assert "Aggregate" not in _plan(out)

    def axis(t, size):
        at = max((t + 0.5) / s - 0.5, 0.0)
        base = min(int(at), size - 1)
        return [(base, 1 - (at - base)), (min(base + 1, size - 1), at - base)]

    want = {}
    for i in range(int(h * s)):
        for j in range(int(w * s)):
            used = [(source[r, c], a * b) for r, a in axis(i, h) for c, b in axis(j, w) if a * b > 0 and (r, c) in source]
            if used:
                known = [v * k for v, k in used if v is not None]
                want[i, j] = round(sum(known), 9) if known else None
    assert {(r.prow, r.pcol): None if r.v is None else round(r.v, 9) for r in out.collect()} == want
