"""Spectral functions, raster algebra, zonal statistics and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotgrid.functions import grid as GR
from lotgrid.functions import spectral as SP
from lotgrid.functions.grid import Grid
from lotgrid.operators import patches as PT
from lotgrid.operators import raster as R
from lotgrid.operators import zonal
from lotgrid.operators.texture import MEASURES, glcm_texture
from lotgrid.plans.inputs import VACANT_CODES, WIDTH, Inputs
from lotgrid.plans.registry import query
from lotgrid.plans.sql_views import hash_sql

# ---------------------------------------------------------------- per-pixel functions (X)

_FEATURES_SQL = """round(R0, 6) AS "R", round(G0, 6) AS "G", round(B0, 6) AS "B", round(N0, 6) AS "NIR", round(nd2/2, 6) AS "NDVI",
round((greatest(least(sv, 1), -1)+1)/2, 6) AS "SAVI", round(bright, 6) AS "Brightness", round((1-nd2/2)*bright, 6) AS "BareSoilProxy",
round((greatest(least(ev, 1), -1)+1)/2, 6) AS "EVI", round(gn2/2, 6) AS "GNDVI" """


def _rounded(df, columns, keep=()):
    return df.select(*keep, *[F.round(F.col(c), 6).alias(c) for c in columns])


@query("feature_stack_X1_X8", f"SELECT prow, pcol, {_FEATURES_SQL} FROM features", "features")
def _(t: Inputs):
    return _rounded(SP.feature_stack(t.pixels, ["prow", "pcol"]), SP.FEATURES, ["prow", "pcol"])


@query(
    "scaled_bands_X1",
    "SELECT round(sum(r/255.0::DOUBLE), 6) AS r, round(sum(b/255.0::DOUBLE), 6) AS b, sum(g)::BIGINT AS g FROM raster",
    "raster",
)
def _(t: Inputs):
    s = SP.scale_bands(t.pixels, ["r", "b"])
    return s.agg(F.round(F.sum("r"), 6).alias("r"), F.round(F.sum("b"), 6).alias("b"), F.sum("g").alias("g"))


for _name, _sql, _fn in (
    ("ndvi_X2", "nd2/2", lambda r, g, b, n: SP.ndvi(r, n)),
    ("savi_X3", "(greatest(least(sv, 1), -1)+1)/2", lambda r, g, b, n: SP.savi(r, n)),
    ("brightness_X4", "bright/3", lambda r, g, b, n: SP.brightness(r, g, b, normalize=3.0)),
    ("bare_soil_X5", "(1-nd2/2)*bright", SP.bare_soil),
    ("evi_X6", "(greatest(least(ev, 1), -1)+1)/2", lambda r, g, b, n: SP.evi(r, b, n)),
    ("gndvi_X7", "gn2/2", lambda r, g, b, n: SP.gndvi(g, n)),
):

    @query(_name, f"SELECT prow, pcol, round({_sql}, 6) AS value FROM features", "features")
    def _(t: Inputs, fn=_fn):
        return t.pixels.select("prow", "pcol", F.round(fn(*[SP.scale(F.col(c)) for c in "rgbn"]), 6).alias("value"))


@query(
    "imagenet_norm_X9",
    "SELECT prow, pcol, round((R0-0.485)/0.229, 6) AS r, round((G0-0.456)/0.224, 6) AS g, round((B0-0.406)/0.225, 6) AS b FROM features",
    "features",
)
def _(t: Inputs):
    cols = SP.imagenet_normalise(*[SP.scale(F.col(c)) for c in "rgb"])
    return t.pixels.select("prow", "pcol", *[F.round(c, 6).alias(n) for c, n in zip(cols, "rgb")])


@query(
    "probability_bytes_X10",
    """SELECT code, round(CASE WHEN code = 255 THEN 0 ELSE code/254.0 END, 6) AS prob, count(*) AS cells FROM (
    SELECT coalesce(floor(prob*254 + 0.5), 255)::INT AS code FROM score_cells) GROUP BY 1, 2""",
    "score_cells",
)
def _(t: Inputs):
    coded = t.score_cells.select(GR.encode_probability(F.col("prob")).cast("int").alias("code"))
    return coded.withColumn("prob", F.round(GR.decode_probability(F.col("code")), 6)).groupBy("code", "prob").agg(F.count("*").alias("cells"))


@query(
    "pixel_coordinates_X11",
    "SELECT prow, pcol, round(580000.0 + (pcol+0.5)*0.6, 6)::DOUBLE AS x, round(4510000.0 - (prow+0.5)*0.6, 6)::DOUBLE AS y, round(580000.0 + (10+pcol)*0.6, 6)::DOUBLE AS crop_x FROM raster",
    "raster",
)
def _(t: Inputs):
    g = Grid(WIDTH, 1, 580000.0, 4510000.0, 0.6, 0.6)
    placed = t.pixels.select(
        "prow", "pcol", g.centre_x(F.col("pcol")).alias("x"), g.centre_y(F.col("prow")).alias("y"), g.shifted(5, 10).x_of(F.col("pcol")).alias("crop_x")
    )
    return _rounded(placed, ["x", "y", "crop_x"], ["prow", "pcol"])


_GLCM = """, win AS (SELECT c.prow, c.pcol, a.prow AS ai, a.pcol AS aj, a.n AS av FROM raster c JOIN raster a ON a.prow BETWEEN c.prow-1 AND c.prow+1 AND a.pcol BETWEEN c.pcol-1 AND c.pcol+1),
one AS (SELECT w.prow, w.pcol, d, w.av AS i, z.av AS j FROM win w JOIN win z ON w.prow = z.prow AND w.pcol = z.pcol
  JOIN (VALUES (0,0,1),(1,1,1),(2,1,0),(3,1,-1)) dir(d, di, dj) ON z.ai = w.ai + di AND z.aj = w.aj + dj),
pairs AS (SELECT prow, pcol, d, i, j FROM one UNION ALL SELECT prow, pcol, d, j, i FROM one),
p AS (SELECT prow, pcol, d, i, j, count(*)/sum(count(*)) OVER (PARTITION BY prow, pcol, d)::DOUBLE AS p FROM pairs GROUP BY prow, pcol, d, i, j),
m AS (SELECT prow, pcol, d, sum(p*p) AS asm, sum(p*(i-j)*(i-j)) AS contrast, sum(p*abs(i-j)) AS dissimilarity, -sum(p*ln(p)) AS entropy, sum(p/(1+(i-j)*(i-j))) AS homogeneity FROM p GROUP BY ALL)
SELECT prow, pcol, round(avg(asm), 6) AS asm, round(avg(contrast), 6) AS contrast, round(avg(dissimilarity), 6) AS dissimilarity, round(avg(entropy), 6) AS entropy,
round(avg(homogeneity), 6) AS homogeneity FROM m GROUP BY ALL"""


@query("glcm_texture_X12", "WITH " + _GLCM[2:], "raster")
def _(t: Inputs):
    return _rounded(glcm_texture(t.pixels, "n", k=1), MEASURES, ["prow", "pcol"])


# ---------------------------------------------------------------- polygons to cells


def tagged_lots(t: Inputs):
    code = F.col("bldg_class")
    return t.lots.select("bbl", code.isin(VACANT_CODES).alias("is_vacant"), "geom")


def _mask_layers(t: Inputs) -> dict:
    return {"min_pixels": 12, "erosion": 2, "water": t.water, "roads": t.roads.drop("mtfcc", "county"), "roadbed": t.roadbed}


def full_mask(t: Inputs):
    return R.label_mask(tagged_lots(t), t.overrides, t.grid, **_mask_layers(t))


def mask_tiles(t: Inputs):
    return R.label_tiles(tagged_lots(t), t.overrides, t.grid, **_mask_layers(t))


@query(
    "points_in_polygons_J5",
    "SELECT bbl, count(*) AS points FROM lot_cells JOIN raster USING (prow, pcol) GROUP BY 1",
    "lot_cells raster",
)
def _(t: Inputs):
    pts = t.pixels.select((F.col("pcol") + 0.5).alias("x"), (-(F.col("prow") + 0.5)).alias("y"))
    return R.points_in_polygons(pts, t.lots.select("bbl", "geom")).groupBy("bbl").agg(F.count("*").alias("points"))


@query("rasterise_R1", "SELECT prow, pcol, max(bbl) AS bbl FROM lot_cells GROUP BY 1, 2", "lot_cells")
def _(t: Inputs):
    return R.rasterise(t.lots.select("bbl", "geom"), t.grid, "bbl", "bbl")


@query(
    "parcel_id_raster_R2",
    "SELECT prow, pcol, max(parcel_id) AS parcel_id FROM lot_cells JOIN (SELECT bbl, row_number() OVER (ORDER BY bbl) AS parcel_id FROM lots) USING (bbl) GROUP BY 1, 2",
    "lot_cells",
)
def _(t: Inputs):
    return R.parcel_raster(t.lots.select("bbl", "geom"), t.grid)[0]


@query(
    "raster_extent_R2",
    """SELECT min(xl) AS x0, max(yl+side) AS y0, 2.0::DOUBLE AS dx, 2.0::DOUBLE AS dy, ceil((max(xl+side)-min(xl))/2)::INT AS width, ceil((max(yl+side)-min(yl))/2)::INT AS height FROM lots""",
    "lots",
)
def _(t: Inputs):
    return R.raster_extent(t.lots.select("geom"), 2.0)


@query("road_cells_R3", "SELECT prow, pcol FROM road_cells", "road_cells")
def _(t: Inputs):
    return R.rasterise_lines(t.roads, t.grid)


@query("label_burn_R4", "SELECT prow, pcol, label FROM burned", "burned")
def _(t: Inputs):
    return full_mask(t)["burned"]


@query("label_mask_R4", "SELECT prow, pcol, label FROM masked", "masked")
def _(t: Inputs):
    return full_mask(t)["final"]


@query("label_erosion_R5_J9", "SELECT prow, pcol, label FROM eroded", "eroded")
def _(t: Inputs):
    return full_mask(t)["eroded"]


@query("borough_raster_R6", "SELECT prow, pcol, (pcol // 26 + 1)::INT AS boro_code FROM allcells", "allcells")
def _(t: Inputs):
    return R.borough_raster(t.counties, t.grid)


_COUNT = "count(*) FILTER (label = 1) AS vacant, count(*) FILTER (label = 0) AS nonvacant, (SELECT height*width FROM dims) - count(*) FILTER (label IN (0, 1)) AS ignored, coalesce(100.0*count(*) FILTER (label = 1)/nullif(count(*) FILTER (label IN (0,1)), 0), 0) AS pct"


@query(
    "mask_step_counts_R7",
    "SELECT step, vacant, nonvacant, ignored, round(pct, 6) AS vacant_pct FROM ("
    + " UNION ALL ".join(f"SELECT '{s}' AS step, {_COUNT} FROM {v}" for s, v in (("burned", "burned"), ("eroded", "eroded"), ("final", "masked")))
    + ")",
    "masked",
)
def _(t: Inputs):
    cells = t.height * WIDTH
    steps = [R.class_counts(m, step, cells) for step, m in full_mask(t).items()]
    out = steps[0].unionByName(steps[1]).unionByName(steps[2])
    return out.withColumn("vacant_pct", F.round("vacant_pct", 6))


_BORO = """SELECT d.boro_code, d.borough, count(*) FILTER (label = 1) AS vacant, count(*) FILTER (label = 0) AS nonvacant, count(*) FILTER (label = 255) AS ignored
FROM boroughs d LEFT JOIN raster m USING (boro_code) GROUP BY 1, 2"""


@query("borough_counts_R8_J7", f"SELECT *, round(coalesce(vacant/nullif(vacant+nonvacant, 0), 0), 6) AS vacant_fraction FROM ({_BORO})", "raster boroughs")
def _(t: Inputs):
    return R.borough_counts(t.tiles, t.tiles).withColumn("vacant_fraction", F.round("vacant_fraction", 6))


@query(
    "mask_diff_R9",
    f"""SELECT o.boro_code, o.borough, n.vacant - o.vacant AS vacant_diff, n.nonvacant - o.nonvacant AS nonvacant_diff, n.ignored - o.ignored AS ignored_diff
    FROM ({_BORO}) o JOIN (SELECT boro_code, count(*) FILTER (label = 1) AS vacant, count(*) FILTER (label = 0) AS nonvacant, count(*) FILTER (coalesce(label, 255) = 255) AS ignored
    FROM (SELECT r.boro_code, m.label FROM raster r LEFT JOIN burned m USING (prow, pcol)) GROUP BY 1) n USING (boro_code)""",
    "raster boroughs burned",
)
def _(t: Inputs):
    burned = mask_tiles(t).select("trow", "tcol", F.col("burned").alias("label"))
    return R.mask_diff(t.tiles, burned, t.tiles)


# ---------------------------------------------------------------- land cover, mosaics, composites

_LC = {0: "Water", 1: "Open", 2: "Low", 3: "Medium", 4: "High", 5: "Barren"}  # class 6 is unmapped
_CROSS = (
    "SELECT d.boro_code, d.borough, "
    + ", ".join(f"count(*) FILTER (class = {k}) AS \"{v}\"" for k, v in _LC.items())
    + """, count(*) FILTER (class < 6) AS "Total" FROM boroughs d LEFT JOIN (SELECT r.boro_code, class FROM raster r JOIN landcover ON lc_row = prow//5 AND lc_col = pcol//5 WHERE label = 1) USING (boro_code) GROUP BY 1, 2"""
)


def crosstab(t: Inputs):
    return R.land_cover_crosstab(t.mask, t.boro, t.landcover, _LC, t.grid, t.coarse_grid)


@query("land_cover_crosstab_R10_J8", _CROSS, "raster landcover boroughs")
def _(t: Inputs):
    return crosstab(t)


@query(
    "land_cover_proportions_R11",
    f"""SELECT borough, class_name, round(cells/"Total", 3) AS proportion FROM (SELECT * FROM ({_CROSS}) UNPIVOT (cells FOR class_name IN ({", ".join(f'"{v}"' for v in _LC.values())}))) WHERE "Total" > 0""",
    "raster landcover boroughs",
)
def _(t: Inputs):
    return R.proportion_table(crosstab(t), _LC.values()).where(F.col("proportion").isNotNull())


@query(
    "mosaic_R12",
    """SELECT prow, pcol, arg_max(r, k) AS r, arg_max(g, k) AS g, arg_max(b, k) AS b, arg_max(n, k) AS n FROM
    (SELECT *, acq_date AS k FROM scenes WHERE acq_date <> DATE '2022-08-02') GROUP BY 1, 2""",
    "scenes",
)
def _(t: Inputs):
    return R.mosaic(t.scenes, ["r", "g", "b", "n"], excluded_dates=["2022-08-02"])


@query(
    "collection_mosaic_S6",
    """SELECT prow, pcol, arg_max(r, acq_date) AS r, arg_max(n, acq_date) AS n FROM scenes WHERE acq_date >= DATE '2022-01-01' AND acq_date < DATE '2023-01-01'
    AND pcol >= 10 AND pcol < 70 GROUP BY 1, 2""",
    "scenes",
)
def _(t: Inputs):
    window = {"row_lo": 0, "row_hi": t.height, "col_lo": 10, "col_hi": 70}
    start, end = (F.lit(d).cast("date") for d in ("2022-01-01", "2023-01-01"))
    return R.load_mosaic(t.scenes, ["r", "n"], start=start, end=end, window=window)


@query("merge_first_R13", "SELECT prow, pcol, arg_min(r, acq_date) AS r, arg_min(g, acq_date) AS g FROM scenes GROUP BY 1, 2", "scenes")
def _(t: Inputs):
    return R.merge_first(t.scenes, ["r", "g"], "acq_date")


@query(
    "mode_composite_R14",
    """SELECT prow, pcol, arg_max(class, (n, -class)) AS class FROM (SELECT prow, pcol, r % 7 AS class, count(*) AS n FROM scenes
    WHERE acq_date >= DATE '2021-01-01' AND acq_date < DATE '2023-01-01' GROUP BY ALL) GROUP BY 1, 2""",
    "scenes",
)
def _(t: Inputs):
    classed = t.scenes.withColumn("class", (F.col("r") % 7).cast("int"))
    start, end = (F.lit(d).cast("date") for d in ("2021-01-01", "2023-01-01"))
    return R.mode_composite(classed, "class", date="acq_date", start=start, end=end)


_PALETTE = {1: (228, 26, 28), 2: (55, 126, 184), 3: (77, 175, 74), 4: (152, 78, 163), 5: (255, 127, 0)}


@query(
    "colour_raster_R15",
    "SELECT prow, pcol, category, CASE category "
    + " ".join(f"WHEN {k} THEN {v[0]}" for k, v in _PALETTE.items())
    + " END AS red, CASE category "
    + " ".join(f"WHEN {k} THEN {v[1]}" for k, v in _PALETTE.items())
    + " END AS green, CASE category "
    + " ".join(f"WHEN {k} THEN {v[2]}" for k, v in _PALETTE.items())
    + " END AS blue FROM (SELECT prow, pcol, max(category) AS category FROM lot_cells GROUP BY 1, 2)",
    "lot_cells",
)
def _(t: Inputs):
    return R.colour_raster(t.lots.select("category", "geom"), t.grid, "category", _PALETTE).select("prow", "pcol", "category", "red", "green", "blue")


@query(
    "parcel_raster_stats_R16",
    """SELECT (height*width)::BIGINT AS total_pixels, valid_pixels, height*width - valid_pixels AS nodata_pixels, unique_parcels, min_parcel_id, max_parcel_id FROM dims,
    (SELECT count(*) AS valid_pixels, count(DISTINCT id) AS unique_parcels, min(id) AS min_parcel_id, max(id) AS max_parcel_id FROM (SELECT max(bbl) AS id FROM lot_cells GROUP BY prow, pcol))""",
    "lot_cells",
)
def _(t: Inputs):
    px = R.rasterise(t.lots.select(F.col("bbl").alias("parcel_id"), "geom"), t.grid, "parcel_id", "parcel_id")
    return R.parcel_raster_stats(px, WIDTH, t.height)


def _bilinear(source: str, height: str, width: str, s: float) -> str:
    axis = "greatest((t + 0.5)/{s} - 0.5, 0)"
    pos_r, pos_c = axis.format(s=s).replace("t +", "tr +"), axis.format(s=s).replace("t +", "tc +")
    return f"""SELECT tr AS prow, tc AS pcol, round((1-fr)*((1-fc)*a.v + fc*b.v) + fr*((1-fc)*c.v + fc*d.v), 6) AS v FROM (
    SELECT tr, tc, floor(pr)::INT AS r0, least(floor(pr) + 1, h - 1)::INT AS r1, pr - floor(pr) AS fr, floor(pc)::INT AS c0, least(floor(pc) + 1, w - 1)::INT AS c1, pc - floor(pc) AS fc FROM (
    SELECT tr::INT AS tr, tc::INT AS tc, {pos_r} AS pr, {pos_c} AS pc, {height} AS h, {width} AS w FROM dims, unnest(range(({height}*{s})::BIGINT)) AS x(tr), unnest(range(({width}*{s})::BIGINT)) AS y(tc)))
    JOIN {source} a ON a.prow = r0 AND a.pcol = c0 JOIN {source} b ON b.prow = r0 AND b.pcol = c1 JOIN {source} c ON c.prow = r1 AND c.pcol = c0 JOIN {source} d ON d.prow = r1 AND d.pcol = c1"""


# The last raster row may be partial, so both engines resample a full rectangle: absent cells read 0.
_FULL = "full_px AS (SELECT prow, pcol, coalesce(n, 0) AS v FROM allcells LEFT JOIN raster USING (prow, pcol))"


def _full_band(t: Inputs):
    """The near-infrared band on every cell of the rectangle."""
    cells = t.spark.range(0, t.n_rows).select(F.col("id").cast("int").alias("prow")).select(
        "prow", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("pcol")
    )
    return cells.join(t.pixels.select("prow", "pcol", "n"), ["prow", "pcol"], "left").select("prow", "pcol", F.coalesce("n", F.lit(0)).alias("v"))


@query("resample_up_R17", f"WITH {_FULL} " + _bilinear("full_px", "height", "width", 2), "raster allcells")
def _(t: Inputs):
    return R.resample_bilinear(_full_band(t), "v", t.height, WIDTH, 2).withColumn("v", F.round("v", 6))


@query(
    "resample_down_R17",
    f"WITH {_FULL}, up AS ({_bilinear('full_px', 'height', 'width', 2)}) " + _bilinear("up", "height*2", "width*2", 0.5),
    "raster allcells",
)
def _(t: Inputs):
    up = R.resample_bilinear(_full_band(t), "v", t.height, WIDTH, 2).withColumn("v", F.round("v", 6))
    return R.resample_bilinear(up, "v", t.height * 2, WIDTH * 2, 1, 2).withColumn("v", F.round("v", 6))


_ZONAL_COLS = ", ".join(f"round(avg({b}), 6) AS {b}_mean, round(stddev_pop({b}), 6) AS \"{b}_stdDev\", count({b}) AS {b}_count" for b in "rn")


@query(
    "zonal_by_raster_R18",
    f"SELECT parcel_id, {_ZONAL_COLS} FROM raster JOIN (SELECT prow, pcol, max(bbl) AS parcel_id FROM lot_cells GROUP BY 1, 2) USING (prow, pcol) GROUP BY 1",
    "raster lot_cells",
)
def _(t: Inputs):
    px = R.rasterise(t.lots.select(F.col("bbl").alias("parcel_id"), "geom"), t.grid, "parcel_id", "parcel_id")
    z = zonal.zonal_by_raster(t.tiles, px, ["r", "n"], levels=256)
    return z.select("parcel_id", *[(F.round(c, 6) if not c.endswith("count") else F.col(c)).alias(c) for c in z.columns if c != "parcel_id"])


@query(
    "zonal_by_polygon_R19",
    "SELECT bbl, "
    + ", ".join(
        f"round(avg({b}), 6) AS {b}_mean, round(stddev_pop({b}), 6) AS \"{b}_stdDev\", quantile_cont({b}, 0.5)::DOUBLE AS {b}_median, count({b}) AS {b}_count" for b in "rgbn"
    )
    + " FROM raster JOIN lot_cells USING (prow, pcol) GROUP BY 1",
    "raster lot_cells",
)
def _(t: Inputs):
    z = zonal.zonal_by_polygon(t.tiles, t.lots, t.grid, list("rgbn"), levels=256)
    return z.select("bbl", *[(F.round(c, 6) if c.endswith(("mean", "stdDev")) else F.col(c)).alias(c) for c in z.columns if c != "bbl"])


_OUTCOME = "CASE WHEN label = 1 THEN CASE WHEN prob > 0.5 THEN 'TP' ELSE 'FN' END WHEN label = 0 THEN CASE WHEN prob > 0.5 THEN 'FP' ELSE 'TN' END END"


@query(
    "densest_blocks_R20",
    f"""WITH o AS (SELECT prow, pcol, {_OUTCOME} AS outcome FROM score_cells WHERE prob IS NOT NULL AND label <> 255),
    c AS (SELECT outcome, prow//10 AS brow, pcol//10 AS bcol, count(*) AS cells FROM o GROUP BY ALL),
    p AS (SELECT c.*, row_number() OVER (PARTITION BY outcome ORDER BY cells DESC, brow, bcol)::INT AS density_rank FROM c, dims WHERE brow < height//10 AND bcol < width//10 AND cells > 2)
    SELECT outcome, cells, density_rank, (bcol*10 + 5.5)::DOUBLE AS x, (-(brow*10 + 5.5))::DOUBLE AS y FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY {hash_sql('brow*3000000019+bcol', 42)}, brow, bcol) AS k
    FROM p WHERE density_rank <= 20) WHERE k <= 4""",
    "score_cells dims",
)
def _(t: Inputs):
    from lotgrid.operators.scoring import outcome_map

    outcomes = outcome_map(t.score_tiles, t.tiles, 0.5).where("outcome <> 'ignore' AND prob IS NOT NULL")
    return R.densest_blocks(outcomes, t.grid, 10, 4)


@query(
    "percentile_stretch_R21",
    """WITH q AS (SELECT quantile_cont(r, 0.98) AS qr, quantile_cont(n, 0.98) AS qn FROM raster)
    SELECT prow, pcol, round(least(r/qr, 1), 6) AS r, round(least(n/qn, 1), 6) AS n FROM raster, q""",
    "raster",
)
def _(t: Inputs):
    return _rounded(R.percentile_stretch(t.pixels.select("prow", "pcol", "r", "n"), ["r", "n"]), ["r", "n"], ["prow", "pcol"])


@query(
    "clip_bbox_R22",
    "SELECT prow, pcol, n FROM raster WHERE pcol >= 20 AND pcol < 101 AND prow >= 10 AND prow < 61",
    "raster",
)
def _(t: Inputs):
    return R.clip_bbox(t.pixels.select("prow", "pcol", "n"), t.grid, 20.0, -60.5, 100.25, -10.0)


@query(
    "clip_polygon_R22",
    "SELECT prow, pcol, n FROM raster WHERE (prow, pcol) IN (SELECT (prow, pcol) FROM water_cells)",
    "raster water_cells",
)
def _(t: Inputs):
    return R.clip_polygon(t.pixels.select("prow", "pcol", "n"), t.water, t.grid)


# ---------------------------------------------------------------- patches

_SPLITS = PT.borough_to_split([1, 4], [3], [2])


def split_grid(t: Inputs, patch=8, stride=8, min_valid=40):
    return PT.split_patches(t.mask, t.boro, t.grid, _SPLITS, patch, stride, min_valid)


_PATCHES = """, pc AS (SELECT row_off, col_off, count(*) FILTER (label <> 255) AS labelled, count(*) FILTER (label = 1) AS vacant FROM pw GROUP BY 1, 2),
kept AS (SELECT * FROM pc WHERE labelled >= 40 OR vacant > 0),
votes AS (SELECT row_off, col_off, arg_max(boro_code, (n, -boro_code)) AS majority_boro FROM (SELECT row_off, col_off, boro_code, count(*) AS n FROM pw GROUP BY ALL) GROUP BY 1, 2),
sp AS (SELECT k.*, majority_boro, coalesce(CASE majority_boro WHEN 1 THEN 'train' WHEN 4 THEN 'train' WHEN 3 THEN 'val' WHEN 2 THEN 'test' END, 'excluded') AS split FROM kept k LEFT JOIN votes USING (row_off, col_off)) """
_PW8 = "WITH pw AS (SELECT (prow//8)*8 AS row_off, (pcol//8)*8 AS col_off, r.* FROM raster r, dims WHERE (prow//8)*8 + 8 <= height)"
_PW4 = "WITH pw AS (SELECT row_off, col_off, p.label, boro_code FROM patch_px p JOIN raster USING (prow, pcol))"


@query("patch_grid_D1", _PW8 + _PATCHES + "SELECT row_off, col_off, labelled, vacant FROM kept", "raster dims")
def _(t: Inputs):
    return PT.patch_grid(t.mask, t.grid, 8, 8, 40)


@query("patch_split_D2", _PW8 + _PATCHES + "SELECT row_off, col_off, majority_boro, split FROM sp", "raster dims")
def _(t: Inputs):
    return split_grid(t).select("row_off", "col_off", "majority_boro", "split")


@query("overlap_grid_D3", _PW4 + _PATCHES + "SELECT row_off, col_off, labelled, vacant, split FROM sp", "patch_px raster dims")
def _(t: Inputs):
    return split_grid(t, 8, 4).select("row_off", "col_off", "labelled", "vacant", "split")


@query(
    "split_report_D4",
    _PW8 + _PATCHES + "SELECT split, count(*) AS patches, round(100.0*count(*)/sum(count(*)) OVER (), 6) AS pct FROM sp GROUP BY 1",
    "raster dims",
)
def _(t: Inputs):
    return PT.split_report(split_grid(t)).withColumn("pct", F.round("pct", 6))


@query(
    "split_leaks_D4_W10",
    _PW8 + _PATCHES + "SELECT row_off, col_off, split AS first_split, split AS last_split FROM sp WHERE split <> 'excluded' QUALIFY count(DISTINCT split) OVER (PARTITION BY row_off, col_off) > 1",
    "raster dims",
)
def _(t: Inputs):
    return PT.split_leaks(split_grid(t))


@query(
    "split_leaks_planted_W10",
    _PW8 + _PATCHES + "SELECT row_off, col_off, 'train' AS first_split, 'val' AS last_split FROM sp WHERE split = 'train' AND row_off % 16 = 0",
    "raster dims",
)
def _(t: Inputs):
    # Every second row of training patches is stored a second time, for validation.
    patches = split_grid(t).select("row_off", "col_off", "split")
    again = patches.where("split = 'train' AND row_off % 16 = 0").withColumn("split", F.lit("val"))
    return PT.split_leaks(patches.unionByName(again))


@query(
    "patch_outlines_D5",
    _PW8 + _PATCHES + "SELECT row_off, col_off, split, col_off::DOUBLE AS xmin, -(row_off+8)::DOUBLE AS ymin, (col_off+8)::DOUBLE AS xmax, (0 - row_off)::DOUBLE AS ymax FROM sp",
    "raster dims",
)
def _(t: Inputs):
    return PT.patch_outlines(split_grid(t), t.grid, 8)


@query("split_counts_A12", _PW8 + _PATCHES + "SELECT split, count(*) AS patches FROM sp GROUP BY 1", "raster dims")
def _(t: Inputs):
    return split_grid(t).groupBy("split").agg(F.count("*").alias("patches"))


@query(
    "oversample_D6",
    _PW8 + _PATCHES + "SELECT row_off, col_off, i::INT AS copy_no, i > 0 AS is_copy FROM sp, unnest(range(CASE WHEN vacant >= 10 THEN 4 ELSE 1 END)) AS c(i) WHERE split = 'train'",
    "raster dims",
)
def _(t: Inputs):
    train = split_grid(t).where("split = 'train'")
    return PT.oversample(train, 4, 10).select("row_off", "col_off", "copy_no", "is_copy")


def _patch_copies(t: Inputs):
    copies = PT.oversample(split_grid(t), 4, 10).select("row_off", "col_off", "copy_no", "is_copy")
    cells = PT.covering_patches(t.raster, t.grid, 8, 8)
    ij = cells.withColumns({"i": (F.col("prow") - F.col("row_off")).cast("int"), "j": (F.col("pcol") - F.col("col_off")).cast("int")})
    return ij.join(copies, ["row_off", "col_off"])


def _draw_sql(seed: int) -> str:
    return f"({hash_sql('(' + hash_sql('row_off*3000000019+col_off', seed) + ') + copy_no*7919', seed + 1)} / 4294967296.0::DOUBLE)"


_COPIES = (
    _PW8.replace("r.*", "prow - (prow//8)*8 AS i, pcol - (pcol//8)*8 AS j, r.*")
    + _PATCHES
    + ", cp AS (SELECT row_off, col_off, c::INT AS copy_no FROM kept, unnest(range(CASE WHEN vacant >= 10 THEN 4 ELSE 1 END)) AS x(c)), px AS (SELECT * FROM pw JOIN cp USING (row_off, col_off))"
)


@query(
    "dihedral_augment_D7",
    _COPIES
    + f""", d AS (SELECT row_off, col_off, copy_no, copy_no > 0 AND {_draw_sql(42)} < 0.5 AS h, copy_no > 0 AND {_draw_sql(53)} < 0.5 AS v,
    CASE WHEN copy_no > 0 AND {_draw_sql(65)} < 0.5 THEN floor({_draw_sql(79)}*3) + 1 ELSE 0 END AS turns FROM cp),
    f AS (SELECT px.*, turns, CASE WHEN v THEN 7-i ELSE i END AS fi, CASE WHEN h THEN 7-j ELSE j END AS fj FROM px JOIN d USING (row_off, col_off, copy_no))
    SELECT row_off, col_off, copy_no, label, n, (CASE turns WHEN 1 THEN 7-fj WHEN 2 THEN 7-fi WHEN 3 THEN fj ELSE fi END)::INT AS i,
    (CASE turns WHEN 1 THEN fi WHEN 2 THEN 7-fj WHEN 3 THEN 7-fi ELSE fj END)::INT AS j FROM f""",
    "raster dims",
)
def _(t: Inputs):
    return PT.augment(_patch_copies(t), 8).select("row_off", "col_off", "copy_no", "label", "n", "i", "j")


@query(
    "band_dropout_D8",
    _COPIES
    + f""", u AS (SELECT row_off, col_off, copy_no, {", ".join(f"{_draw_sql(42 + 101 + 13 * k)} AS u{b}" for k, b in enumerate("rgbn"))},
    CASE WHEN {_draw_sql(95)} < 0.4 THEN floor({_draw_sql(109)}*2) + 1 ELSE 0 END AS k FROM cp)
    SELECT row_off, col_off, copy_no, i, j, {", ".join(f"CASE WHEN {' + '.join(f'(u{o} < u{b})::INT' for o in 'rgbn' if o != b)} < u.k THEN 0 ELSE {b} END AS {b}" for b in "rgbn")}
    FROM px JOIN u USING (row_off, col_off, copy_no)""",
    "raster dims",
)
def _(t: Inputs):
    out = PT.band_dropout(_patch_copies(t), list("rgbn"), p=0.4, max_bands=2)
    return out.select("row_off", "col_off", "copy_no", "i", "j", *"rgbn")


@query(
    "patch_features_D9",
    f"""WITH pc AS (SELECT row_off, col_off FROM patch_px GROUP BY 1, 2 HAVING count(*) FILTER (label <> 255) >= 40 OR count(*) FILTER (label = 1) > 0)
    SELECT row_off, col_off, prow, pcol, f.label, {_FEATURES_SQL} FROM features f JOIN patch_px USING (prow, pcol) WHERE (row_off, col_off) IN (SELECT (row_off, col_off) FROM pc)""",
    "features patch_px",
)
def _(t: Inputs):
    kept = PT.patch_grid(t.mask, t.grid, 8, 4, 40)
    return _rounded(
        PT.patch_features(t.pixels, t.mask, kept, t.grid, 8, 4), SP.FEATURES, ["row_off", "col_off", "prow", "pcol", "label"]
    )


_RESERVOIR = f"""SELECT prow, pcol, label FROM (SELECT prow, pcol, label, row_number() OVER (PARTITION BY label ORDER BY {hash_sql('prow*3000000019+pcol', 42)}, prow, pcol) AS k
FROM raster WHERE label <> 255) WHERE k <= CASE label WHEN 1 THEN 1000 ELSE 2500 END"""


def reservoir(t: Inputs):
    return PT.reservoir_pixels(t.mask, 1000, 2500)


@query("pixel_reservoir_D10", _RESERVOIR, "raster")
def _(t: Inputs):
    return reservoir(t)


@query(
    "class_weights_D11",
    f"""WITH s AS (SELECT label, count(*) AS seen FROM raster WHERE label <> 255 GROUP BY 1), k AS (SELECT label, count(*) AS kept FROM ({_RESERVOIR}) GROUP BY 1),
    w AS (SELECT label, seen, kept, seen/kept AS class_weight FROM s JOIN k USING (label))
    SELECT label, seen, kept, round(class_weight, 6) AS class_weight, round((SELECT class_weight FROM w WHERE label = 0)/(SELECT class_weight FROM w WHERE label = 1), 6) AS scale_pos_weight FROM w""",
    "raster",
)
def _(t: Inputs):
    report = PT.reservoir_report(t.mask, reservoir(t))
    w = PT.class_weights(report)
    return w.select("label", "seen", "kept", F.round("class_weight", 6).alias("class_weight"), F.round("scale_pos_weight", 6).alias("scale_pos_weight"))


@query(
    "random_patches_D16",
    _PW8 + _PATCHES + f"SELECT row_off, col_off FROM sp ORDER BY {hash_sql('row_off*3000000019+col_off', 42)}, row_off, col_off LIMIT 12",
    "raster dims",
)
def _(t: Inputs):
    return PT.random_patches(split_grid(t), 12).select("row_off", "col_off")


@query(
    "channel_stats_A11",
    """SELECT (prow//8)*8 AS row_off, (pcol//8)*8 AS col_off, ch AS channel, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM
    (SELECT prow, pcol, unnest(['r','g','b']) AS ch, unnest([(R0-0.485)/0.229, (G0-0.456)/0.224, (B0-0.406)/0.225]) AS v FROM features), dims WHERE (prow//8)*8+8 <= height GROUP BY ALL""",
    "features dims",
)
def _(t: Inputs):
    from lotgrid.operators.summary import channel_stats

    s = channel_stats(_normalised_patches(t), ["row_off", "col_off"], ["r", "g", "b"])
    return s.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


def _normalised_patches(t: Inputs):
    cells = PT.covering_patches(t.pixels, t.grid, 8, 8)
    norm = SP.imagenet_normalise(*[SP.scale(F.col(c)) for c in "rgb"])
    return cells.select("row_off", "col_off", *[c.alias(n) for c, n in zip(norm, "rgb")])


@query(
    "channel_histogram_A11",
    """SELECT (prow//8)*8 AS row_off, (pcol//8)*8 AS col_off, ch AS channel, least(floor((v+3)/(6.0/80)), 79)::INT AS bin, count(*) AS n FROM
    (SELECT prow, pcol, unnest(['r','g','b']) AS ch, unnest([(R0-0.485)/0.229, (G0-0.456)/0.224, (B0-0.406)/0.225]) AS v FROM features), dims WHERE (prow//8)*8+8 <= height AND v BETWEEN -3 AND 3 GROUP BY ALL""",
    "features dims",
)
def _(t: Inputs):
    from lotgrid.operators.summary import channel_histogram

    return channel_histogram(_normalised_patches(t), ["row_off", "col_off"], ["r", "g", "b"], -3.0, 3.0, 80).select("row_off", "col_off", "channel", "bin", "n")
