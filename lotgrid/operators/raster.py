"""Raster work on tables keyed by (prow, pcol).

Polygons are cut into bands of raster rows, shuffled in that compact form, and only
then grow into row spans and cells; no join with the pixel table is needed to know
which cells a polygon covers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotgrid.functions import geometry as G
from lotgrid.functions.attributes import BOROUGHS
from lotgrid.functions.grid import Grid
from lotgrid.functions.spectral import clamp
from lotgrid.operators import tiles as TL
from lotgrid.session import cut_lineage

VACANT, OTHER, IGNORE = 1, 0, 255
CELL = ["prow", "pcol"]


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


# ---------------------------------------------------------------- polygons and lines to cells


BAND_ROWS = 64


def _bands(shapes: DataFrame, grid: Grid, geom: str) -> DataFrame:
    """Shapes cut into bands of raster rows, each with only the edges that reach it.

    The bands are what is shuffled, so a polygon that covers a third of the raster,
    or has very many vertices, is shared by many tasks before it grows into cells.
    """
    keep = [c for c in shapes.columns if c != geom]
    y0, dy = _c(grid.y0), _c(grid.dy)
    # Everything comes from the edges, so the geometry is read once; a null one yields no band.
    shapes_edges = shapes.select(*keep, G.edges(F.col(geom)).alias("_edges"))
    ys = F.transform("_edges", lambda e: e.ay)
    placed = shapes_edges.select(
        *keep,
        "_edges",
        F.greatest(F.ceil((y0 - F.array_max(ys)) / dy - 0.5), F.lit(0)).cast("int").alias("_first"),
        F.least(F.floor((y0 - F.array_min(ys)) / dy - 0.5), _c(grid.height) - 1).cast("int").alias("_last"),
    )
    # A condition inside the generator, not a filter: a filter would be pushed down and
    # repeat the array work of the columns it tests.
    bands = F.when(
        (F.size("_edges") > 0) & (F.col("_first") <= F.col("_last")),
        F.sequence(F.floor(F.col("_first") / BAND_ROWS), F.floor(F.col("_last") / BAND_ROWS)),
    )
    banded = (
        placed.withColumn("_band", F.explode(bands))
        .withColumns(
            {
                "_from": F.greatest("_first", (F.col("_band") * BAND_ROWS).cast("int")),
                "_to": F.least("_last", (F.col("_band") * BAND_ROWS + (BAND_ROWS - 1)).cast("int")),
            }
        )
        .withColumns({"_top": grid.y_of(F.col("_from")), "_bottom": grid.y_of(F.col("_to") + 1)})
    )
    reaching = F.filter("_edges", lambda e: (F.least(e.ay, e.by) <= F.col("_top")) & (F.greatest(e.ay, e.by) >= F.col("_bottom")))
    # A fixed number of partitions: the bands are few bytes, and sized by bytes they would be
    # coalesced into one task just before they grow.
    tasks = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return banded.select(*keep, "_from", "_to", reaching.alias("_edges")).repartition(tasks, F.xxhash64("_from", "_edges"))


def polygon_spans(shapes: DataFrame, grid: Grid, geom: str = "geom") -> DataFrame:
    """Covered column ranges per raster row: shape columns plus prow, col_lo, col_hi.

    A cell is covered when its centre is inside (even-odd, half-open edges).
    """
    keep = [c for c in shapes.columns if c != geom]
    rows = (
        _bands(shapes, grid, geom)
        .select(*keep, "_edges", F.explode(F.sequence("_from", "_to")).alias("prow"))
        .withColumns({"_yc": grid.centre_y(F.col("prow")), "_x0": _c(grid.x0), "_last_col": _c(grid.width) - 1})
    )
    yc, dx = F.col("_yc"), _c(grid.dx)
    crossing = F.filter("_edges", lambda e: (e.ay > yc) != (e.by > yc))
    xs = F.array_sort(F.transform(crossing, lambda e: e.ax + (yc - e.ay) * (e.bx - e.ax) / (e.by - e.ay)))

    def first_centre_from(x: Column) -> Column:
        return F.ceil((x - F.col("_x0")) / dx - 0.5)

    ranges = F.transform(
        F.sequence(F.lit(0), F.size("_xs") - 2, F.lit(2)),
        lambda i: F.struct(
            F.greatest(first_centre_from(F.get("_xs", i)), F.lit(0)).cast("int").alias("col_lo"),
            F.least(first_centre_from(F.get("_xs", i + 1)) - 1, F.col("_last_col")).cast("int").alias("col_hi"),
        ),
    )
    return (
        rows.select(*keep, "prow", "_x0", "_last_col", xs.alias("_xs"))
        .select(*keep, "prow", F.inline(F.when(F.size("_xs") >= 2, ranges)))
        .where("col_lo <= col_hi")
    )


def line_spans(lines: DataFrame, grid: Grid, geom: str = "geom") -> DataFrame:
    """Column ranges of every cell a polyline passes through (all-touched)."""
    keep = [c for c in lines.columns if c != geom]
    y0, dy, x0, dx = _c(grid.y0), _c(grid.dy), _c(grid.x0), _c(grid.dx)
    segments = lines.select(*keep, F.inline(G.ring_edges(F.col(geom))))
    top, bottom = F.greatest("ay", "by"), F.least("ay", "by")
    first = F.greatest(F.floor((y0 - top) / dy), F.lit(0)).cast("int")
    last = F.least(F.floor((y0 - bottom) / dy), _c(grid.height) - 1).cast("int")
    rows = segments.withColumn("prow", F.explode(F.when(first <= last, F.sequence(first, last))))
    # The part of the segment inside the row band, as parameters along the segment.
    rise = F.col("by") - F.col("ay")
    band_top, band_bottom = grid.y_of(F.col("prow")), grid.y_of(F.col("prow") + 1)

    def along(y: Column) -> Column:
        return F.greatest(F.least((y - F.col("ay")) / F.nullif(rise, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))

    run = F.col("bx") - F.col("ax")
    xa = F.when(rise == 0, F.col("ax")).otherwise(F.col("ax") + run * along(band_top))
    xb = F.when(rise == 0, F.col("bx")).otherwise(F.col("ax") + run * along(band_bottom))
    return (
        rows.withColumns(
            {
                "col_lo": F.greatest(F.floor((F.least(xa, xb) - x0) / dx), F.lit(0)).cast("int"),
                "col_hi": F.least(F.floor((F.greatest(xa, xb) - x0) / dx), _c(grid.width) - 1).cast("int"),
            }
        )
        .where("col_lo <= col_hi")
        .select(*keep, "prow", "col_lo", "col_hi")
    )


def span_cells(spans: DataFrame) -> DataFrame:
    """One row per covered cell."""
    keep = [c for c in spans.columns if c not in ("col_lo", "col_hi")]
    return spans.select(*keep, F.explode(F.sequence("col_lo", "col_hi")).alias("pcol"))


def polygon_cells(shapes: DataFrame, grid: Grid, geom: str = "geom") -> DataFrame:
    return span_cells(polygon_spans(shapes, grid, geom))


def burn(cells: DataFrame, value: str, order) -> DataFrame:
    """Each cell takes the value drawn last; a two-phase aggregate on the cell."""
    return cells.groupBy(*CELL).agg(F.max_by(value, order).alias(value))


def rasterise(shapes: DataFrame, grid: Grid, value: str, order: str, geom: str = "geom") -> DataFrame:
    """Polygon raster (prow, pcol, value); cells outside every polygon are absent."""
    cells = polygon_cells(shapes.select(value, *([order] if order != value else []), geom), grid, geom)
    return burn(cells, value, F.col(order))


def rasterise_lines(lines: DataFrame, grid: Grid, geom: str = "geom") -> DataFrame:
    """Distinct cells touched by the lines."""
    spans = line_spans(lines.select(geom), grid, geom).repartition("prow", "col_lo", "col_hi")
    return span_cells(spans).select(*CELL).distinct()


def points_in_polygons(points: DataFrame, shapes: DataFrame, *, x: str = "x", y: str = "y", geom: str = "geom") -> DataFrame:
    """Inner join of free points with the polygons that contain them.

    Each polygon is filed under the power-of-two tiles that match its own size, so it
    meets at most four tiles and a tile holds only polygons about as large as itself.
    Points look into one tile per size that occurs.  It is an ordinary equi-join, which
    adaptive execution splits where points crowd into one tile; the exact test follows.
    The join asks for a merge: edges and tiles are made from a few bytes per shape, by whose
    size Catalyst would take all shapes for small enough to pass through the driver.
    """
    keep = [c for c in shapes.columns if c != geom]
    boxed = shapes.where(F.col(geom).isNotNull()).select(*keep, geom, G.bounds(F.col(geom)).alias("_b"))
    extent = F.greatest(F.col("_b.xmax") - F.col("_b.xmin"), F.col("_b.ymax") - F.col("_b.ymin"))
    level = F.ceil(F.log2(F.greatest(extent, F.lit(1e-6)))).cast("int")
    sized = boxed.select(*keep, G.edges(F.col(geom)).alias("_edges"), "_b", level.alias("_level"))
    # A few dozen at most: one per doubling of polygon size.
    levels = [r[0] for r in sized.select("_level").distinct().collect()]
    side = F.pow(F.lit(2.0), F.col("_level"))

    def tiles(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / side), F.floor(high / side)))

    tiled = sized.withColumn("_tx", tiles(F.col("_b.xmin"), F.col("_b.xmax"))).withColumn("_ty", tiles(F.col("_b.ymin"), F.col("_b.ymax")))
    if not levels:
        levels = [0]
    keyed = points.withColumn("_plevel", F.explode(F.array(*[F.lit(v) for v in sorted(levels)])))
    cell = F.pow(F.lit(2.0), F.col("_plevel"))
    keyed = keyed.withColumns({"_px": F.floor(F.col(x) / cell), "_py": F.floor(F.col(y) / cell)})
    hit = (
        (F.col("_plevel") == F.col("_level"))
        & (F.col("_px") == F.col("_tx"))
        & (F.col("_py") == F.col("_ty"))
        & F.col(x).between(F.col("_b.xmin"), F.col("_b.xmax"))
        & F.col(y).between(F.col("_b.ymin"), F.col("_b.ymax"))
        & G.contains_point(F.col("_edges"), F.col(x), F.col(y))
    )
    return keyed.join(tiled.hint("merge"), hit).select(*points.columns, *keep)


# ---------------------------------------------------------------- parcel id raster


def parcel_ids(parcels: DataFrame, key: str = "bbl") -> DataFrame:
    """(parcel_id, key) with ids 1..N in key order."""
    from lotgrid.operators.ranking import global_row_number

    return global_row_number(parcels.select(key).distinct(), key, "parcel_id").select("parcel_id", key)


def raster_extent(parcels: DataFrame, resolution: float, geom: str = "geom") -> DataFrame:
    """One-row grid covering the parcels: x0, y0, dx, dy, width, height."""
    b = parcels.select(G.bounds(F.col(geom)).alias("b")).agg(
        F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax")
    )
    return b.select(
        F.col("xmin").alias("x0"),
        F.col("ymax").alias("y0"),
        F.lit(float(resolution)).alias("dx"),
        F.lit(float(resolution)).alias("dy"),
        F.ceil((F.col("xmax") - F.col("xmin")) / resolution).cast("int").alias("width"),
        F.ceil((F.col("ymax") - F.col("ymin")) / resolution).cast("int").alias("height"),
    )


def grid_of(extent: DataFrame) -> Grid:
    """Grid whose fields are scalar subqueries over a one-row extent table."""
    row = extent.select(F.struct("*")).scalar()
    return Grid(**{f: row[f] for f in ("width", "height", "x0", "y0", "dx", "dy")})


def parcel_raster(parcels: DataFrame, grid: Grid, key: str = "bbl", geom: str = "geom") -> tuple[DataFrame, DataFrame]:
    """(parcel id raster, id mapping); where parcels overlap the later id stays."""
    ids = parcel_ids(parcels, key)
    shapes = parcels.join(ids, key).select("parcel_id", geom)
    return rasterise(shapes, grid, "parcel_id", "parcel_id", geom), ids


def parcel_raster_stats(parcel_px: DataFrame, width, height) -> DataFrame:
    """Cell counts and id range of a parcel raster.

    Cells are reduced to one row per id first, so no distinct set is gathered in one task.
    """
    per_id = parcel_px.groupBy("parcel_id").agg(F.count("*").alias("_n"))
    total = (_c(width).cast("bigint") * _c(height).cast("bigint")).alias("total_pixels")
    return per_id.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("valid_pixels"),
        F.count("*").alias("unique_parcels"),
        F.min("parcel_id").alias("min_parcel_id"),
        F.max("parcel_id").alias("max_parcel_id"),
    ).select(
        total,
        "valid_pixels",
        (_c(width).cast("bigint") * _c(height).cast("bigint") - F.col("valid_pixels")).alias("nodata_pixels"),
        "unique_parcels",
        "min_parcel_id",
        "max_parcel_id",
    )


# ---------------------------------------------------------------- label mask


def dilate(cells: DataFrame, radius: int, side: int = TL.SIDE) -> DataFrame:
    """Distinct cells within ``radius`` of any given cell, inside the tiles that hold one."""
    tiles = TL.from_cells(cells.select(*CELL).distinct().withColumn("_in", F.lit(VACANT)), ["_in"], side)
    inside = slice(radius, radius + side)

    def grow(given: np.ndarray) -> dict:
        near = TL.squared_distance(given == VACANT, radius) <= radius * radius
        return {"_in": np.where(near, VACANT, TL.ABSENT)[inside, inside]}

    return TL.to_cells(TL.with_halo(tiles, ["_in"], radius, grow, {"_in": "bigint"}, side), {"_in": "int"}, side).select(*CELL)


def erode_boundary(mask: DataFrame, radius: int, side: int = TL.SIDE) -> DataFrame:
    """Vacant cells within ``radius`` of a non-vacant cell become "ignore".

    ``mask`` has cells or tiles, and so has the result.  The distance is exact; tiles meet
    their neighbours' edges in one shuffle.
    """
    if radius <= 0:
        return mask
    eroded = TL.erode(TL.as_tiles(mask, ["label"], side), radius, inner=VACANT, outer=OTHER, value=IGNORE, side=side)
    return eroded if "trow" in mask.columns else TL.to_cells(eroded, {"label": "smallint"}, side)


def pass_spans(parcels: DataFrame, overrides: DataFrame | None, grid: Grid, *, min_pixels: int = 0) -> DataFrame:
    """Row spans of the parcel passes of the label mask: all 1, vacant 2, forced other 3, forced vacant 4.

    ``parcels`` needs bbl, is_vacant, geom.  Later passes win.
    """
    big = parcels.where(G.area(F.col("geom")) >= F.lit(float(min_pixels)) * _c(grid.dx) * _c(grid.dy))
    rank = F.when(F.col("is_vacant"), 2).otherwise(1)
    if overrides is not None:
        marks = overrides.groupBy(F.col("bbl").alias("_mark")).agg(
            F.max(F.when(F.col("action") == "force_nonvacant", 3).when(F.col("action") == "force_vacant", 4)).alias("_forced")
        )
        big = big.join(marks, big["bbl"] == marks["_mark"], "left")
        rank = F.coalesce(F.col("_forced"), rank)
    return polygon_spans(big.select(rank.alias("pass"), "geom"), grid)


PASS_LABELS = {1: OTHER, 2: VACANT, 3: OTHER, 4: VACANT}
COVER_PASS = 9


def label_tiles(
    parcels: DataFrame,
    overrides: DataFrame | None,
    grid: Grid,
    *,
    min_pixels: int = 0,
    erosion: int = 2,
    water: DataFrame | None = None,
    roads: DataFrame | None = None,
    roadbed: DataFrame | None = None,
    side: int = TL.SIDE,
) -> DataFrame:
    """Tiles of the layered label mask with the bands ``burned``, ``eroded`` and ``final``.

    Parcels and overlays reach the tiles as row spans in one shuffle; the erosion's strips
    are the second and last one.
    """
    spans = pass_spans(parcels, overrides, grid, min_pixels=min_pixels)
    for layer in (water, roadbed):
        if layer is not None:
            spans = spans.unionByName(polygon_spans(layer.select("geom"), grid).withColumn("pass", F.lit(COVER_PASS)))
    if roads is not None:
        spans = spans.unionByName(line_spans(roads.select("geom"), grid).withColumn("pass", F.lit(COVER_PASS)))
    painted = TL.burn_passes(spans, PASS_LABELS, "burned", side, cover=COVER_PASS)
    # The band that is eroded travels beside the burned one and the overlay.
    eroded = TL.erode(painted.withColumn("label", F.col("burned")), erosion, inner=VACANT, outer=OTHER, value=IGNORE, side=side, keep=("burned", "covered"))
    final = F.transform(F.arrays_zip("label", "covered"), lambda z: F.when(z["covered"] == 1, F.lit(IGNORE).cast("bigint")).otherwise(z["label"]))
    return eroded.select(*TL.TILE, "burned", F.col("label").alias("eroded"), final.alias("final"))


def label_mask(parcels: DataFrame, overrides: DataFrame | None, grid: Grid, *, side: int = TL.SIDE, **layers) -> dict[str, DataFrame]:
    """Layered label mask; each value of the result has the cells of the mask after that stage.

    The tiles are stored once and read by every stage; see ``label_tiles`` for the arguments.
    """
    tiles = cut_lineage(label_tiles(parcels, overrides, grid, side=side, **layers), "label-tiles")
    return {stage: TL.to_cells(tiles.select(*TL.TILE, F.col(stage).alias("label")), {"label": "smallint"}, side) for stage in ("burned", "eroded", "final")}


def class_counts(mask: DataFrame, step: str | None = None, total_cells=None) -> DataFrame:
    """Vacant, other and ignore cells, and vacant % of labelled.

    Absent cells count as ignore when the raster size is given.
    """
    vacant, other = F.count_if(F.col("label") == VACANT), F.count_if(F.col("label") == OTHER)
    ignore = F.count_if(F.col("label") == IGNORE) if total_cells is None else _c(total_cells).cast("bigint") - vacant - other
    out = mask.agg(vacant.alias("vacant"), other.alias("nonvacant"), ignore.alias("ignored")).withColumn(
        "vacant_pct",
        F.coalesce(100.0 * F.col("vacant") / F.nullif(F.col("vacant") + F.col("nonvacant"), F.lit(0)), F.lit(0.0)),
    )
    return out.withColumn("step", F.lit(step)) if step else out


# ---------------------------------------------------------------- borough statistics


def borough_raster(counties: DataFrame, grid: Grid, code: str = "boro_code") -> DataFrame:
    return rasterise(counties, grid, code, code)


def _boroughs(spark) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("boro_code"), F.lit(v).alias("borough")) for k, v in BOROUGHS.items()])
    return spark.range(1).select(F.inline(rows))


def _with_every_borough(counts: DataFrame, columns) -> DataFrame:
    dim = _boroughs(counts.sparkSession)
    got = counts.withColumnRenamed("boro_code", "_code")
    return dim.join(got, dim["boro_code"] == got["_code"], "left").select(
        "boro_code", "borough", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns]
    )


def borough_counts(mask: DataFrame, boro: DataFrame, side: int = TL.SIDE) -> DataFrame:
    """Vacant, other and ignore cells per borough, every borough listed.

    Both are cells or tiles; one tile table that has both bands may be given for both.  A
    borough cell without a label is an ignore cell.  Cells are counted tile by tile.
    """
    if mask is boro and "trow" in mask.columns:
        tiles = mask
    else:
        tiles = TL.stack(TL.as_tiles(boro, ["boro_code"], side), TL.as_tiles(mask, ["label"], side), side)
    cells = TL.count_classes(tiles, "boro_code", "label", side)
    counts = cells.groupBy("boro_code").agg(
        F.coalesce(F.sum(F.when(F.col("label") == VACANT, F.col("n"))), F.lit(0)).alias("vacant"),
        F.coalesce(F.sum(F.when(F.col("label") == OTHER, F.col("n"))), F.lit(0)).alias("nonvacant"),
        F.coalesce(F.sum(F.when(F.col("label").isin(IGNORE, TL.ABSENT), F.col("n"))), F.lit(0)).alias("ignored"),
    )
    share = F.coalesce(F.col("vacant") / F.nullif(F.col("vacant") + F.col("nonvacant"), F.lit(0)), F.lit(0.0))
    return _with_every_borough(counts, ["vacant", "nonvacant", "ignored"]).withColumn("vacant_fraction", share)


def mask_diff(old: DataFrame, new: DataFrame, boro: DataFrame) -> DataFrame:
    """New minus old cell counts per borough."""
    a, b = borough_counts(old, boro), borough_counts(new, boro)
    names = ["vacant", "nonvacant", "ignored"]
    before = a.select("boro_code", *[F.col(c).alias(f"_{c}") for c in names])
    return b.join(before, "boro_code").select(
        "boro_code", "borough", *[(F.col(c) - F.col(f"_{c}")).alias(f"{c}_diff") for c in names]
    )


def regrid_nearest(cells: DataFrame, fine: Grid, coarse: Grid, names=("lc_row", "lc_col")) -> DataFrame:
    """Add the coarse cell that holds each fine cell's centre."""
    return cells.withColumns(
        {
            names[0]: coarse.row_at(fine.centre_y(F.col("prow"))),
            names[1]: coarse.col_at(fine.centre_x(F.col("pcol"))),
        }
    )


def land_cover_crosstab(
    mask: DataFrame, boro: DataFrame, landcover: DataFrame, classes: dict[int, str], fine: Grid, coarse: Grid
) -> DataFrame:
    """Vacant cells per borough and land-cover class, plus Total over the mapped classes."""
    vacant = regrid_nearest(mask.where(F.col("label") == VACANT).join(boro, CELL), fine, coarse)
    joined = vacant.join(landcover.where(F.col("class").isin(list(classes))), ["lc_row", "lc_col"])
    counts = joined.groupBy("boro_code").agg(
        *[F.count_if(F.col("class") == k).alias(name) for k, name in classes.items()], F.count("*").alias("Total")
    )
    return _with_every_borough(counts, [*classes.values(), "Total"])


def proportion_table(crosstab: DataFrame, classes) -> DataFrame:
    """Long (borough, class, proportion): all-zero classes dropped, rounded to 3 places."""
    long = crosstab.unpivot(["boro_code", "borough", "Total"], list(classes), "class_name", "cells")
    used = Window.partitionBy("class_name")
    return (
        long.withColumn("_used", F.sum("cells").over(used))
        .where("_used > 0")
        .select("borough", "class_name", F.round(F.col("cells") / F.nullif(F.col("Total"), F.lit(0)), 3).alias("proportion"))
    )


# ---------------------------------------------------------------- mosaics and composites


# The aggregates below keep one number per band and one number as the order: states of
# plain numbers are updated in place by the hash aggregate, structs would force a sort.


def mosaic(scene_pixels: DataFrame, bands, *, date: str = "acq_date", excluded_dates=(), tie: str = "scene_id") -> DataFrame:
    """Newest scene on top per cell, excluded dates left out; scenes of one day in a fixed order."""
    kept = scene_pixels
    if excluded_dates:
        kept = kept.where(~F.col(date).isin(list(excluded_dates)))
    # Scenes are few beside their cells; numbered, the order is one integer that no two scenes share.
    # The numbers go to the cells: dealt by scene, all cells of one scene would meet in one task.
    scenes = kept.select(date, tie).distinct()
    order = F.row_number().over(Window.orderBy(date, F.crc32(F.col(tie).cast("binary")), tie))
    numbered = scenes.select(F.col(date).alias("_date"), F.col(tie).alias("_tie"), order.alias("_order"))
    placed = kept.join(F.broadcast(numbered), kept[date].eqNullSafe(numbered["_date"]) & kept[tie].eqNullSafe(numbered["_tie"])).select(*CELL, *bands, "_order")
    return placed.groupBy(*CELL).agg(*[F.max_by(b, "_order").alias(b) for b in bands])


def merge_first(sources: DataFrame, values, order: str) -> DataFrame:
    """First source wins per cell; of rows of equal order that with the smallest values, all from one row."""
    first = sources.groupBy(*CELL).agg(F.min(F.struct(order, *values)).alias("_first"))
    return first.select(*CELL, *[F.col(f"_first.{v}").alias(v) for v in values])


def mode_composite(scenes: DataFrame, value: str, *, cells=None, date: str | None = None, start=None, end=None) -> DataFrame:
    """Most frequent integer value per cell over [start, end); the smallest on ties."""
    cells = list(cells or CELL)
    kept = scenes
    if date is not None:
        kept = kept.where((F.col(date) >= F.lit(start)) & (F.col(date) < F.lit(end)))
    counted = kept.groupBy(*cells, value).agg(F.count("*").alias("_n"))
    return counted.groupBy(*cells).agg(F.max_by(value, F.col("_n") * (1 << 32) - F.col(value)).alias(value))


def load_mosaic(scene_pixels: DataFrame, bands, *, start, end, window: dict | None = None, order: str = "acq_date") -> DataFrame:
    """Date range [start, end), clip, then flatten with the last scene on top."""
    kept = scene_pixels.where((F.col(order) >= F.lit(start)) & (F.col(order) < F.lit(end)))
    if window:
        kept = clip_window(kept, **window)
    return mosaic(kept, bands, date=order)


def colour_raster(shapes: DataFrame, grid: Grid, category: str, palette: dict[int, tuple], background=(255, 255, 255)) -> DataFrame:
    """Category raster coloured by the palette, higher category on top, absent cells background."""
    from lotgrid.functions.attributes import lookup

    known = shapes.where(F.col(category).isin(list(palette)))
    top = rasterise(known, grid, category, category)
    channels = {
        name: F.coalesce(lookup(F.col(category), {k: v[i] for k, v in palette.items()}), F.lit(background[i])).cast("smallint")
        for i, name in enumerate(("red", "green", "blue"))
    }
    return top.withColumns(channels)


def clip_window(cells: DataFrame, row_lo, row_hi, col_lo, col_hi) -> DataFrame:
    """Cells with row_lo <= prow < row_hi and col_lo <= pcol < col_hi (pushed to the scan)."""
    return cells.where(
        (F.col("prow") >= row_lo) & (F.col("prow") < row_hi) & (F.col("pcol") >= col_lo) & (F.col("pcol") < col_hi)
    )


def clip_bbox(cells: DataFrame, grid: Grid, xmin, ymin, xmax, ymax) -> DataFrame:
    """Cells whose square meets the map-coordinate box, limited to the raster."""
    row_lo, row_hi = grid.row_at(_c(ymax)), F.ceil((_c(grid.y0) - _c(ymin)) / _c(grid.dy))
    col_lo, col_hi = grid.col_at(_c(xmin)), F.ceil((_c(xmax) - _c(grid.x0)) / _c(grid.dx))
    return clip_window(
        cells,
        F.greatest(row_lo, F.lit(0)),
        F.least(row_hi, _c(grid.height)),
        F.greatest(col_lo, F.lit(0)),
        F.least(col_hi, _c(grid.width)),
    )


def clip_polygon(cells: DataFrame, shapes: DataFrame, grid: Grid) -> DataFrame:
    """Cells whose centre lies in any of the shapes."""
    return cells.join(polygon_cells(shapes.select("geom"), grid).select(*CELL), CELL, "left_semi")


RESAMPLE_SIDE = 256  # target cells along the edge of one group


def resample_bilinear(cells: DataFrame, value: str, height, width, scale_num: int, scale_den: int = 1) -> DataFrame:
    """Bilinear resize by scale_num/scale_den, half-pixel centres, edges clamped.

    Cells meet by square tile, in one shuffle; those of a tile's first row and column go to
    the tile before as well, which makes every target whose upper left cell it holds.  An
    absent cell counts as 0; a target has a row where any cell it uses has one, and is null
    where all of those are.
    """
    s = scale_num / scale_den
    side = max(1, int(RESAMPLE_SIDE / max(s, 1.0)))

    def targets(tile: int, size: int) -> tuple[np.ndarray, ...]:
        """Targets whose lower source cell lies in the tile, that cell and the next, from the tile's first, and the next one's weight."""
        first, most = tile * side, int(np.floor(size * s))
        low, high = int(np.floor((first + 0.5) * s - 0.5)) - 1, int(np.ceil((first + side + 0.5) * s - 0.5)) + 1
        t = np.arange(max(low, 0), min(high, most - 1) + 1)
        at = np.maximum((t + 0.5) / s - 0.5, 0.0)
        base = np.minimum(np.floor(at), size - 1).astype("i8")
        own = (base >= first) & (base < first + side)
        t, at, base = t[own], at[own], base[own]
        return t, base - first, np.minimum(base + 1, size - 1) - first, at - base

    def resize(part: pa.Table) -> pa.Table:
        trow, tcol, h, w = (part[c][0].as_py() for c in ("trow", "tcol", "_h", "_w"))
        place = part["_at"].to_numpy()
        valid = part["_v"].is_valid().to_numpy()
        shape = (side + 1, side + 1)
        values = np.bincount(place[valid], part["_v"].drop_null().to_numpy(), shape[0] * shape[1]).reshape(shape)
        has_row, has_value = (np.bincount(p, minlength=shape[0] * shape[1]).reshape(shape) > 0 for p in (place, place[valid]))
        rows, r0, r1, fr = targets(trow, h)
        cols, c0, c1, fc = targets(tcol, w)

        def any_of(flag: np.ndarray) -> np.ndarray:
            along = flag[:, c0] | (flag[:, c1] & (fc > 0))
            return along[r0] | (along[r1] & (fr > 0)[:, None])

        def blend(low: np.ndarray, high: np.ndarray, f: np.ndarray) -> np.ndarray:
            return (1.0 - f) * low + np.where(f > 0, f * high, 0.0)

        along = blend(values[:, c0], values[:, c1], fc)
        out = blend(along[r0], along[r1], fr[:, None])
        i, j = np.nonzero(any_of(has_row))
        absent = ~any_of(has_value)[i, j]
        return pa.table({"prow": pa.array(rows[i], pa.int32()), "pcol": pa.array(cols[j], pa.int32()), value: pa.array(out[i, j], pa.float64(), mask=absent)})

    def copies(index: Column) -> Column:
        """The tile of a row or column and its place there, and for a tile's first one also the place after the last of the tile before."""
        own = F.struct(F.floor(index / side).cast("int").alias("t"), (index % side).cast("int").alias("k"))
        before = F.struct((F.floor(index / side) - 1).cast("int").alias("t"), F.lit(side).alias("k"))
        return F.when((index % side == 0) & (index > 0), F.array(own, before)).otherwise(F.array(own))

    row, col = F.col("prow"), F.col("pcol")
    placed = (
        cells.select(F.col(value).cast("double").alias("_v"), *CELL, _c(height).cast("int").alias("_h"), _c(width).cast("int").alias("_w"))
        .where((row >= 0) & (row < F.col("_h")) & (col >= 0) & (col < F.col("_w")))
        .select("_v", "_h", "_w", F.explode(copies(row)).alias("_r"), "pcol")
        .select("_v", "_h", "_w", "_r", F.explode(copies(col)).alias("_c"))
        .select("_v", "_h", "_w", F.col("_r.t").alias("trow"), F.col("_c.t").alias("tcol"), (F.col("_r.k") * (side + 1) + F.col("_c.k")).alias("_at"))
    )
    return placed.groupBy(*TL.TILE).applyInArrow(resize, f"prow int, pcol int, `{value}` double")


def percentile_stretch(cells: DataFrame, bands, prob: float = 0.98) -> DataFrame:
    """clip(v / p98, 0, 1) per band; a band whose p98 is 0 is left alone."""
    from lotgrid.operators.ranking import column_quantiles

    top = {b: q.get(prob) for b, q in column_quantiles(cells, bands, [prob]).items()}
    return cells.withColumns(
        {b: clamp(F.col(b) / F.lit(top[b]), 0.0, 1.0) if top[b] else F.col(b).cast("double") for b in bands}
    )


def densest_blocks(outcomes: DataFrame, grid: Grid, block: int, n: int, *, seed: int = 42, min_share: float = 0.02) -> DataFrame:
    """n sampled centres of dense blocks per outcome class.

    Full blocks only; more than ``min_share`` of a block must carry the class; the
    5n densest (ties by position) form the pool the sample is drawn from.
    """
    from lotgrid.functions.hashing import cell_key, hash32

    full_rows, full_cols = F.floor(_c(grid.height) / block), F.floor(_c(grid.width) / block)
    counted = (
        outcomes.select("outcome", F.floor(F.col("prow") / block).alias("brow"), F.floor(F.col("pcol") / block).alias("bcol"))
        .groupBy("outcome", "brow", "bcol")
        .agg(F.count("*").alias("cells"))
        .where((F.col("brow") < full_rows) & (F.col("bcol") < full_cols) & (F.col("cells") > block * block * min_share))
    )
    # Rank filters become per-partition top-5n limits before the shuffle.
    density = Window.partitionBy("outcome").orderBy(F.desc("cells"), "brow", "bcol")
    pool = counted.withColumn("density_rank", F.row_number().over(density)).where(F.col("density_rank") <= 5 * n)
    draw = Window.partitionBy("outcome").orderBy(hash32(cell_key(F.col("brow"), F.col("bcol")), seed), "brow", "bcol")
    picked = pool.withColumn("_pick", F.row_number().over(draw)).where(F.col("_pick") <= n)
    row, col = F.col("brow") * block + block // 2, F.col("bcol") * block + block // 2
    return picked.select(
        "outcome", "cells", "density_rank", grid.centre_x(col).alias("x"), grid.centre_y(row).alias("y")
    )
