"""Statistics of raster cells per zone, tile by tile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotgrid.functions.grid import Grid
from lotgrid.operators import tiles as TL
from lotgrid.operators.ranking import weighted_quantiles
from lotgrid.operators.raster import parcel_ids, polygon_spans
from lotgrid.session import cut_lineage

FEW_LEVELS = 4096  # values of a band that one zone's counts may hold in a task


def _statistics(partials, bands: list[str], stats, levels: int | None) -> DataFrame:
    """``zone, <band>_<stat>...`` from partial moments and, for medians, partial value counts."""
    merged = TL.merged_moments(partials("moments"))
    pick = {"mean": "mean", "stdDev": "std", "count": "n"}

    def of(column: str, k: int):
        return F.max(F.when(F.col("band") == k, F.col(column)))

    columns = {f"{b}_{s}": of(pick[s], k) for k, b in enumerate(bands) for s in stats if s != "median"}
    out = merged.groupBy("zone").agg(F.max("n").alias("_most"), *[c.alias(name) for name, c in columns.items()]).where("_most > 0")
    if "median" in stats:
        counted = partials("counts").groupBy("zone", "band", "value").agg(F.sum("n").alias("n"))
        found = weighted_quantiles(counted, "value", "n", [0.5], by=("zone", "band"), few=levels is not None and levels <= FEW_LEVELS)
        medians = found.groupBy(F.col("zone").alias("_z")).agg(*[of("quantile", k).alias(f"{b}_median") for k, b in enumerate(bands)])
        out = out.join(medians, out["zone"] == medians["_z"], "left")
    return out.select("zone", *[f"{b}_{s}" for b in bands for s in stats])


def _with_tile_medians(summaries: DataFrame, counts_of, bands: list[str], stats, levels: int | None) -> DataFrame:
    """``_statistics`` from the summaries of tiles; ``counts_of(zones)`` counts the values of zones in several tiles."""
    out = _statistics(lambda _: summaries, bands, [s for s in stats if s != "median"], levels)
    known = F.col("n") > 0
    met = summaries.groupBy("zone", "band").agg(F.count_if(known).alias("_tiles"), F.max(F.when(known, F.col("median"))).alias("quantile"))
    found = met.where("_tiles = 1").select("zone", "band", "quantile")
    spread = met.where("_tiles > 1").select("zone").distinct()
    counted = counts_of(spread).groupBy("zone", "band", "value").agg(F.sum("n").alias("n"))
    several = weighted_quantiles(counted, "value", "n", [0.5], by=("zone", "band"), few=levels is not None and levels <= FEW_LEVELS)
    # A band with one tile of a zone with several has both medians, which are equal.
    both = found.unionByName(several.select("zone", "band", "quantile"))
    medians = both.groupBy(F.col("zone").alias("_z")).agg(*[F.max(F.when(F.col("band") == k, F.col("quantile"))).alias(f"{b}_median") for k, b in enumerate(bands)])
    joined = out.join(medians, out["zone"] == medians["_z"], "left")
    return joined.select("zone", *[f"{b}_{s}" for b in bands for s in stats])


def zonal_by_raster(
    pixels: DataFrame,
    zones: DataFrame,
    bands,
    *,
    zone: str = "parcel_id",
    stats=("mean", "stdDev", "count"),
    subset: DataFrame | None = None,
    levels: int | None = None,
    side: int = TL.SIDE,
) -> DataFrame:
    """Band statistics per zone of an id raster; pixels and zones are cells or tiles.

    Every tile gives partial sums per zone.  ``levels`` states how many values the bands can
    have; medians of bands with few are counted per zone in one task, those of others, whose
    values could fill a task, are ranked in a distributed way.  Zones without a value in
    any band have no row.
    """
    bands = list(bands)
    kind = dict(zones.dtypes)[zone]
    stacked = TL.stack(TL.as_tiles(zones, [zone], side), TL.as_tiles(pixels, bands, side), side)
    out = _statistics(lambda what: TL.zone_partials(stacked, zone, bands, what, side), bands, stats, levels)
    if subset is not None:
        out = out.join(subset.select(F.col(zone).alias("_s")), F.col("zone") == F.col("_s"), "left_semi")
    kind = kind if not kind.startswith("array") else "bigint"
    return out.select(F.col("zone").cast(kind).alias(zone), *[c for c in out.columns if c != "zone"])


def _numbered(parcels: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Parcels with a whole-number ``zone``, and the table that names it if the key is none itself."""
    if dict(parcels.dtypes)[key] in ("tinyint", "smallint", "int", "bigint"):
        return parcels.select(F.col(key).cast("bigint").alias("zone"), "geom"), None
    ids = parcel_ids(parcels, key)
    return parcels.join(ids, key).select(F.col("parcel_id").alias("zone"), "geom"), ids


def zonal_by_polygon(
    pixels: DataFrame,
    parcels: DataFrame,
    grid: Grid,
    bands,
    *,
    key: str = "bbl",
    stats=("mean", "stdDev", "median", "count"),
    levels: int | None = None,
    side: int = TL.SIDE,
) -> DataFrame:
    """Band statistics per polygon, overlapping polygons allowed; columns ``<band>_<stat>``.

    Polygons meet the tiles as row spans; neither side's cells are shuffled.  The median of a
    zone that has values in one tile only is found there; values are counted, with ``levels``
    as for ``zonal_by_raster``, for the zones of several tiles.
    """
    bands = list(bands)
    shapes, ids = _numbered(parcels, key)
    tiles = TL.as_tiles(pixels, bands, side)

    def partials(what: str, shapes: DataFrame = shapes) -> DataFrame:
        return TL.span_partials(tiles, polygon_spans(shapes, grid), "zone", bands, what, side)

    if "median" in stats:
        out = _with_tile_medians(cut_lineage(partials("summaries"), "zone-summaries"), lambda zones: partials("counts", shapes.join(zones, "zone", "left_semi")), bands, stats, levels)
    else:
        out = _statistics(partials, bands, stats, levels)
    rest = [c for c in out.columns if c != "zone"]
    if ids is None:
        return out.select(F.col("zone").cast(dict(parcels.dtypes)[key]).alias(key), *rest)
    return out.join(ids, out["zone"] == ids["parcel_id"]).select(key, *rest)


def prediction_fraction(
    parcels: DataFrame,
    scores: DataFrame,
    grid: Grid,
    *,
    key: str = "bbl",
    pixel_threshold: float = 0.5,
    min_pixels: int = 5,
    side: int = TL.SIDE,
) -> DataFrame:
    """Scored cells, cells at or above the threshold, and their ratio per parcel.

    Null probabilities are not valid cells.  Only (key, geom) meets the score tiles, as row
    spans against running counts; the attributes come back by one join on the key.
    """
    shapes, ids = _numbered(parcels, key)
    sums = TL.span_sums(TL.as_tiles(scores, ["prob"], side), polygon_spans(shapes, grid), "zone", "prob", pixel_threshold, side)
    if ids is not None:
        sums = sums.join(ids, sums["zone"] == ids["parcel_id"]).select(F.col(key).alias("zone"), "n", "hits")
    sums = sums.select(F.col("zone").alias("_zone"), F.col("n").alias("valid_pixels"), F.col("hits").alias("pred_pixels"))
    out = parcels.drop("geom").join(sums, F.col(key) == F.col("_zone"), "left").drop("_zone")
    out = out.fillna(0, ["valid_pixels", "pred_pixels"]).withColumn(
        "pred_fraction", F.col("pred_pixels") / F.nullif(F.col("valid_pixels"), F.lit(0))
    )
    return out.where(F.col("valid_pixels") >= min_pixels)
