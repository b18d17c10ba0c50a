"""Scans, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotgrid.functions import geometry as G
from lotgrid.operators import change
from lotgrid.operators import patches as PT
from lotgrid.operators import registry as RG
from lotgrid.operators import zonal
from lotgrid.plans import evaluation_queries as EQ
from lotgrid.plans import parcel_queries as PQ
from lotgrid.plans import raster_queries as RQ
from lotgrid.plans.inputs import Inputs
from lotgrid.plans.registry import query
from lotgrid.session import scratch_path
from lotgrid.sources import readers, writers
from lotgrid.streaming import blend, confusion


@query(
    "overlay_scan_S2",
    "SELECT mtfcc, county, count(*) AS roads FROM roads WHERE mtfcc IN ('S1100','S1200','S1630','S1640') GROUP BY 1, 2",
    "roads",
)
def _(t: Inputs):
    # One folder per county, as delivered; the last county has none.
    root = scratch_path(t.spark, "roads")
    t.roads.withColumnRenamed("county", "folder").write.partitionBy("folder").parquet(root)
    names = [r["county"] for r in t.roads.select("county").distinct().collect()]
    paths = {name: f"{root}/folder={name}" for name in [*names, "absent"]}
    found = readers.scan_overlay(t.spark, paths, classes=readers.ROAD_CLASSES)
    return found.groupBy("mtfcc", "county").agg(F.count("*").alias("roads"))


@query("county_lookup_S3", "SELECT r_name AS name, (r_regionkey + 1)::INT AS boro_code FROM region")
def _(t: Inputs):
    return readers.county_boroughs(t.counties.drop("boro_code")).select("name", "boro_code")


_CATALOGUE = """(SELECT 'm_' || o_orderkey || '_' || strftime(o_orderdate, '%Y%m%d') AS scene_id, o_orderdate::DATE AS acq_date,
(o_custkey*37)%5000 AS west, (o_orderkey*53)%5000 AS south, (o_custkey*37)%5000 + 60 AS east, (o_orderkey*53)%5000 + 75 AS north FROM orders)"""
_REGION = {"west": 900.0, "south": 900.0, "east": 2600.0, "north": 2100.0}
_MEETS = "west <= 2600 AND east >= 900 AND south <= 2100 AND north >= 900"


@query("scene_filter_S4", f"SELECT scene_id FROM {_CATALOGUE} WHERE {_MEETS} AND year(acq_date) = 1998")
def _(t: Inputs):
    return readers.scenes_in(t.catalogue, year=1998, **_REGION).select("scene_id")


@query("imagery_years_S5", f"SELECT DISTINCT year(acq_date)::INT AS year FROM {_CATALOGUE} WHERE {_MEETS}")
def _(t: Inputs):
    return readers.imagery_years(t.catalogue, **_REGION)


@query(
    "parcel_stats_S7_J2",
    "SELECT bbl, round(avg(r), 6) AS r_mean, count(n) AS n_count, any_value(bldg_class) AS bldg_class FROM raster JOIN (SELECT bbl, prow, pcol FROM lot_cells) USING (prow, pcol) JOIN attrs USING (bbl) GROUP BY 1",
    "raster lot_cells attrs",
)
def _(t: Inputs):
    path = scratch_path(t.spark, "parcel-stats")
    stats = zonal.zonal_by_polygon(t.tiles, t.lots, t.grid, ["r", "n"], levels=256)
    writers.write_csv(stats, path, stats.columns)
    back = readers.read_parcel_stats(
        t.spark, path, t.part_attributes, schema=readers.stats_schema(("r", "n")), join_cols=["bldg_class"]
    )
    return back.select("bbl", F.round("r_mean", 6).alias("r_mean"), F.col("n_count").cast("bigint").alias("n_count"), "bldg_class")


@query(
    "run_records_S8",
    "SELECT run_id, val_f2, test_ap FROM runs",
    "runs",
)
def _(t: Inputs):
    root = scratch_path(t.spark, "runs")
    t.runs.write.json(root)
    flat = RG.flatten_runs(readers.read_run_records(t.spark, root), t.run_configs)
    return flat.select("run_id", "val_f2", "test_ap")


@query(
    "permit_records_S9",
    "SELECT name, year, total_units_per_capita, m3 AS \"3_to_4_units_units_per_capita\" FROM permits",
    "permits",
)
def _(t: Inputs):
    path = scratch_path(t.spark, "permits")
    t.permits.withColumn("year", F.col("year").cast("string")).write.json(path)
    return readers.read_permits(t.spark, path, one_document=False).select("name", "year", "total_units_per_capita", "3_to_4_units_units_per_capita")


@query(
    "split_round_trip_S10",
    RQ._PW8 + RQ._PATCHES + "SELECT row_off, col_off, split, 8 AS patch_size, 8 AS stride FROM sp WHERE split <> 'excluded'",
    "raster dims",
)
def _(t: Inputs):
    path = scratch_path(t.spark, "splits")
    writers.save_splits(RQ.split_grid(t), path, patch_size=8, stride=8, min_valid_pixels=40, splits=RQ._SPLITS)
    return writers.load_splits(t.spark, path)[0].select("row_off", "col_off", "split", "patch_size", "stride")


@query("split_document_S10", RQ._PW8 + RQ._PATCHES + "SELECT split, row_off, col_off FROM sp", "raster dims")
def _(t: Inputs):
    return writers.document_origins(writers.split_document(RQ.split_grid(t)))


@query("cached_grid_S11", RQ._PW8 + RQ._PATCHES + "SELECT row_off, col_off, labelled, vacant FROM kept", "raster dims")
def _(t: Inputs):
    path, params = scratch_path(t.spark, "grids"), {"patch_size": 8, "stride": 8, "min_valid_pixels": 40}

    def build():
        return PT.patch_grid(t.mask, t.grid, 8, 8, 40)

    writers.cached_grid(t.spark, path, build, **params)
    return writers.cached_grid(t.spark, path, build, **params)


@query(
    "change_layers_S12",
    """SELECT 'vacant_y1' AS layer, count(*) AS n FROM v1 WHERE is_vacant UNION ALL SELECT 'vacant_y2', count(*) FROM v2 WHERE is_vacant
    UNION ALL SELECT 'change', count(*) FROM changed UNION ALL SELECT change_category, count(*) FROM changed GROUP BY 1
    UNION ALL SELECT 'hotspots', count(*) FROM (WITH """
    + PQ._HOTSPOTS[2:]
    + ")",
    "changed v1 v2",
)
def _(t: Inputs):
    path = scratch_path(t.spark, "layers")
    changes = PQ.changes(t)
    layers = change.change_layers(t.vintage(1), t.vintage(2), changes, change.hotspots(changes, cell=500.0, top_n=10))
    writers.write_layers(layers, path)
    return t.spark.read.parquet(path).groupBy("layer").agg(F.count("*").alias("n"))


@query("csv_results_S13", "SELECT bbl, bldg_class, boro_code, valid_pixels, pred_pixels FROM fractions", "fractions")
def _(t: Inputs):
    path = scratch_path(t.spark, "parcel-results")
    columns = ["bbl", "bldg_class", "boro_code", "address", "valid_pixels", "pred_pixels"]  # address is absent here
    written = writers.write_csv(EQ.fractions(t), path, columns)
    return t.spark.read.csv(path, schema=written.schema, header=True)


@query("id_geometry_export_S14", "SELECT bbl::VARCHAR AS bbl, round(CASE WHEN tri THEN side*side/2 ELSE side*side END, 6) AS area_m2 FROM lots", "lots")
def _(t: Inputs):
    out = writers.id_and_geometry(t.lots)
    return out.select("bbl", F.round(G.area(F.col("geom")), 6).alias("area_m2"))


# ---------------------------------------------------------------- streams (ST)


STREAM_FILES = 3


def _arriving(t: Inputs, table: str, root: str):
    """A table that arrives in three parts, one after the other: the function that lets the next part arrive, and the stream.

    A part has as many files as the table is read in; a stream takes all that has arrived as one batch.
    """
    rows, key = t.table(table), {"lineitem": "l_orderkey", "orders": "o_orderkey"}[table]

    def arrive(k: int) -> None:
        rows.where(F.pmod(F.xxhash64(key), F.lit(STREAM_FILES)) == k).write.mode("append").parquet(f"{root}/in")

    arrive(0)
    return arrive, lambda: t.spark.readStream.schema(rows.schema).parquet(f"{root}/in")


@query(
    "stream_confusion_ST1",
    EQ.metrics_sql(f"SELECT split, run_no, {EQ._COUNTS} FROM {EQ._SCORED} GROUP BY 1, 2", "split, run_no"),
    "scores",
)
def _(t: Inputs):
    root, by = scratch_path(t.spark, "stream-confusion"), ["split", "run_no"]
    arrive, stream = _arriving(t, "lineitem", root)
    # The stream is started anew for every part, and compacts after every second batch.
    for k in range(STREAM_FILES):
        if k:
            arrive(k)
        confusion.start_confusion(t.scores_of(stream()), f"{root}/table", f"{root}/checkpoint", by=by, compact_every=2).awaitTermination()
    return EQ._round(confusion.read_confusion(t.spark, f"{root}/table", by=by), EQ._ROUNDED)


@query("stream_blend_ST2", f"SELECT prow, pcol, round(sum(prob*{EQ._W})/sum({EQ._W}), 6) AS prob FROM patch_px GROUP BY 1, 2", "patch_px")
def _(t: Inputs):
    root = scratch_path(t.spark, "stream-blend")
    to_scores = lambda batch: t.patch_scores_of(t.raster_of(batch))
    arrive, stream = _arriving(t, "orders", root)
    for k in range(STREAM_FILES):
        if k:
            arrive(k)
        blend.start_blend(stream(), f"{root}/table", f"{root}/checkpoint", 8, to_patch_scores=to_scores, compact_every=2).awaitTermination()
    return EQ._round(blend.read_blend(t.spark, f"{root}/table"), ["prob"])
