"""Scans of parcel, overlay, scene, statistics, run and permit tables."""

from __future__ import annotations

import io
import json
import logging
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lotgrid.functions.attributes import COUNTY_BOROUGH, lookup
from lotgrid.operators.ranking import sample_exact
from lotgrid.operators.summary import union_all
from lotgrid.schemas import HISTORY_EPOCH, RUN_CONFIG, RUN_METRICS

log = logging.getLogger(__name__)

# Road classes burned into the label mask by default.
ROAD_CLASSES = ["S1100", "S1200", "S1630", "S1640"]

# Band and statistic names of the statistics table.
BANDS = ("R", "G", "B", "N", "NDVI", "SAVI", "Brightness", "BareSoilProxy", "EVI", "GNDVI")
STATS = ("mean", "stdDev", "median", "count")


def path_is_absent(error: AnalysisException) -> bool:
    """Whether a scan failed because nothing is at its path; any other error is the caller's to see."""
    return error.getCondition() == "PATH_NOT_FOUND"


def scan_parcels(spark: SparkSession, path: str, *, subset_size: int | None = None, key: str = "bbl", seed: int = 42) -> DataFrame:
    """Parcel table, or exactly ``subset_size`` hash-chosen rows when it is larger."""
    parcels = spark.read.parquet(path)
    return parcels if subset_size is None else sample_exact(parcels, subset_size, key, seed=seed)


def only_classes(roads: DataFrame, classes=ROAD_CLASSES) -> DataFrame:
    """Rows of the wanted road classes; ``None`` keeps all."""
    return roads if classes is None else roads.where(F.col("mtfcc").isin(list(classes)))


def scan_overlay(spark: SparkSession, paths: dict[str, str], *, classes=None) -> DataFrame:
    """Per-county tables united, each row tagged with its county; missing tables are skipped with a warning."""
    parts = []
    for county, path in paths.items():
        try:
            parts.append(spark.read.parquet(path).withColumn("county", F.lit(county)))
        except AnalysisException as error:
            if not path_is_absent(error):
                raise
            log.warning("no overlay table for county %s at %s", county, path)
    if not parts:
        raise FileNotFoundError("no overlay table found")
    return only_classes(union_all(parts), classes)


def county_boroughs(counties: DataFrame, code: str = "countyfp") -> DataFrame:
    """Counties of the five boroughs with their borough code."""
    return counties.withColumn("boro_code", lookup(F.col(code), COUNTY_BOROUGH)).where(F.col("boro_code").isNotNull())


def scenes_in(catalogue: DataFrame, *, west: float, south: float, east: float, north: float, year: int) -> DataFrame:
    """Scenes of a calendar year that meet a bounding box; plain range filters, pushed to the scan."""
    return catalogue.where(
        (F.col("west") <= east)
        & (F.col("east") >= west)
        & (F.col("south") <= north)
        & (F.col("north") >= south)
        & (F.col("acq_date") >= F.lit(f"{year}-01-01").cast("date"))
        & (F.col("acq_date") < F.lit(f"{year + 1}-01-01").cast("date"))
    )


def imagery_years(catalogue: DataFrame, *, west: float, south: float, east: float, north: float) -> DataFrame:
    """Distinct acquisition years over a region, sorted."""
    hit = (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)
    return catalogue.where(hit).select(F.year("acq_date").alias("year")).distinct().orderBy("year")


def stats_schema(bands=BANDS, stats=STATS) -> T.StructType:
    fields = [T.StructField("bbl", T.LongType())]
    return T.StructType(fields + [T.StructField(f"{b}_{s}", T.DoubleType()) for b in bands for s in stats])


def read_parcel_stats(
    spark: SparkSession, path: str, parcels: DataFrame | None = None, *, schema: T.StructType | None = None, join_cols=(), key: str = "bbl"
) -> DataFrame:
    """Spectral statistics CSV, left-joined to chosen parcel columns (the key is always included)."""
    stats = spark.read.csv(path, schema=schema or stats_schema(), header=True)
    if parcels is None:
        return stats
    wanted = [key, *[c for c in join_cols if c != key]]
    return stats.join(parcels.select(*wanted), key, "left")


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    """Run records gathered into line-wise JSON files, the form for a large registry."""
    return spark.read.schema(RUN_METRICS).json(path)


_SCALARS = {"true": True, "yes": True, "on": True, "false": False, "no": False, "off": False, "null": None, "~": None, "": None}
_NUMBER = re.compile(r"[-+]?(\d[\d_]*)?(\.\d*)?([eE][-+]?\d+)?")


def _scalar(text: str):
    text = text.strip()
    if text[:1] in ("'", '"'):
        end = text.rfind(text[0])
        return text[1:end] if end > 0 else text[1:]
    text = re.sub(r"(^|\s)#.*$", "", text).strip()
    if text.lower() in _SCALARS:
        return _SCALARS[text.lower()]
    if _NUMBER.fullmatch(text) and any(c.isdigit() for c in text):
        plain = text.replace("_", "")
        return int(plain) if re.fullmatch(r"[-+]?\d+", plain) else float(plain)
    return text


def parse_config(text: str) -> dict:
    """Nested mappings of a YAML configuration: keys by indentation, plain and quoted values, comments.

    List items and block texts are passed over; no key of a run's record is one.
    """
    root: dict = {}
    levels: list[tuple[int, dict]] = [(-1, root)]
    for line in text.splitlines():
        bare = line.strip()
        match = re.match(r"""(?:"([^"]*)"|'([^']*)'|([^\s:#'"\-\[{][^:#]*?))\s*:(?:\s+(.*)|\s*)$""", bare)
        if not match or bare.startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        while levels[-1][0] >= indent:
            levels.pop()
        name, value = next(g for g in match.groups()[:3] if g is not None), (match[4] or "").strip()
        if not value or value.startswith("#"):
            child: dict = {}
            levels[-1][1][name] = child
            levels.append((indent, child))
        else:
            levels[-1][1][name] = _scalar(value)
    return root


def _fitted(value, kind: T.DataType):
    """``value`` as the given type, null where it is none."""
    if isinstance(kind, T.StructType):
        held = value if isinstance(value, dict) else {}
        return {f.name: _fitted(held.get(f.name), f.dataType) for f in kind}
    if value is None or isinstance(value, dict):
        return None
    if isinstance(kind, T.StringType):
        return str(value)
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return int(number) if isinstance(kind, T.LongType) and number == int(number) else number if isinstance(kind, T.DoubleType) else None


def _files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``run_dir, content`` of one file of every run folder, the last by name where several fit; a folder without one has no row."""
    try:
        files = spark.read.format("binaryFile").load(f"{root}/*/*/{name}")
    except AnalysisException as error:
        if not path_is_absent(error):
            raise
        return spark.createDataFrame([], "run_dir string, content binary")
    named = files.select(F.regexp_extract("path", r"([^/]+/[^/]+)/[^/]+$", 1).alias("run_dir"), "path", "content")
    return named.groupBy("run_dir").agg(F.max_by("content", "path").alias("content"))


def read_configs(spark: SparkSession, root: str) -> DataFrame:
    """``run_dir`` and the fields of ``RUN_CONFIG`` of every ``config.yaml``, or ``config.json`` where there is none, parsed in tasks."""
    kind = to_arrow_schema(RUN_CONFIG)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [c.decode("utf-8", "replace") for c in batch.column("content").to_pylist()]
            rows = [_fitted(json.loads(c) if c.lstrip().startswith("{") else parse_config(c), RUN_CONFIG) for c in texts]
            yield pa.RecordBatch.from_arrays([batch.column("run_dir"), *[pa.array([r[f.name] for r in rows], f.type) for f in kind]], ["run_dir", *kind.names])

    schema = T.StructType([T.StructField("run_dir", T.StringType()), *RUN_CONFIG.fields])
    return _files(spark, root, "config.{yaml,json}").mapInArrow(parse, schema)


def read_curves(spark: SparkSession, root: str) -> DataFrame:
    """``run_dir, name, values`` of every array in the ``pr_curves.npz`` of a run; a file that is no archive gives none."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run_dir, content in zip(batch.column("run_dir").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as stored:
                        arrays = {n: np.asarray(stored[n], "f8").reshape(-1) for n in stored.files}
                except (ValueError, OSError, zipfile.BadZipFile) as error:
                    log.warning("no curves in %s: %s", run_dir, error)
                    continue
                for name, values in arrays.items():
                    yield pa.RecordBatch.from_arrays([pa.array([run_dir]), pa.array([name]), pa.array([values], pa.list_(pa.float64()))], ["run_dir", "name", "values"])

    return _files(spark, root, "pr_curves.npz").mapInArrow(unpack, "run_dir string, name string, values array<double>")


def curve_points(curves: DataFrame, key: str = "run_id") -> DataFrame:
    """``key, split, threshold`` rows of the threshold arrays, whichever of their two names they have."""
    split = F.coalesce(F.nullif(F.regexp_extract("name", "^(.+)_thresholds$", 1), F.lit("")), F.nullif(F.regexp_extract("name", "^thresholds_(.+)$", 1), F.lit("")))
    return curves.select(key, split.alias("split"), "values").where("split IS NOT NULL").select(key, "split", F.explode("values").alias("threshold"))


def read_runs(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """``metrics``, ``configs``, ``history`` and ``curves`` of every ``<root>/<model>/<run>/`` folder, keyed by run.

    The files are ``metrics.json``, ``config.yaml``, ``history.json`` and ``pr_curves.npz``.
    A folder without metrics has no row anywhere; the other files may be missing.
    """

    def load(file: str, schema: T.StructType) -> DataFrame:
        try:
            df = spark.read.schema(schema).json(f"{root}/*/*/{file}", multiLine=True)
        except AnalysisException as error:
            if not path_is_absent(error):
                raise
            df = spark.createDataFrame([], schema)
        return df.withColumn("run_dir", F.regexp_extract(F.input_file_name(), r"([^/]+/[^/]+)/[^/]+$", 1))

    metrics = load("metrics.json", RUN_METRICS)
    folder = F.element_at(F.split("run_dir", "/"), -1)
    keyed = metrics.withColumn("run_id", F.coalesce("run_id", folder))
    ids = keyed.select("run_dir", "run_id")
    parts = {"configs": read_configs(spark, root), "history": load("history.json", HISTORY_EPOCH), "curves": read_curves(spark, root)}
    return {"metrics": keyed.drop("run_dir")} | {name: df.join(ids, "run_dir").drop("run_dir") for name, df in parts.items()}


def read_permits(spark: SparkSession, path: str, *, one_document: bool = True) -> DataFrame:
    """Permit records, one JSON array of objects or one object per line; years may be text or numbers."""
    metrics = ("total_units", "total_bldgs", "1_unit_units", "2_units_units", "3_to_4_units_units", "5_plus_units_units")
    schema = T.StructType(
        [T.StructField("name", T.StringType()), T.StructField("year", T.StringType())]
        + [T.StructField(f"{m}_per_capita", T.DoubleType()) for m in metrics]
    )
    return spark.read.schema(schema).json(path, multiLine=one_document).withColumn("year", F.col("year").try_cast("int"))
