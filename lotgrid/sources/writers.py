"""Split records, cached grids, layered exports and CSV results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = ["row_off", "col_off"]


def save_splits(patches: DataFrame, path: str, *, patch_size: int, stride: int, min_valid_pixels: int, splits: dict[int, str]) -> None:
    """Patch origins partitioned by split, with the grid parameters on every row and the borough map beside it."""
    spark = patches.sparkSession
    patches.where(F.col("split") != "excluded").select(
        *ORIGIN,
        "split",
        F.lit(patch_size).alias("patch_size"),
        F.lit(stride).alias("stride"),
        F.lit(min_valid_pixels).alias("min_valid_pixels"),
    ).write.mode("overwrite").partitionBy("split").json(f"{path}/patches")
    pairs = F.array(*[F.struct(F.lit(c).alias("boro_code"), F.lit(s).alias("split")) for c, s in splits.items()])
    spark.range(1).select(F.inline(pairs)).coalesce(1).write.mode("overwrite").json(f"{path}/split")


def load_splits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(patches, borough map) as stored by ``save_splits``."""
    fields = "row_off int, col_off int, patch_size int, stride int, min_valid_pixels int, split string"
    patches = spark.read.schema(fields).json(f"{path}/patches")
    return patches, spark.read.schema("boro_code int, split string").json(f"{path}/split")


def split_document(patches: DataFrame, chunk: int = 4096) -> DataFrame:
    """Origins as arrays per split, the shape of a one-document record.

    A split may hold most of the grid, so it is cut into square chunks of ``chunk``
    pixels: no array is longer than one chunk's patches.
    """
    chunks = [F.floor(F.col(c) / chunk).alias(f"chunk_{c}") for c in ORIGIN]
    return patches.groupBy("split", *chunks).agg(F.sort_array(F.collect_list(F.struct(*ORIGIN))).alias("origins"))


def document_origins(document: DataFrame) -> DataFrame:
    """Back from the document form to one row per origin."""
    return document.select("split", F.inline("origins"))


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a complete table was written at ``path``: Spark's writers leave a marker at the end."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def stored_or_built(spark: SparkSession, path: str, build: Callable[[], DataFrame], *, overwrite: bool = False) -> DataFrame:
    """The finished table at ``path``; built and stored first when there is none or ``overwrite`` is set.

    For long-lived outputs such as the parcel id raster and its mapping.  A table that is
    there but cannot be read is an error, never a reason to replace it.
    """
    if overwrite or not _finished(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_grid(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], *, patch_size: int, stride: int, min_valid_pixels: int
) -> DataFrame:
    """Stored patch grid for exactly these parameters, built when absent.

    Each parameter set has a folder of its own that is replaced as a whole, so two writers
    do not add up and a grid without patches counts as stored.
    """
    folder = f"{path}/patch_size={patch_size}-stride={stride}-min_valid_pixels={min_valid_pixels}"
    return stored_or_built(spark, folder, build)


def store_raster(cells: DataFrame, table: str, *, buckets: int) -> DataFrame:
    """Raster table bucketed and sorted by cell.

    Rasters of one grid stored with the same bucket count (pixels, masks, boroughs,
    scores) join cell by cell without a shuffle.
    """
    cells.write.mode("overwrite").bucketBy(buckets, "prow", "pcol").sortBy("prow", "pcol").saveAsTable(table)
    return cells.sparkSession.table(table)


def write_layers(layers: dict[str, DataFrame], path: str) -> None:
    """Every layer under ``<path>/layer=<name>``, in one write; layers without rows are left out.

    Layers have columns of their own, null where a layer lacks them; earlier layers at the
    path are replaced.
    """
    tagged = [df.withColumn("layer", F.lit(name)) for name, df in layers.items()]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    whole.write.mode("overwrite").partitionBy("layer").parquet(path)


def write_csv(df: DataFrame, path: str, columns) -> DataFrame:
    """CSV folder with a fixed column order; columns the table lacks are dropped."""
    ordered = df.select(*[c for c in columns if c in df.columns])
    ordered.write.mode("overwrite").option("header", True).csv(path)
    return ordered


def id_and_geometry(parcels: DataFrame, key: str = "bbl") -> DataFrame:
    """Minimal export: text id and geometry."""
    return parcels.select(F.col(key).cast("string").alias(key), "geom")
