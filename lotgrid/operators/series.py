"""Building-permit series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotgrid.functions.attributes import lookup

# Metric columns and labels of the housing-mix layers, bottom to top.
MIX_LAYERS = [
    ("1_unit_units_per_capita", "Single-family (1 unit)"),
    ("2_units_units_per_capita", "2-unit"),
    ("3_to_4_units_units_per_capita", "3–4 unit"),
    ("5_plus_units_units_per_capita", "5+ unit"),
]

# Short names of metropolitan areas.
AREA_NAMES = {
    "New York-Newark-Jersey City MSA, NY-NJ": "New York",
    "Philadelphia-Camden-Wilmington MSA, PA-NJ-DE-MD": "Philadelphia",
    "Dallas-Fort Worth-Arlington MSA, TX": "Dallas–Fort Worth",
    "Phoenix-Mesa-Chandler MSA, AZ": "Phoenix",
}


def _recent(permits: DataFrame, start_year: int, names: dict[str, str]) -> DataFrame:
    return permits.where(F.col("year").cast("int") >= start_year).withColumns(
        {"year": F.col("year").cast("int"), "name": F.coalesce(lookup(F.col("name"), names), F.col("name"))}
    )


def metric_series(permits: DataFrame, metric: str, *, start_year: int = 2000, names: dict[str, str] = AREA_NAMES) -> DataFrame:
    """(name, year, value) from ``start_year``, nulls dropped, in year order."""
    return (
        _recent(permits, start_year, names)
        .select("name", "year", F.col(f"`{metric}`").alias("value"))
        .where(F.col("value").isNotNull())
        .orderBy("name", "year", "value")
    )


def mix_layers(permits: DataFrame, *, start_year: int = 2000, names: dict[str, str] = AREA_NAMES, layers=tuple(MIX_LAYERS)) -> DataFrame:
    """Stacked layers per (name, year): value (null = 0) and the top of its band."""
    long = (
        _recent(permits, start_year, names)
        .select("name", "year", F.posexplode(F.array(*[F.struct(F.lit(label).alias("layer"), F.coalesce(F.col(f"`{m}`"), F.lit(0.0)).alias("value")) for m, label in layers])).alias("layer_no", "_l"))
        .select("name", "year", "layer_no", "_l.*")
    )
    # A window holds one (name, year): as many rows as there are layers.
    stack = Window.partitionBy("name", "year").orderBy("layer_no").rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumn("stack_top", F.sum("value").over(stack)).orderBy("name", "layer_no", "year")
