"""Overlap blending as scored patches arrive.

The blend is a ratio of two sums, so every micro-batch stores its own partial sums and
readers add them up.  Nothing is kept in the state store: a city-wide raster has far more
cells than state should hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lotgrid.operators.scoring import CELL, global_cells, hann_weight
from lotgrid.streaming.deltas import Totals, store_batches


def partial_sums(patch_scores: DataFrame, patch: int) -> DataFrame:
    """Weighted probability and weight per cell."""
    placed = global_cells(patch_scores.withColumn("_w", hann_weight(patch))).where(F.col("prob").isNotNull())
    return placed.groupBy(*CELL).agg(F.sum(F.col("prob") * F.col("_w")).alias("pw"), F.sum("_w").alias("w"))


def blend_totals(spark: SparkSession, out: str) -> Totals:
    return Totals(spark, out, CELL, ["pw", "w"])


def start_blend(
    stream: DataFrame, out: str, checkpoint: str, patch: int, *, to_patch_scores: Callable[[DataFrame], DataFrame] | None = None, compact_every: int = 100
) -> StreamingQuery:
    """Add what is available to the sums under ``out``; batches of any number of streams add up there."""
    convert = to_patch_scores or (lambda batch: batch)
    store = store_batches(blend_totals(stream.sparkSession, out), lambda batch: partial_sums(convert(batch), patch), compact_every=compact_every)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()


def read_blend(spark: SparkSession, out: str) -> DataFrame:
    """Blended probability per cell from all batches so far."""
    rows = blend_totals(spark, out).read()
    if rows is None:
        return spark.createDataFrame([], "prow int, pcol int, prob double")
    return rows.select(*CELL, (F.col("pw") / F.col("w")).alias("prob"))
