"""Running confusion metrics over arriving scored rows.

Counts add up, so every micro-batch stores its own and readers total them: the metrics
table is never overwritten while it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lotgrid.operators.evaluation import COUNTS, confusion_counts, with_metrics
from lotgrid.streaming.deltas import Totals, store_batches


def confusion_totals(spark: SparkSession, out: str, by=("run_id", "split")) -> Totals:
    return Totals(spark, out, list(by), list(COUNTS))


def start_confusion(scored: DataFrame, out: str, checkpoint: str, *, by=("run_id", "split"), threshold: float = 0.5, compact_every: int = 100) -> StreamingQuery:
    """Add the counts of what is available to those under ``out``."""

    def partial(batch: DataFrame) -> DataFrame:
        return confusion_counts(batch, F.col("y"), (F.col("prob") > threshold).cast("int"), by=by)

    store = store_batches(confusion_totals(scored.sparkSession, out, by), partial, compact_every=compact_every)
    return scored.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()


def read_confusion(spark: SparkSession, out: str, *, by=("run_id", "split")) -> DataFrame | None:
    """Counts and metrics per key of all batches so far; None before the first."""
    counts = confusion_totals(spark, out, by).read()
    return None if counts is None else with_metrics(counts)
