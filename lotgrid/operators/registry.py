"""Experiment registry: flattened runs, comparisons, scoring plans and training histories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgrid.functions.attributes import parse_threshold
from lotgrid.operators.evaluation import best_threshold
from lotgrid.operators.ranking import running_totals
from lotgrid.session import cut_lineage

# Column order of the registry table.
REGISTRY_COLUMNS = [
    "model_type", "encoder", "run_id", "best_epoch", "epochs_ran",
    "in_channels", "use_building_prob", "patch_size", "batch_size", "lr",
    "pos_weight", "bce_weight", "dice_weight", "lovasz_weight",
    "oversample_factor", "min_vacant_pixels", "band_dropout_p",
    "cosine_t_max", "seed", "eval_stride",
    "vacancy_mask", "patch_splits",
    "val_iou", "val_f1", "val_f2", "val_precision", "val_recall", "val_ap", "val_kappa",
    "test_iou", "test_f1", "test_f2", "test_precision", "test_recall", "test_ap", "test_kappa",
    "threshold_sweep_extent",
    "note", "trained_at", "machine",
]

# Columns a comparison leaves out.
COMPARISON_DROPS = [
    "best_epoch", "lr", "min_vacant_pixels", "band_dropout_p", "seed",
    "vacancy_mask", "patch_splits", "trained_at", "machine",
]

_SHORT_METRICS = {"iou": "iou", "f1": "f1", "f2": "f2", "precision": "precision", "recall": "recall", "ap": "average_precision", "kappa": "kappa"}


def patch_size_from_name(path: Column) -> Column:
    """First all-digit ``_`` token of the file stem; null without one."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.get(F.filter(F.split(stem, "_"), lambda token: token.rlike("^[0-9]+$")), F.lit(0))


def epochs_ran(history: DataFrame, by: str = "run_id") -> DataFrame:
    """Stored epochs per run."""
    return history.groupBy(by).agg(F.count("*").alias("epochs_ran"))


def sweep_extent(points: DataFrame, by: str = "run_id") -> DataFrame:
    """Highest threshold of the validation curve."""
    return points.where("split = 'val'").groupBy(by).agg(F.format_string("%.3f", F.max("threshold")).alias("threshold_sweep_extent"))


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _four(value: Column) -> Column:
    return F.when(value.isNull(), "").otherwise(F.format_string("%.4f", value))


def flatten_runs(
    runs: DataFrame, configs: DataFrame, history: DataFrame | None = None, points: DataFrame | None = None, *, machine: str = ""
) -> DataFrame:
    """One text row per run in registry column order; absent values are empty."""
    df = runs.join(configs, "run_id", "left")
    df = df.join(epochs_ran(history), "run_id", "left") if history is not None else df.withColumn("epochs_ran", F.lit(None).cast("bigint"))
    if points is not None:
        df = df.join(sweep_extent(points), "run_id", "left")
    else:
        df = df.withColumn("threshold_sweep_extent", F.lit(None).cast("string"))
    size = F.coalesce(F.nullif(F.col("patch.size"), F.lit(0)).cast("string"), patch_size_from_name(F.col("data_paths.patch_splits")))
    values = {
        "model_type": _text(F.coalesce("model_type", "model.type")),
        "encoder": _text(F.coalesce("encoder_name", "model.encoder_name")),
        "patch_size": _text(size),
        "lr": _text(F.col("training.learning_rate")),
        "vacancy_mask": _text(F.col("data_paths.vacancy_mask")),
        "patch_splits": _text(F.col("data_paths.patch_splits")),
        "machine": F.lit(machine),
    }
    values.update({c: _text(F.col(c)) for c in ("run_id", "best_epoch", "epochs_ran", "eval_stride", "threshold_sweep_extent", "note", "trained_at")})
    values.update({c: _text(F.col(f"model.{c}")) for c in ("in_channels", "use_building_prob")})
    values.update({c: _text(F.col(f"loss.{c}")) for c in ("pos_weight", "bce_weight", "dice_weight", "lovasz_weight")})
    values.update(
        {c: _text(F.col(f"training.{c}")) for c in ("batch_size", "oversample_factor", "min_vacant_pixels", "band_dropout_p", "cosine_t_max", "seed")}
    )
    for split in ("val", "test"):
        values.update({f"{split}_{short}": _four(F.col(f"metrics.{split}.{field}")) for short, field in _SHORT_METRICS.items()})
    return df.select(*[values[c].alias(c) for c in REGISTRY_COLUMNS])


def compare_runs(registry: DataFrame) -> DataFrame:
    """Mask version, filled test F2, unneeded columns dropped, best runs first with nulls last."""
    path = F.trim(F.coalesce("vacancy_mask", F.lit("")))
    version = F.when(F.contains(path, F.lit("v2")), "v2").when(path != "", "v1").otherwise("")
    computed = F.col("test_best_f2_computed") if "test_best_f2_computed" in registry.columns else F.lit(None).cast("double")
    df = registry.withColumn("mask_version", version)
    filled = F.when((F.col("mask_version") == "v2") & computed.isNull(), F.col("best_val_f2")).otherwise(computed)
    df = df.withColumn("test_best_f2_computed", filled)
    rest = [c for c in df.columns if c not in (*COMPARISON_DROPS, "test_best_f2_computed")]
    return df.select("test_best_f2_computed", *rest).orderBy(
        F.desc_nulls_last("test_best_f2_computed"), F.desc_nulls_last("test_f2"), "run_id"
    )


def best_f2(registry: DataFrame) -> Column:
    """Best validation F2 as a fraction, falling back to the 0.5-threshold one, else 0."""
    value = F.coalesce(F.col("best_val_f2").try_cast("double"), F.col("val_f2").try_cast("double"))
    return F.coalesce(F.when(value > 1, value / 100.0).otherwise(value), F.lit(0.0))


def top_runs(registry: DataFrame, *, min_f2_pct: float = 25.0, n: int | None = None, model_type: str | None = None) -> DataFrame:
    """Runs at or above the F2 floor, best first."""
    df = registry if model_type is None else registry.where(F.col("model_type") == model_type)
    ranked = df.withColumn("sort_f2", best_f2(df)).where(F.col("sort_f2") * 100 >= min_f2_pct).orderBy(F.desc("sort_f2"), "run_id")
    return ranked.limit(n) if n else ranked


def scoring_plan(runs: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Stride, batch size, threshold and second-pass tag per run.

    The threshold comes from the registry text, else from the run's validation curve.
    """
    size = F.coalesce(F.col("patch_size").cast("int"), F.lit(512))
    df = runs.withColumns(
        {
            "patch_size": size,
            "stride": F.when(size >= 1024, 512).when(size >= 512, 256).otherwise(F.floor(size / 2)).cast("int"),
            "batch_size": F.when(size >= 1024, 2).when(size >= 512, 4).otherwise(8),
            "_written": parse_threshold(F.col("f2_threshold")),
        }
    )
    if points is not None:
        curve = best_threshold(points.where("split = 'val'"), beta=2.0, by=("run_id",)).withColumnRenamed("threshold", "_curve")
        df = df.join(curve, "run_id", "left")
    else:
        df = df.withColumn("_curve", F.lit(None).cast("double"))
    df = df.withColumn("threshold", F.coalesce("_written", "_curve")).drop("_written", "_curve")
    second = F.col("threshold").isNotNull() & (F.abs(F.col("threshold") - 0.5) >= 0.01)
    tag = F.concat(F.lit("_t"), F.round(F.col("threshold") * 1000).cast("int").cast("string"))
    return df.withColumns({"second_pass": F.coalesce(second, F.lit(False)), "tag": F.when(second, tag)})


# ---------------------------------------------------------------- histories


def best_so_far(history: DataFrame, *, by: str = "run_id", epoch: str = "epoch", metric: str = "val_iou") -> DataFrame:
    """Add the best value of earlier epochs and whether the epoch beats it."""
    run = running_totals(history, epoch, {}, prior_max={"best_before": metric}, by=(by,))
    better = F.col(metric) > F.coalesce("best_before", F.lit(0.0))
    return run.withColumn("is_best", F.coalesce(better, F.lit(False)))


def best_epoch(history: DataFrame, *, by: str = "run_id", epoch: str = "epoch", metric: str = "val_iou") -> DataFrame:
    """First epoch with the best value of each run."""
    return history.groupBy(by).agg(
        F.max_by(epoch, F.struct(F.col(metric), -F.col(epoch))).alias("best_epoch"), F.max(metric).alias("best_value")
    )


def patience_stop(
    history: DataFrame,
    *,
    patience: int = 10,
    min_delta: float = 1e-4,
    mode: str = "max",
    by: str = "run_id",
    epoch: str = "epoch",
    metric: str = "val_iou",
) -> DataFrame:
    """Epoch at which training stops and the best epoch then; the stop is null if patience never runs out.

    Positions and earlier maxima are computed in buckets, so a long run is shared
    by many tasks.  Only a new best can reset the counter; the sequential minimum-gain
    rule walks those few epochs in order, holding one run's state at a time.
    """
    if mode not in ("max", "min"):
        raise ValueError(f"unknown mode: {mode}")
    signed = F.col(metric) if mode == "max" else -F.col(metric)
    numbered = running_totals(
        history.select(by, epoch, signed.alias(metric), F.lit(1).alias("_one")), epoch, {"_pos": "_one"}, prior_max={"_best": metric}, by=(by,)
    ).withColumn("_pos", F.col("_pos") - 1)
    numbered = cut_lineage(numbered, "numbered-epochs")
    records = numbered.where(F.col("_best").isNull() | (F.col(metric) > F.col("_best")))
    walked = (
        records.select(F.col(by).alias("run"), F.col("_pos").alias("pos"), F.col(metric).cast("double").alias("value"))
        .repartition("run")
        .sortWithinPartitions("run", "pos")
        .mapInPandas(_walk_records(patience, min_delta), numbered.select(F.col(by).alias("run"), F.col("_pos").alias("best_pos")).schema)
    )
    lengths = numbered.groupBy(F.col(by).alias("_run")).agg(F.max("_pos").alias("_last"))
    ended = walked.join(lengths, walked["run"] == lengths["_run"]).select(
        F.col("run").alias(by),
        "best_pos",
        F.when(F.col("best_pos") + patience <= F.col("_last"), F.col("best_pos") + patience).alias("stop_pos"),
    )

    def epoch_at(position: str, name: str) -> DataFrame:
        return numbered.select(F.col(by).alias(f"_r_{name}"), F.col("_pos").alias(position), F.col(epoch).alias(name))

    best, stop = epoch_at("_bp", "best_epoch"), epoch_at("_sp", "stop_epoch")
    return (
        ended.join(best, (ended[by] == best["_r_best_epoch"]) & (ended["best_pos"] == best["_bp"]))
        .join(stop, (ended[by] == stop["_r_stop_epoch"]) & (ended["stop_pos"] == stop["_sp"]), "left")
        .select(by, "best_epoch", "stop_epoch")
    )


def _walk_records(patience: int, min_delta: float):
    """Fold over new-best epochs sorted by run and position: the position of the best one when patience runs out."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, pos, value, stopped = None, 0, 0.0, False
        for batch in batches:
            done = []
            for r, p, v in zip(batch["run"], batch["pos"], batch["value"]):
                if r != run:
                    if run is not None:
                        done.append((run, pos))
                    run, pos, value, stopped = r, p, v, False
                elif not stopped:
                    if p > pos + patience:
                        stopped = True
                    elif v > value + min_delta:
                        pos, value = p, v
            yield pd.DataFrame(done, columns=["run", "best_pos"])
        if run is not None:
            yield pd.DataFrame([(run, pos)], columns=["run", "best_pos"])

    return walk


def resume_history(stored: DataFrame, new: DataFrame, start_epoch: int) -> DataFrame:
    """Stored epochs before ``start_epoch`` followed by the new ones."""
    return stored.where(F.col("epoch") < start_epoch).unionByName(new)
