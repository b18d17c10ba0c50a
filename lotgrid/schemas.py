"""Column types shared by the operators, and the column check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LINE = T.ArrayType(POINT)
GEOM = T.ArrayType(T.ArrayType(LINE))  # polygons -> rings (shell first) -> closed points

PARCELS = T.StructType(
    [
        T.StructField("bbl", T.LongType()),
        T.StructField("bldg_class", T.StringType()),
        T.StructField("land_use", T.StringType()),
        T.StructField("borough", T.StringType()),
        T.StructField("boro_code", T.IntegerType()),
        T.StructField("address", T.StringType()),
        T.StructField("lot_area", T.DoubleType()),
        T.StructField("num_bldgs", T.DoubleType()),
        T.StructField("bldg_area", T.DoubleType()),
        T.StructField("built_far", T.DoubleType()),
        T.StructField("geom", GEOM),
    ]
)

PIXELS = T.StructType(
    [T.StructField("prow", T.IntegerType()), T.StructField("pcol", T.IntegerType())]
    + [T.StructField(band, T.ShortType()) for band in ("r", "g", "b", "n")]
)

METRIC_FIELDS = ("iou", "dice", "precision", "recall", "f1", "f2", "kappa", "average_precision")

_METRICS = T.StructType([T.StructField(name, T.DoubleType()) for name in METRIC_FIELDS])

RUN_METRICS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("model_type", T.StringType()),
        T.StructField("encoder_name", T.StringType()),
        T.StructField("best_epoch", T.LongType()),
        T.StructField("note", T.StringType()),
        T.StructField("trained_at", T.StringType()),
        T.StructField(
            "model",
            T.StructType(
                [
                    T.StructField("type", T.StringType()),
                    T.StructField("encoder_name", T.StringType()),
                    T.StructField("in_channels", T.LongType()),
                    T.StructField("use_building_prob", T.BooleanType()),
                ]
            ),
        ),
        T.StructField(
            "training",
            T.StructType(
                [
                    T.StructField("batch_size", T.LongType()),
                    T.StructField("learning_rate", T.DoubleType()),
                    T.StructField("oversample_factor", T.LongType()),
                    T.StructField("min_vacant_pixels", T.LongType()),
                    T.StructField("band_dropout_p", T.DoubleType()),
                    T.StructField("cosine_t_max", T.LongType()),
                    T.StructField("seed", T.LongType()),
                ]
            ),
        ),
        T.StructField(
            "loss",
            T.StructType(
                [T.StructField(n, T.DoubleType()) for n in ("pos_weight", "bce_weight", "dice_weight", "lovasz_weight")]
            ),
        ),
        T.StructField("metrics", T.StructType([T.StructField("val", _METRICS), T.StructField("test", _METRICS)])),
    ]
)

RUN_CONFIG = T.StructType(
    [
        T.StructField(
            "data_paths",
            T.StructType([T.StructField(n, T.StringType()) for n in ("vrt", "vacancy_mask", "borough_mask", "patch_splits")]),
        ),
        T.StructField("patch", T.StructType([T.StructField("size", T.LongType())])),
        T.StructField("eval_stride", T.LongType()),
    ]
)

HISTORY_EPOCH = T.StructType(
    [T.StructField("epoch", T.IntegerType())]
    + [
        T.StructField(n, T.DoubleType())
        for n in ("train_loss", "train_iou", "val_loss", "val_iou", "val_dice", "val_precision", "val_recall", "val_kappa", "lr")
    ]
)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise if a column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
