"""Missing values, feature selection and scaling for tabular models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgrid.operators.ranking import column_quantiles
from lotgrid.schemas import require_columns

METHODS = ("median", "mean", "drop")


def select_features(df: DataFrame, suffixes=("_mean", "_stdDev")) -> list[str]:
    """Columns that end in one of the suffixes, sorted."""
    return sorted(c for c in df.columns if c.endswith(tuple(suffixes)))


def _stacked(df: DataFrame, columns) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")


def fill_values(df: DataFrame, columns, method: str = "median") -> dict[str, float | None]:
    """The exact median or the mean of each column; None for a column without values."""
    require_columns(df, columns)
    if method == "median":
        return {c: q.get(0.5) for c, q in column_quantiles(df, columns, [0.5]).items()}
    if method == "mean":
        return df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    raise ValueError(f"unknown imputation method: {method}")


@dataclass(frozen=True)
class Imputer:
    """Fitted fill values: a handful of numbers, kept with the model so new rows use the training ones."""

    method: str
    values: dict[str, float | None]

    def apply(self, df: DataFrame) -> DataFrame:
        if self.method == "drop":
            return df.dropna(subset=list(self.values))
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.values.items()})


def fit_imputer(df: DataFrame, columns, method: str = "median") -> Imputer:
    if method not in METHODS:
        raise ValueError(f"unknown imputation method: {method}")
    require_columns(df, columns)
    if method == "drop":
        return Imputer(method, {c: float("nan") for c in columns})
    return Imputer(method, fill_values(df, columns, method))


def impute(df: DataFrame, columns, method: str = "median") -> DataFrame:
    """Fill or drop missing values with the table's own statistics."""
    return fit_imputer(df, columns, method).apply(df)


def missing_counts(df: DataFrame, columns) -> DataFrame:
    """(feature, filled): cells that imputation fills."""
    return _stacked(df, columns).groupBy("feature").agg(F.count_if(F.col("value").isNull()).alias("filled"))


@dataclass(frozen=True)
class Scaler:
    """Fitted mean and population standard deviation per feature."""

    mean: dict[str, float]
    std: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(self.mean[c])) / F.lit(self.std[c] or 1.0) for c in self.mean})


def _moments(columns) -> list[Column]:
    return [f(F.col(c)).alias(f"{k}_{c}") for c in columns for k, f in (("mean", F.avg), ("std", F.stddev_pop))]


def fit_scaler(df: DataFrame, columns) -> Scaler:
    row = df.agg(*_moments(columns)).first()
    return Scaler({c: row[f"mean_{c}"] for c in columns}, {c: row[f"std_{c}"] for c in columns})


def standardise(df: DataFrame, columns) -> DataFrame:
    """Fit and transform in one plan; a constant column becomes 0."""
    row = df.agg(F.struct(*_moments(columns))).scalar()
    return df.withColumns({c: F.coalesce((F.col(c) - row[f"mean_{c}"]) / F.nullif(row[f"std_{c}"], F.lit(0.0)), F.col(c) - row[f"mean_{c}"]) for c in columns})
