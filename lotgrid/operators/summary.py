"""Descriptive summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotgrid.operators.ranking import column_quantiles
from lotgrid.schemas import require_columns

QUARTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, columns) -> DataFrame:
    """count, mean, std (n-1), min, quartiles and max per column, one row per feature.

    The columns are aggregated side by side in one pass; quartiles are exact.
    """
    require_columns(df, columns)
    columns = list(columns)
    quartiles = column_quantiles(df, columns, QUARTILES)
    measures = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[F.struct(*[f(F.col(c).cast("double")).alias(m) for m, f in measures.items()]).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                *[F.col(f"_{i}")[m].alias(m) for m in ("n", "mean", "std", "min")],
                *[F.lit(quartiles[c].get(p)).cast("double").alias(name) for p, name in zip(QUARTILES, ("q25", "q50", "q75"))],
                F.col(f"_{i}")["max"].alias("max"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.inline(rows))


def value_counts(df: DataFrame, column: str, n: int | None = 10) -> DataFrame:
    """Counts per value with nulls, largest first, value as tie-break."""
    out = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column))
    return out if n is None else out.limit(n)


def histogram(df: DataFrame, value: str, bins: int = 50, *, by=(), low=None, high=None) -> DataFrame:
    """Equal-width bins over [low, high] (the column's own range by default), last bin closed; empty bins absent."""
    by = list(by)
    stats = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    ends = stats.select(F.struct("*")).scalar()
    lo = F.lit(float(low)) if low is not None else ends.lo
    hi = F.lit(float(high)) if high is not None else ends.hi
    width = (hi - lo) / bins
    index = F.least(F.floor((F.col(value) - lo) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    return (
        df.where(F.col(value).between(lo, hi))
        .groupBy(*by, F.coalesce(index, F.lit(0)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
        .select(*by, "bin", (lo + F.col("bin") * width).alias("left_edge"), (lo + (F.col("bin") + 1) * width).alias("right_edge"), "n")
    )


def share_within(counts: DataFrame, n: str, by, alias: str = "share") -> DataFrame:
    """Share of each row's count in its group, over an already aggregated table."""
    return counts.withColumn(alias, F.col(n) / F.sum(n).over(Window.partitionBy(*by)))


def cluster_composition(df: DataFrame, cluster: str, category: str, values) -> DataFrame:
    """Share of each category inside each cluster, pivoted, missing = 0."""
    counts = df.where(F.col(category).isNotNull()).groupBy(cluster, category).agg(F.count("*").alias("n"))
    shares = share_within(counts, "n", [cluster])
    return shares.groupBy(cluster).pivot(category, list(values)).agg(F.sum("share")).fillna(0.0)


def merge_codes(code: Column, codes, label: str) -> Column:
    """Replace any of ``codes`` by one label, for example all vacant classes."""
    return F.when(code.isin(list(codes)), F.lit(label)).otherwise(code)


def cluster_means(df: DataFrame, cluster: str, features) -> DataFrame:
    return df.groupBy(cluster).agg(*[F.avg(f).alias(f) for f in features])


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    counts = df.groupBy(cluster).agg(F.count("*").alias("n"))
    return share_within(counts.withColumn("_all", F.lit(1)), "n", ["_all"], "pct").withColumn("pct", F.col("pct") * 100).drop("_all")


def channel_stats(df: DataFrame, patch_keys, channels) -> DataFrame:
    """Mean and population std per patch and channel."""
    long = df.unpivot(list(patch_keys), list(channels), "channel", "value")
    return long.groupBy(*patch_keys, "channel").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def channel_histogram(df: DataFrame, patch_keys, channels, low: float, high: float, bins: int = 80) -> DataFrame:
    """Fixed-range histogram per patch and channel."""
    long = df.unpivot(list(patch_keys), list(channels), "channel", "value")
    return histogram(long, "value", bins, by=[*patch_keys, "channel"], low=low, high=high)


def mean_and_spread(df: DataFrame, by, value: str) -> DataFrame:
    """Mean and population std, the cross-validation summary."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("folds"))


def exploratory_bundle(parcels: DataFrame, features, categories, codes) -> dict[str, DataFrame]:
    """The standard first look at a parcel table, every part lazy."""
    from lotgrid.operators import parcels as P

    ruled = P.building_rules(parcels)
    bundle = {
        "describe": describe(parcels, features),
        "potential_vacant": ruled.where("potential_vacant"),
        "inconsistent": ruled.where("inconsistent"),
        "land_use_counts": P.land_use_counts(parcels),
        "vacancy_share": P.vacancy_share(P.label_vacancy(parcels, codes)),
    }
    bundle.update({f"top_{c}": value_counts(parcels, c) for c in categories})
    return bundle


def union_all(frames) -> DataFrame:
    """Row concatenation by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)
