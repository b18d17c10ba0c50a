"""Parcel labelling, overrides, filters and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgrid.functions import attributes as A
from lotgrid.functions import geometry as G
from lotgrid.operators.ranking import column_quantiles, hash_positions, sample_exact
from lotgrid.schemas import require_columns


def label_vacancy(parcels: DataFrame, codes, *, code_col: str = "bldg_class", prefix: int | None = None) -> DataFrame:
    require_columns(parcels, [code_col])
    return parcels.withColumn("is_vacant", A.is_vacant(F.col(code_col), codes, prefix))


def vacancy_share(labelled: DataFrame) -> DataFrame:
    v = F.col("is_vacant").cast("int")
    return labelled.agg(F.count("*").alias("parcels"), F.sum(v).alias("vacant"), F.avg(v).alias("vacant_share"))


def building_rules(parcels: DataFrame) -> DataFrame:
    """Add ``potential_vacant`` and ``inconsistent`` from the three building columns."""
    require_columns(parcels, ["num_bldgs", "bldg_area", "built_far"])
    cols = F.col("num_bldgs"), F.col("bldg_area"), F.col("built_far")
    return parcels.withColumns(
        {"potential_vacant": A.potential_vacant(*cols), "inconsistent": A.inconsistent_lot(*cols)}
    )


def land_use_counts(parcels: DataFrame) -> DataFrame:
    """Potential-vacant parcels per land use, null kept and listed last."""
    return (
        building_rules(parcels)
        .where("potential_vacant")
        .groupBy("land_use")
        .agg(F.count("*").alias("parcels"))
        .orderBy(F.asc_nulls_last("land_use"))
    )


def _flagged(df: DataFrame, ids: DataFrame, id_col: str, flag: str) -> DataFrame:
    marks = ids.select(F.col("bbl").alias("_mark")).distinct()
    return df.join(marks, df[id_col] == marks["_mark"], "left").withColumn(flag, F.col("_mark").isNotNull()).drop("_mark")


def omit_parcels(parcels: DataFrame, overrides: DataFrame, id_col: str = "bbl") -> DataFrame:
    omitted = overrides.where(F.col("action") == "omit").select(F.col("bbl").alias("_omit"))
    return parcels.join(omitted, parcels[id_col] == omitted["_omit"], "left_anti")


def apply_overrides(
    parcels: DataFrame,
    overrides: DataFrame,
    codes,
    *,
    code_col: str = "bldg_class",
    id_col: str = "bbl",
    corrections: bool = True,
    keep: str = "all",
) -> DataFrame:
    """Drop omitted parcels, relabel forced ones (non-vacant wins), tag vacancy by 2-character prefix.

    ``keep`` is ``all``, ``vacant`` or ``nonvacant``.
    """
    df = omit_parcels(parcels, overrides, id_col)
    if corrections:
        marks = (
            overrides.where(F.col("action") != "omit")
            .groupBy(F.col("bbl").alias("_mark"))
            .agg(
                F.max((F.col("action") == "force_vacant").cast("int")).alias("_fv"),
                F.max((F.col("action") == "force_nonvacant").cast("int")).alias("_fn"),
            )
        )
        df = (
            df.join(marks, df[id_col] == marks["_mark"], "left")
            .withColumn(
                code_col, F.when(F.col("_fn") == 1, F.lit("XX")).when(F.col("_fv") == 1, F.lit("V0")).otherwise(F.col(code_col))
            )
            .drop("_mark", "_fv", "_fn")
        )
    df = label_vacancy(df, codes, code_col=code_col, prefix=2)
    if keep == "vacant":
        return df.where("is_vacant")
    if keep == "nonvacant":
        return df.where(~F.col("is_vacant"))
    return df


def unmatched_overrides(overrides: DataFrame, parcels: DataFrame, id_col: str = "bbl") -> DataFrame:
    """Forced ids that no parcel carries, sorted."""
    ids = parcels.select(F.col(id_col).alias("_id"))
    return (
        overrides.where(F.col("action") != "omit")
        .join(ids, overrides["bbl"] == ids["_id"], "left_anti")
        .select("bbl", "action")
        .distinct()
        .orderBy("bbl", "action")
    )


def with_measures(parcels: DataFrame, geom: str = "geom") -> DataFrame:
    """Add area, perimeter, centroid and bounding box."""
    g = F.col(geom)
    return (
        parcels.withColumns(
            {"area_m2": G.area(g), "perimeter_m": G.perimeter(g), "_c": G.centroid(g), "_b": G.bounds(g)}
        )
        .select("*", F.col("_c.x").alias("cx"), F.col("_c.y").alias("cy"), "_b.*")
        .drop("_c", "_b")
    )


def drop_small(parcels: DataFrame, min_pixels: int, resolution: float, *, label: str | None = None) -> DataFrame:
    """Keep parcels of at least ``min_pixels`` cells and, if named, with a non-null label."""
    kept = parcels.where(F.col("area_m2") >= F.lit(float(min_pixels * resolution**2)))
    return kept.where(F.col(label).isNotNull()) if label else kept


def size_filter_counts(parcels: DataFrame, min_pixels: int, resolution: float, label: str) -> DataFrame:
    """Rows before, after the size filter and after the label filter, in one pass."""
    big = F.col("area_m2") >= F.lit(float(min_pixels * resolution**2))
    return parcels.agg(
        F.count("*").alias("parcels"),
        F.count_if(big).alias("large_enough"),
        F.count_if(big & F.col(label).isNotNull()).alias("with_label"),
    )


_BOX = ("xmin", "ymin", "xmax", "ymax")


def within_extent(parcels: DataFrame, extent: dict[str, Column]) -> DataFrame:
    """Parcels whose bounding box meets the extent (a cheap test ahead of any exact one)."""
    return parcels.where(G.boxes_overlap({c: F.col(c) for c in _BOX}, extent))


def neighbourhood_window(parcels: DataFrame, parcel_id, pad: float, id_col: str = "bbl") -> DataFrame:
    """Square window around one parcel: half side = max(width, height)/2 + pad."""
    target = parcels.where(F.col(id_col) == parcel_id)
    half = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) / 2.0 + pad
    cx, cy = (F.col("xmin") + F.col("xmax")) / 2.0, (F.col("ymin") + F.col("ymax")) / 2.0
    return target.select(
        (cx - half).alias("wxmin"), (cy - half).alias("wymin"), (cx + half).alias("wxmax"), (cy + half).alias("wymax")
    )


def parcels_around(parcels: DataFrame, parcel_id, pad: float, id_col: str = "bbl") -> DataFrame:
    """Parcels meeting the window around ``parcel_id`` with their boxes clipped to it."""
    if parcel_id is None:
        raise ValueError("a parcel id is required")
    window = neighbourhood_window(parcels, parcel_id, pad, id_col).select(F.struct("*")).scalar()
    side = {c: window["w" + c] for c in _BOX}
    return within_extent(parcels, side).withColumns(
        {
            "xmin": F.greatest("xmin", side["xmin"]),
            "ymin": F.greatest("ymin", side["ymin"]),
            "xmax": F.least("xmax", side["xmax"]),
            "ymax": F.least("ymax", side["ymax"]),
        }
    )


def clean_attributes(parcels: DataFrame) -> DataFrame:
    """Normalised land use and class prefixes with their labels."""
    return parcels.withColumns(
        {
            "land_use_code": A.clean_land_use(F.col("land_use")),
            "land_use_label": A.land_use_label(F.col("land_use")),
            "class_prefix": A.class_prefix(F.col("bldg_class")),
            "class_code": A.class_prefix(F.col("bldg_class"), 2),
            "class_label": A.class_prefix_label(F.col("bldg_class")),
        }
    )


def clip_percentiles(df: DataFrame, value: str, clip: float = 0.95) -> DataFrame:
    """Rows inside the central ``clip`` share of the column, both ends included, nulls dropped."""
    tail = (1.0 - clip) / 2.0
    ends = column_quantiles(df, [value], [tail, 1.0 - tail])[value]
    if not ends:
        return df.where(F.col(value).isNotNull())
    # Two numbers by now, so the range test is pushed into the scan.
    return df.where(F.col(value).between(ends[tail], ends[1.0 - tail]))


def sample_category(parcels: DataFrame, sampled: DataFrame, test: DataFrame, id_col: str = "bbl") -> DataFrame:
    """1 train/other, 2 train/vacant, 3 test/other, 4 test/vacant; unsampled parcels dropped.

    ``sampled`` and ``test`` are id tables, the test ids being part of the sample.
    """
    df = _flagged(_flagged(parcels, sampled, id_col, "_in"), test, id_col, "_test")
    code = (
        F.when(~F.col("_in"), 0)
        .otherwise(F.when(F.col("_test"), 3).otherwise(1) + F.col("is_vacant").cast("int"))
    )
    return df.withColumn("category", code).where("category > 0").drop("_in", "_test")


def filter_scenes(scenes: DataFrame, excluded_dates) -> tuple[DataFrame, DataFrame]:
    """(kept scenes, one-row excluded count); the date is the last token of the scene name."""
    dated = scenes.withColumn("name_date", A.name_date(F.col("scene_id")))
    out = F.col("name_date").isin(list(excluded_dates)) if excluded_dates else F.lit(False)
    return dated.where(~out), dated.agg(F.count_if(out).alias("excluded"))


def select_counties(counties: DataFrame, names, state: str) -> DataFrame:
    return counties.where(F.col("name").isin(list(names)) & (F.col("statefp") == state))


def merge_region(counties: DataFrame) -> DataFrame:
    """One multi-part geometry of the selected counties.

    Only a handful of named counties reaches this point, never a parcel table.
    """
    return counties.agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("name", "geom"))), lambda s: s.geom)).alias("geom"),
        F.count("*").alias("parts"),
    )


def two_stratum_sample(
    parcels: DataFrame, codes, total: int, target_share: float, *, label: str = "land_use", key: str = "bbl", seed: int = 42
) -> DataFrame:
    """int(total*share) parcels from the target codes, the rest from the others, each capped by supply."""
    n_target = int(total * target_share)
    tagged = parcels.withColumn("_target", F.coalesce(F.col(label).isin(list(codes)), F.lit(False)))
    size = F.when(F.col("_target"), F.lit(n_target)).otherwise(F.lit(total - n_target))
    return sample_exact(tagged, size, key, seed=seed, strata=("_target",)).withColumnRenamed("_target", "is_target")


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: the first round(share * n) rows of each stratum in hash order."""
    p = hash_positions(df, key, by=label, seed=seed)
    return p.withColumn("is_test", F.col("_pos") < F.round(F.col("_size") * F.lit(test_share))).drop("_pos", "_size")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..folds-1, sizes within a stratum differing by at most one."""
    p = hash_positions(df, key, by=label, seed=seed)
    return p.withColumn("fold", (F.col("_pos") % folds).cast("int")).drop("_pos", "_size")
