"""Change between two parcel vintages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotgrid.functions import geometry as G
from lotgrid.functions.attributes import is_vacant
from lotgrid.schemas import require_columns
from lotgrid.session import cut_lineage

CATEGORIES = ["remained_vacant", "became_vacant", "developed"]


def tag_vintage(parcels: DataFrame, codes, code_col: str = "bldg_class") -> tuple[DataFrame, DataFrame]:
    """(all parcels with ``is_vacant``, the vacant ones)."""
    tagged = parcels.withColumn("is_vacant", is_vacant(F.col(code_col), codes))
    return tagged, tagged.where("is_vacant")


def join_vintages(first: DataFrame, second: DataFrame, key: str = "bbl") -> DataFrame:
    """Full outer join on the integer id; every column gets a _y1/_y2 suffix plus ``side`` and the id as text.

    Null ids are removed first, so they neither match nor pile up on one task.
    """

    def keyed(df: DataFrame, suffix: str) -> DataFrame:
        ids = F.col(key).cast("bigint")
        return df.where(F.col(key).isNotNull()).select(
            ids.alias(f"_k{suffix}"), *[F.col(c).alias(f"{c}_{suffix}") for c in df.columns]
        )

    a, b = keyed(first, "y1"), keyed(second, "y2")
    joined = a.join(b, a["_ky1"] == b["_ky2"], "full_outer")
    side = (
        F.when(F.col("_ky1").isNotNull() & F.col("_ky2").isNotNull(), "both")
        .when(F.col("_ky1").isNotNull(), "left_only")
        .otherwise("right_only")
    )
    return joined.select(
        F.coalesce("_ky2", "_ky1").cast("string").alias("bbl_key"), side.alias("side"), *[c for c in joined.columns if not c.startswith("_k")]
    )


def classify_change(joined: DataFrame) -> DataFrame:
    """Add ``change_category``; "unchanged" where nothing applies."""
    v1, v2 = F.coalesce("is_vacant_y1", F.lit(False)), F.coalesce("is_vacant_y2", F.lit(False))
    both, left, right = (F.col("side") == s for s in ("both", "left_only", "right_only"))
    category = (
        F.when(both & v1 & v2, "remained_vacant")
        .when((both & ~v1 & v2) | (right & v2), "became_vacant")
        .when((both & v1 & ~v2) | (left & v1), "developed")
        .otherwise("unchanged")
    )
    return joined.withColumn("change_category", category)


def changed_parcels(first: DataFrame, second: DataFrame, key: str = "bbl") -> DataFrame:
    """Changed parcels with resolved attributes, geometry and area."""
    for df in (first, second):
        require_columns(df, [key, "bldg_class", "borough", "lot_area", "is_vacant", "geom"])
    wanted = [key, "bldg_class", "borough", "lot_area", "is_vacant", "geom"]
    joined = classify_change(join_vintages(first.select(wanted), second.select(wanted), key))
    newer = F.col("change_category").isin("remained_vacant", "became_vacant")
    geom = F.coalesce(F.when(newer, F.col("geom_y2")).otherwise(F.col("geom_y1")), "geom_y2", "geom_y1")
    return (
        joined.where(F.col("change_category") != "unchanged")
        .select(
            F.coalesce(f"{key}_y2", f"{key}_y1").alias(key),
            "bbl_key",
            "change_category",
            "bldg_class_y1",
            "bldg_class_y2",
            F.coalesce("borough_y2", "borough_y1").alias("borough"),
            F.col("lot_area_y2").alias("lot_area"),
            geom.alias("geom"),
        )
        .withColumn("area_m2", G.area(F.col("geom")))
    )


def change_stats(changes: DataFrame) -> DataFrame:
    """Count and area per (borough, category) and for ALL boroughs.

    The parcels are aggregated once; the grouping sets run over that small table, so
    no parcel row is doubled.  Parcels without a borough count in ALL only.
    """
    base = changes.groupBy("borough", "change_category").agg(F.count("*").alias("parcels"), F.sum("area_m2").alias("area"))
    return (
        base.groupingSets([["borough", "change_category"], ["change_category"]], "borough", "change_category")
        .agg(F.sum("parcels").alias("parcels"), F.sum("area").alias("total_area_m2"), F.grouping("borough").alias("_all"))
        .where((F.col("_all") == 1) | F.col("borough").isNotNull())
        .select(
            F.when(F.col("_all") == 1, "ALL").otherwise(F.col("borough")).alias("borough"),
            "change_category",
            "parcels",
            "total_area_m2",
        )
    )


def change_pivot(stats: DataFrame, categories=tuple(CATEGORIES)) -> DataFrame:
    """Borough x category counts, 0 where nothing happened."""
    return stats.groupBy("borough").pivot("change_category", list(categories)).agg(F.sum("parcels")).fillna(0)


def hotspots(
    changes: DataFrame, *, cell: float = 500.0, top_n: int = 10, categories=("became_vacant", "developed")
) -> DataFrame:
    """Rectangles of 3x3 cells around the densest change cells, recounted inside.

    Change centroids are counted once per cell, apart by which edges of their cell they lie
    on.  A rectangle takes its cells' counts and leaves out, along its own edges, those that
    lie on them, which is the strict inside test; no centroid is looked at a second time.
    """
    # Read three times below, so the vintage join is stored once in this narrow form.
    located = cut_lineage(
        changes.select("change_category", G.centroid(F.col("geom")).alias("c"), G.bounds(F.col("geom")).alias("b"))
    )
    counted = F.col("change_category").isin(list(categories))
    extent = located.where(counted).agg(
        F.min("b.xmin").alias("x0"), F.min("b.ymin").alias("y0"), F.max("b.xmax").alias("x1"), F.max("b.ymax").alias("y1")
    )
    e = extent.select(F.struct("*")).scalar()
    x0, y0 = e.x0, e.y0
    # Bin edges run x0, x0+cell, ... up to the first edge not below the maximum.
    nx = F.ceil((e.x1 - x0) / cell)
    ny = F.ceil((e.y1 - y0) / cell)
    last_x, last_y = F.greatest(nx, F.lit(1)) - 1, F.greatest(ny, F.lit(1)) - 1
    binned = located.where(F.col("change_category").isin([*categories, "remained_vacant"])).select(
        "change_category",
        F.col("c.x").alias("cx"),
        F.col("c.y").alias("cy"),
        # The last bin is closed on the right.
        F.least(F.floor((F.col("c.x") - x0) / cell), last_x).alias("ix"),
        F.least(F.floor((F.col("c.y") - y0) / cell), last_y).alias("iy"),
    )
    # Which edges of its own cell a centroid lies on, or beyond by rounding.
    on = {
        "_left": F.col("cx") <= x0 + F.col("ix") * cell,
        "_right": F.col("cx") >= x0 + (F.col("ix") + 1) * cell,
        "_low": F.col("cy") <= y0 + F.col("iy") * cell,
        "_high": F.col("cy") >= y0 + (F.col("iy") + 1) * cell,
    }
    cells = cut_lineage(binned.withColumns(on).groupBy("ix", "iy", *on, "change_category").agg(F.count("*").alias("n")), "change-cells")
    top = cells.where(counted).groupBy("ix", "iy").agg(F.sum("n").alias("seed_count")).orderBy(F.desc("seed_count"), "ix", "iy").limit(top_n)
    columns, lines = F.greatest(nx, F.lit(1)), F.greatest(ny, F.lit(1))
    first_x, first_y = F.greatest(F.col("ix") - 1, F.lit(0)), F.greatest(F.col("iy") - 1, F.lit(0))
    end_x, end_y = F.least(F.col("ix") + 2, columns), F.least(F.col("iy") + 2, lines)
    seeds = top.select(
        F.col("ix").alias("sx"),
        F.col("iy").alias("sy"),
        first_x.alias("_x0"),
        (end_x - 1).alias("_x1"),
        first_y.alias("_y0"),
        (end_y - 1).alias("_y1"),
        (x0 + first_x * cell).alias("xmin"),
        (y0 + first_y * cell).alias("ymin"),
        (x0 + end_x * cell).alias("xmax"),
        (y0 + end_y * cell).alias("ymax"),
    )
    covered = seeds.withColumn("_ix", F.explode(F.sequence("_x0", "_x1"))).withColumn("_iy", F.explode(F.sequence("_y0", "_y1")))
    on_edge = (
        (F.col("_left") & (F.col("ix") == F.col("_x0")))
        | (F.col("_right") & (F.col("ix") == F.col("_x1")))
        | (F.col("_low") & (F.col("iy") == F.col("_y0")))
        | (F.col("_high") & (F.col("iy") == F.col("_y1")))
    )
    names = ("became_vacant", "developed", "remained_vacant")

    def total(which: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))

    recount = (
        cells.join(covered, (F.col("ix") == F.col("_ix")) & (F.col("iy") == F.col("_iy")))
        .where(~on_edge)
        .groupBy("sx", "sy")
        .agg(total(counted).alias("total_change"), *[total(F.col("change_category") == c).alias(f"{c}_count") for c in names])
        .select(F.col("sx").alias("_sx"), F.col("sy").alias("_sy"), "total_change", *[f"{c}_count" for c in names])
    )
    # At most top_n rows from here on.
    rank = Window.orderBy(F.desc("total_change"), "sx", "sy")
    return (
        seeds.join(recount, (seeds["sx"] == recount["_sx"]) & (seeds["sy"] == recount["_sy"]), "left")
        .fillna(0, ["total_change", "became_vacant_count", "developed_count", "remained_vacant_count"])
        .withColumn("hotspot_id", F.row_number().over(rank))
        .select(
            "hotspot_id", "xmin", "ymin", "xmax", "ymax", "total_change", "became_vacant_count", "developed_count", "remained_vacant_count"
        )
    )


def change_layers(first: DataFrame, second: DataFrame, changes: DataFrame, spots: DataFrame) -> dict[str, DataFrame]:
    """Named export layers: both vacant sets, all changes, one per category, hotspots."""
    layers = {"vacant_y1": first.where("is_vacant"), "vacant_y2": second.where("is_vacant"), "change": changes}
    layers.update({c: changes.where(F.col("change_category") == c) for c in CATEGORIES})
    layers["hotspots"] = spots
    return layers
