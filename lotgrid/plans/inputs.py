"""Parcel, raster and score tables derived from the driver's star-schema tables.

Every adapter is a projection of a whole table, so its size follows the data.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotgrid.functions import geometry as G
from lotgrid.functions.attributes import BOROUGHS, lookup
from lotgrid.functions.grid import Grid
from lotgrid.functions.hashing import hash32
from lotgrid.operators import tiles as TL
from lotgrid.operators.patches import covering_patches
from lotgrid.schemas import METRIC_FIELDS
from lotgrid.session import cut_lineage

WIDTH = 128
VACANT_CODES = ["M7"] + [f"E{i}" for i in range(10)]


def div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))

# Entries of an embedding, all of them features.
N_FEATURES = 64


class Inputs:
    """Tables of one scale-factor folder seen through the adapters."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    # ---------------------------------------------------------------- parcels

    def vintage(self, year: int) -> DataFrame:
        """Parcel vintage 1 or 2: lots recorded since 2001 are new in vintage 2, urgent lots of 1995 are gone from it."""
        o = self.table("orders")
        late = F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")
        retired = (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderpriority") != "5-LOW")
        code = F.col("o_orderstatus") if year == 1 else F.substring("o_orderpriority", 1, 1)
        x, y = (F.col("o_custkey") * 37) % 5000, (F.col("o_orderkey") * 53) % 5000
        side = F.col("o_orderkey") % 20 + 5
        return o.where(~late if year == 1 else ~retired).select(
            F.col("o_orderkey").alias("bbl"),
            code.alias("bldg_class"),
            F.col("o_orderpriority").alias("land_use"),
            lookup((F.col("o_custkey") % 5 + 1).cast("int"), BOROUGHS).alias("borough"),
            F.col("o_totalprice").alias("lot_area"),
            code.isin(["F"] if year == 1 else ["1", "2"]).alias("is_vacant"),
            G.box(x.cast("double"), y.cast("double"), (x + side).cast("double"), (y + side).cast("double")).alias("geom"),
        )

    def _part_columns(self) -> list[Column]:
        """Parcel attributes, with nulls where real tables have them."""
        size = F.col("p_size")

        def unless(missing: Column, value) -> Column:
            return F.when(~missing, value)

        return [
            F.col("p_partkey").alias("bbl"),
            F.concat(F.upper(F.substring("p_type", 1, 1)), (size % 10).cast("string")).alias("bldg_class"),
            unless(size % 13 == 0, (size % 13).cast("string")).alias("land_use"),
            (F.col("p_partkey") % 5 + 1).cast("int").alias("boro_code"),
            F.col("p_retailprice").alias("lot_area"),
            unless(size % 4 == 3, (size % 4).cast("double")).alias("num_bldgs"),
            unless(size % 5 == 0, F.when(size % 5 < 3, 0.0).otherwise(F.col("p_retailprice"))).alias("bldg_area"),
            unless(size % 3 == 0, F.when(size % 3 == 1, 0.0).otherwise(1.5)).alias("built_far"),
        ]

    def _lot_geometry(self) -> Column:
        """Boxes, and right triangles for every third part, spread over the whole raster."""
        key, side = F.col("p_partkey"), F.col("p_size") % 8 + 3
        xl = (key * 37) % WIDTH + 0.25 - side / 2
        yl = -((key * 53) % self.height + 0.25) - side / 2
        xh, yh = xl + side, yl + side
        return F.when(key % 3 == 0, G.polygon([(xl, yl), (xh, yl), (xl, yh)])).otherwise(G.box(xl, yl, xh, yh))

    @cached_property
    def part_attributes(self) -> DataFrame:
        return self.table("part").select(*self._part_columns())

    @cached_property
    def lots(self) -> DataFrame:
        """``part`` as parcels placed over the raster."""
        category = (F.col("p_size") % 5 + 1).cast("int").alias("category")
        return self.table("part").select(*self._part_columns(), category, self._lot_geometry().alias("geom"))

    @cached_property
    def overrides(self) -> DataFrame:
        """Override list from ``supplier``; some ids have no parcel, some have both actions."""
        s = self.table("supplier")
        first = s.select(
            (F.col("s_suppkey") * 23).alias("bbl"),
            F.element_at(F.array(*map(F.lit, ("omit", "force_nonvacant", "force_vacant"))), F.col("s_nationkey") % 3 + 1).alias("action"),
        )
        second = s.select(
            (F.col("s_suppkey") * 46).alias("bbl"),
            F.when(F.col("s_acctbal") > 5000, "force_vacant").otherwise("force_nonvacant").alias("action"),
        )
        return first.unionByName(second)

    # ---------------------------------------------------------------- raster

    @cached_property
    def raster(self) -> DataFrame:
        """Pixels, labels and boroughs of a 128-wide raster, one cell per order."""
        return self.raster_of(self.table("orders"))

    @staticmethod
    def raster_of(orders: DataFrame) -> DataFrame:
        """Raster cells of some orders, a batch table or a stream."""
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        row, col = div(k, WIDTH), k % WIDTH
        block = (31 * div(row, 8) + 17 * div(col, 8)) % 5
        return orders.select(
            row.cast("int").alias("prow"),
            col.cast("int").alias("pcol"),
            ((7 * c + 13 * k) % 256).cast("smallint").alias("r"),
            (F.floor("o_totalprice") % 256).cast("smallint").alias("g"),
            ((31 * k) % 256).cast("smallint").alias("b"),
            ((11 * c + 3 * k) % 256).cast("smallint").alias("n"),
            F.when(block == 0, 1).when(block == 4, 255).otherwise(0).cast("smallint").alias("label"),
            (div(col, 26) + 1).cast("smallint").alias("boro_code"),
        )

    @cached_property
    def tiles(self) -> DataFrame:
        """The raster as stored tiles with all its bands."""
        return cut_lineage(TL.from_cells(self.raster, ["r", "g", "b", "n", "label", "boro_code"]), "raster-tiles")

    @cached_property
    def score_tiles(self) -> DataFrame:
        """The scored cells as stored tiles; ``scored`` marks cells that have a row, with or without a probability."""
        return cut_lineage(TL.from_cells(self.score_cells.withColumn("scored", F.lit(1)), ["prob", "scored"]), "score-tiles")

    @property
    def pixels(self) -> DataFrame:
        return self.raster.select("prow", "pcol", "r", "g", "b", "n")

    @property
    def mask(self) -> DataFrame:
        return self.raster.select("prow", "pcol", "label")

    @property
    def boro(self) -> DataFrame:
        return self.raster.select("prow", "pcol", "boro_code")

    @cached_property
    def height(self) -> Column:
        """Raster height as a scalar subquery."""
        return self.table("orders").agg((div(F.max("o_orderkey"), WIDTH) + 1).cast("int").alias("h")).scalar()

    @cached_property
    def n_rows(self) -> int:
        """Raster height as a number, from one aggregate."""
        return self.table("orders").select(self.height.alias("h")).first()["h"]

    @property
    def grid(self) -> Grid:
        return Grid(width=WIDTH, height=self.height)

    # ---------------------------------------------------------------- overlays

    @cached_property
    def water(self) -> DataFrame:
        k = F.col("s_suppkey")
        x, y, side = (k * 29) % WIDTH + 0.125, -((k * 31) % self.height + 0.125), k % 4 + 2
        return self.table("supplier").select(k.alias("id"), G.box(x, y - side, x + side, y).alias("geom"))

    @cached_property
    def roadbed(self) -> DataFrame:
        k = F.col("c_custkey")
        x, y, side = (k * 41) % WIDTH + 0.375, -((k * 43) % self.height + 0.375), k % 2 + 1
        return self.table("customer").select(k.alias("id"), G.box(x, y - side, x + side, y).alias("geom"))

    @cached_property
    def roads(self) -> DataFrame:
        """Two-point road lines from ``supplier`` with a road class."""
        k = F.col("s_suppkey")
        x, y = (k * 61) % WIDTH + 0.3, -((k * 67) % self.height + 0.7)
        mx = F.element_at(F.array(*map(F.lit, ("S1100", "S1200", "S1400", "S1630"))), F.col("s_nationkey") % 4 + 1)
        ends = F.array(G.point(x, y), G.point(x + (k % 9) + 0.4, y - (k % 5) - 0.15))
        return self.table("supplier").select(k.alias("id"), mx.alias("mtfcc"), F.col("s_nationkey").alias("county"), ends.alias("geom"))

    @cached_property
    def counties(self) -> DataFrame:
        """Five vertical stripes from ``region``, named after it."""
        k = F.col("r_regionkey")
        fips = F.element_at(F.array(*map(F.lit, ("061", "005", "047", "081", "085"))), k + 1)
        h = self.height
        return self.table("region").select(
            F.col("r_name").alias("name"),
            F.lit("36").alias("statefp"),
            fips.alias("countyfp"),
            (k + 1).cast("smallint").alias("boro_code"),
            G.box(k * 26, -h, (k + 1) * 26, F.lit(0)).alias("geom"),
        )

    # ---------------------------------------------------------------- land cover and scenes

    @cached_property
    def landcover(self) -> DataFrame:
        """5x5-cell land-cover grid over the raster, class = (3*row + col) % 7."""
        cells = self.raster.select(div(F.col("prow"), 5).cast("int").alias("lc_row"), div(F.col("pcol"), 5).cast("int").alias("lc_col")).distinct()
        return cells.withColumn("class", ((3 * F.col("lc_row") + F.col("lc_col")) % 7).cast("int"))

    @property
    def coarse_grid(self) -> Grid:
        return Grid(width=26, height=self.height, dx=5.0, dy=5.0)

    @cached_property
    def scenes(self) -> DataFrame:
        """Four dated scenes: the raster's red band shifted by up to three columns."""
        shift = F.explode(F.array(*[F.struct(F.lit(s).alias("shift"), F.lit(d).alias("acq")) for s, d in enumerate(("2021-07-19", "2022-07-19", "2022-08-02", "2023-06-30"))]))
        return self.pixels.select("*", shift.alias("s")).select(
            F.concat(F.lit("m_18_060_"), F.regexp_replace("s.acq", "-", "")).alias("scene_id"),
            F.col("s.acq").cast("date").alias("acq_date"),
            "prow",
            (F.col("pcol") + F.col("s.shift")).cast("int").alias("pcol"),
            "r",
            "g",
            "b",
            "n",
        )

    @cached_property
    def catalogue(self) -> DataFrame:
        """Scene catalogue from ``orders``: footprint, date and a name that ends in the date."""
        k = F.col("o_orderkey")
        west, south = ((F.col("o_custkey") * 37) % 5000).cast("double"), ((k * 53) % 5000).cast("double")
        return self.table("orders").select(
            F.concat(F.lit("m_"), k.cast("string"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd")).alias("scene_id"),
            F.col("o_orderdate").cast("date").alias("acq_date"),
            west.alias("west"),
            south.alias("south"),
            (west + 60).alias("east"),
            (south + 75).alias("north"),
        )

    # ---------------------------------------------------------------- scores

    @cached_property
    def scores(self) -> DataFrame:
        """Scored samples from ``lineitem``."""
        return self.scores_of(self.table("lineitem"))

    @staticmethod
    def scores_of(lineitem: DataFrame) -> DataFrame:
        """Scored samples of some line items, a batch table or a stream."""
        prob = F.greatest(F.least(F.round(F.col("l_discount") * 5 + F.col("l_quantity") / 100, 3), F.lit(1.0)), F.lit(0.0))
        return lineitem.select(
            F.col("l_linestatus").alias("split"),
            F.col("l_linenumber").alias("run_no"),
            prob.alias("prob"),
            (F.col("l_returnflag") == "R").cast("int").alias("y"),
        )

    @cached_property
    def score_cells(self) -> DataFrame:
        """Per-cell probability over the raster, null on the darkest near-infrared cells."""
        return self.raster.select("prow", "pcol", F.when(F.col("n") >= 16, (F.col("r").cast("int") + F.col("b") * 2) % 256 / 255.0).alias("prob"))

    @cached_property
    def patch_scores(self) -> DataFrame:
        """8x8 patches at stride 4 over the raster's full windows; overlapping patches disagree."""
        return self.patch_scores_of(self.raster)

    def patch_scores_of(self, raster: DataFrame) -> DataFrame:
        cells = covering_patches(raster, self.grid, 8, 4)
        value = (F.col("b") + 17 * div(F.col("row_off"), 4) + 5 * div(F.col("col_off"), 4)) % 256
        return cells.select(
            "row_off",
            "col_off",
            (F.col("prow") - F.col("row_off")).alias("i"),
            (F.col("pcol") - F.col("col_off")).alias("j"),
            (value / 255.0).alias("prob"),
            "label",
        )

    # ---------------------------------------------------------------- features

    @cached_property
    def features(self) -> DataFrame:
        """``embeddings`` as parcel statistics: one feature per entry, class = label, vacant = label 0."""
        return self.table("embeddings").select(
            F.col("vec_id").alias("bbl"),
            *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(N_FEATURES)],
            F.col("label"),
            (F.col("label") == 0).cast("int").alias("y"),
        )

    @cached_property
    def features_with_gaps(self) -> DataFrame:
        """Features with values below -0.1 of every fourth column blanked out."""
        gaps = {f"f{i}": F.when(F.col(f"f{i}") >= -0.1, F.col(f"f{i}")) for i in range(0, N_FEATURES, 4)}
        return self.features.withColumns(gaps)

    # ---------------------------------------------------------------- registry

    @cached_property
    def runs(self) -> DataFrame:
        """One training-run record per customer, nested like the stored metrics."""
        k = F.col("c_custkey")

        def unit(seed: int) -> Column:
            return hash32(k, seed) % 1000 / 1000.0

        def metric(first_seed: int) -> Column:
            return F.struct(*[unit(first_seed + i).alias(n) for i, n in enumerate(METRIC_FIELDS)])

        none = F.lit(None)
        return self.table("customer").select(
            F.format_string("%03d", k).alias("run_id"),
            F.when(k % 2 == 0, "unet").when(k % 9 != 0, "deeplabv3plus").alias("model_type"),
            F.when(k % 7 != 0, F.col("c_mktsegment")).alias("encoder_name"),
            (k % 40).alias("best_epoch"),
            F.col("c_name").alias("note"),
            F.lit("2024-05-01").alias("trained_at"),
            F.struct(
                F.lit("cnn").alias("type"), F.lit("resnet").alias("encoder_name"), (k % 2 + 4).alias("in_channels"), (k % 2 == 1).alias("use_building_prob")
            ).alias("model"),
            F.struct(
                (k % 8 + 1).alias("batch_size"),
                F.lit(0.001).alias("learning_rate"),
                *[none.cast("bigint").alias(c) for c in ("oversample_factor", "min_vacant_pixels")],
                none.cast("double").alias("band_dropout_p"),
                *[none.cast("bigint").alias(c) for c in ("cosine_t_max", "seed")],
            ).alias("training"),
            F.struct(
                (k % 30).cast("double").alias("pos_weight"), *[none.cast("double").alias(c) for c in ("bce_weight", "dice_weight", "lovasz_weight")]
            ).alias("loss"),
            F.struct(metric(0).alias("val"), F.when(k % 5 != 0, metric(100)).alias("test")).alias("metrics"),
        )

    @cached_property
    def run_configs(self) -> DataFrame:
        """Run configurations; overdrawn customers have none, three in four leave the patch size to the split file name."""
        k = F.col("c_custkey")
        size = F.element_at(F.array(*map(F.lit, ("256", "512", "1024"))), (k % 3 + 1).cast("int"))
        return self.table("customer").where(F.col("c_acctbal") >= 0).select(
            F.format_string("%03d", k).alias("run_id"),
            F.struct(
                F.concat(F.lit("data/mask_"), F.when(k % 3 == 0, "v2").otherwise("v1"), F.lit(".tif")).alias("vacancy_mask"),
                F.concat(F.lit("data/patch_splits_"), size, F.lit("_s.json")).alias("patch_splits"),
            ).alias("data_paths"),
            F.struct(F.when(k % 4 == 0, F.lit(512).cast("bigint")).alias("size")).alias("patch"),
            F.when(k % 2 == 0, F.lit(256).cast("bigint")).alias("eval_stride"),
        )

    @cached_property
    def registry(self) -> DataFrame:
        """Exported registry rows: text metrics, a hand-entered threshold column."""
        k = F.col("c_custkey")
        threshold = hash32(k, 7) % 1000
        text = F.when(k % 6 == 0, "").when(k % 6 == 1, (threshold / 10.0).cast("string")).otherwise((threshold / 1000.0).cast("string"))
        return self.table("customer").select(
            F.format_string("%03d", k).alias("run_id"),
            F.when(k % 2 == 0, "unet").otherwise("deeplabv3plus").alias("model_type"),
            F.when(k % 3 == 0, "mask_v2.tif").when(k % 3 == 1, "mask.tif").alias("vacancy_mask"),
            F.when(k % 4 != 0, hash32(k, 5) % 1000 / 1000.0).alias("best_val_f2"),
            (hash32(k, 6) % 1000 / 1000.0).alias("val_f2"),
            F.when(k % 5 != 0, hash32(k, 8) % 1000 / 1000.0).alias("test_f2"),
            F.when(k % 7 == 0, hash32(k, 9) % 1000 / 1000.0).alias("test_best_f2_computed"),
            F.when(k % 8 != 0, F.element_at(F.array(*map(F.lit, (256, 512, 1024))), (k % 3 + 1).cast("int"))).alias("patch_size"),
            text.alias("f2_threshold"),
            F.lit("host").alias("machine"),
        )

    @cached_property
    def history(self) -> DataFrame:
        """Per-user event sequences as run histories; epoch = position in time order."""
        return self.table("events").select(
            F.col("user_id").alias("run_id"),
            F.col("event_id").alias("epoch"),
            F.col("value").alias("val_iou"),
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
            "event_type",
        )

    @cached_property
    def permits(self) -> DataFrame:
        """Order value per year and priority as permit metrics; the low priority lacks the second metric."""
        per_capita = lambda cond: F.sum(F.when(cond, F.col("o_totalprice")))
        return (
            self.table("orders")
            .groupBy(F.col("o_orderpriority").alias("name"), F.year("o_orderdate").alias("year"))
            .agg(
                F.round(F.sum("o_totalprice"), 2).alias("total_units_per_capita"),
                F.round(per_capita(F.col("o_orderstatus") == "F"), 2).alias("1_unit_units_per_capita"),
                F.round(per_capita((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") != "5-LOW")), 2).alias("2_units_units_per_capita"),
                F.round(per_capita(F.col("o_orderstatus") == "P"), 2).alias("3_to_4_units_units_per_capita"),
                F.round(F.sum("o_totalprice") / F.count("*"), 2).alias("5_plus_units_units_per_capita"),
            )
        )
