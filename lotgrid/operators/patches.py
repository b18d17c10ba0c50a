"""Patch grids, spatial splits and training-table shaping."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgrid.functions.grid import Grid
from lotgrid.functions.hashing import cell_key, hash32, uniform
from lotgrid.functions.spectral import feature_stack

ORIGIN = ["row_off", "col_off"]


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _origins(first_line: Column, last_line: Column, patch: int, stride: int, size) -> Column:
    """Origins k*stride of full windows that cover every line of [first_line, last_line]."""
    low = F.greatest(F.ceil((last_line - (patch - 1)) / stride), F.lit(0))
    high = F.least(F.floor(first_line / stride), F.floor((_c(size) - patch) / stride))
    lines = F.sequence((low * stride).cast("int"), (high * stride).cast("int"), F.lit(stride))
    return F.when(low <= high, lines).otherwise(F.array().cast("array<int>"))


def covering_patches(cells: DataFrame, grid: Grid, patch: int, stride: int) -> DataFrame:
    """Each cell once per full window that covers it."""
    rows = _origins(F.col("prow"), F.col("prow"), patch, stride, grid.height)
    cols = _origins(F.col("pcol"), F.col("pcol"), patch, stride, grid.width)
    return cells.withColumn("row_off", F.explode(rows)).withColumn("col_off", F.explode(cols))


def patch_counts(cells: DataFrame, grid: Grid, patch: int, stride: int, counts: dict[str, Column], by=()) -> DataFrame:
    """Sums per patch of per-cell counts.

    Cells are first summed in blocks of gcd(patch, stride); windows are whole
    numbers of blocks, so overlap multiplies the small block table, not the cells.
    """
    g = gcd(patch, stride)
    keys = [F.floor(F.col("prow") / g).cast("int").alias("_bi"), F.floor(F.col("pcol") / g).cast("int").alias("_bj"), *by]
    blocks = cells.groupBy(*keys).agg(*[F.sum(v).alias(k) for k, v in counts.items()])
    top, left = F.col("_bi") * g, F.col("_bj") * g
    return (
        blocks.withColumn("row_off", F.explode(_origins(top, top + (g - 1), patch, stride, grid.height)))
        .withColumn("col_off", F.explode(_origins(left, left + (g - 1), patch, stride, grid.width)))
        .groupBy(*ORIGIN, *by)
        .agg(*[F.sum(k).alias(k) for k in counts])
    )


def patch_grid(mask: DataFrame, grid: Grid, patch: int = 256, stride: int = 256, min_valid: int = 50) -> DataFrame:
    """Origins of full windows with enough labelled cells, or any vacant one."""
    totals = patch_counts(
        mask,
        grid,
        patch,
        stride,
        {"labelled": (F.col("label") != 255).cast("bigint"), "vacant": (F.col("label") == 1).cast("bigint")},
    )
    return totals.where((F.col("labelled") >= min_valid) | (F.col("vacant") > 0))


def borough_to_split(train, val, test) -> dict[int, str]:
    """Code to split; a code listed twice goes to the later split."""
    out: dict[int, str] = {}
    for name, codes in (("train", train), ("val", val), ("test", test)):
        out.update({int(c): name for c in codes})
    return out


def majority_borough(patches: DataFrame, boro: DataFrame, grid: Grid, patch: int, stride: int) -> DataFrame:
    """Most common borough (> 0) of each patch, the smaller code on ties; null without any."""
    votes = patch_counts(boro.where("boro_code > 0"), grid, patch, stride, {"_n": F.lit(1).cast("bigint")}, by=("boro_code",))
    winner = votes.groupBy(*ORIGIN).agg(F.max_by("boro_code", F.col("_n") * (1 << 32) - F.col("boro_code")).alias("majority_boro"))
    return patches.join(winner, ORIGIN, "left")


def assign_split(patches: DataFrame, splits: dict[int, str]) -> DataFrame:
    """Add ``split``, "excluded" where the majority borough has none."""
    from lotgrid.functions.attributes import lookup

    return patches.withColumn("split", F.coalesce(lookup(F.col("majority_boro").cast("int"), splits), F.lit("excluded")))


def split_patches(
    mask: DataFrame, boro: DataFrame, grid: Grid, splits: dict[int, str], patch: int = 256, stride: int = 256, min_valid: int = 50
) -> DataFrame:
    """Patch grid with majority-borough split; rerun with a smaller stride for the overlap grid."""
    kept = patch_grid(mask, grid, patch, stride, min_valid)
    return assign_split(majority_borough(kept, boro, grid, patch, stride), splits)


def split_report(patches: DataFrame) -> DataFrame:
    """Patches and % per split, excluded ones included."""
    from lotgrid.operators.summary import share_within

    counts = patches.groupBy("split").agg(F.count("*").alias("patches"))
    shares = share_within(counts.withColumn("_all", F.lit(1)), "patches", ["_all"], "pct")
    return shares.withColumn("pct", F.col("pct") * 100).drop("_all")


def split_leaks(patches: DataFrame) -> DataFrame:
    """Origins found in more than one split; empty when the split is sound."""
    return (
        patches.where(F.col("split") != "excluded")
        .groupBy(*ORIGIN)
        .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
        .where(F.col("first_split") != F.col("last_split"))
    )


def patch_outlines(patches: DataFrame, grid: Grid, patch: int) -> DataFrame:
    """Map-coordinate rectangle of every patch."""
    return patches.select(
        *ORIGIN,
        "split",
        grid.x_of(F.col("col_off")).alias("xmin"),
        grid.y_of(F.col("row_off") + patch).alias("ymin"),
        grid.x_of(F.col("col_off") + patch).alias("xmax"),
        grid.y_of(F.col("row_off")).alias("ymax"),
    )


def oversample(patches: DataFrame, factor: int = 4, min_vacant: int = 10) -> DataFrame:
    """Patches with enough vacant cells ``factor`` times, extra copies flagged."""
    copies = F.when(F.col("vacant") >= min_vacant, F.lit(factor)).otherwise(F.lit(1))
    return patches.withColumn("copy_no", F.explode(F.sequence(F.lit(0), copies - 1))).withColumn("is_copy", F.col("copy_no") > 0)


def _draw(seed: int, *, copy: str = "copy_no") -> Column:
    """Uniform draw per (patch, copy)."""
    return uniform(hash32(cell_key(F.col("row_off"), F.col("col_off")), seed) + F.col(copy) * 7919, seed + 1)


def augment(cells: DataFrame, patch: int, *, seed: int = 42, p: float = 0.5) -> DataFrame:
    """Flips and quarter turns of flagged copies, each with probability ``p``.

    Cells carry (row_off, col_off, copy_no, is_copy, i, j); only i and j change, so
    image and mask move together.  The draws depend on the patch copy alone.
    """
    last = patch - 1
    flips = cells.withColumns(
        {
            "_h": F.col("is_copy") & (_draw(seed) < p),
            "_v": F.col("is_copy") & (_draw(seed + 11) < p),
            "_turns": F.when(F.col("is_copy") & (_draw(seed + 23) < p), F.floor(_draw(seed + 37) * 3) + 1).otherwise(0),
        }
    )
    flipped = flips.withColumns(
        {"_j": F.when(F.col("_h"), last - F.col("j")).otherwise(F.col("j")), "_i": F.when(F.col("_v"), last - F.col("i")).otherwise(F.col("i"))}
    )
    turn = F.col("_turns")
    # Counter-clockwise quarter turns of the (i, j) square.
    new_i = F.when(turn == 1, last - F.col("_j")).when(turn == 2, last - F.col("_i")).when(turn == 3, F.col("_j")).otherwise(F.col("_i"))
    new_j = F.when(turn == 1, F.col("_i")).when(turn == 2, last - F.col("_j")).when(turn == 3, last - F.col("_i")).otherwise(F.col("_j"))
    return flipped.withColumns({"i": new_i.cast("int"), "j": new_j.cast("int")}).drop("_h", "_v", "_turns", "_i", "_j")


def band_dropout(cells: DataFrame, bands, *, p: float = 0.1, max_bands: int = 1, seed: int = 42) -> DataFrame:
    """With probability ``p`` zero 1..max_bands random channels of a patch copy."""
    bands = list(bands)
    # Rank the channels by a per-patch hash; the first k are the dropped ones.
    order = F.array_sort(F.array(*[F.struct(_draw(seed + 101 + 13 * k).alias("u"), F.lit(b).alias("band")) for k, b in enumerate(bands)]))
    k = F.when(_draw(seed + 53) < p, F.floor(_draw(seed + 67) * max_bands) + 1).otherwise(0).cast("int")
    dropped = F.transform(F.slice(order, F.lit(1), k), lambda s: s.band)
    return (
        cells.withColumn("_dropped", dropped)
        .withColumns({b: F.when(F.array_contains("_dropped", b), F.lit(0)).otherwise(F.col(b)) for b in bands})
        .drop("_dropped")
    )


def patch_features(pixels: DataFrame, mask: DataFrame, patches: DataFrame, grid: Grid, patch: int, stride: int) -> DataFrame:
    """Ten features and the label of every cell of every patch."""
    cells = pixels.join(mask, ["prow", "pcol"])
    inside = covering_patches(cells, grid, patch, stride).join(patches.select(*ORIGIN), ORIGIN, "left_semi")
    return feature_stack(inside, [*ORIGIN, "prow", "pcol", "label"])


def reservoir_pixels(features: DataFrame, n_vacant: int, n_other: int, *, seed: int = 42) -> DataFrame:
    """Up to n cells per class, ignore cells left out, in a shuffled (hash) order."""
    from lotgrid.operators.ranking import sample_exact

    keyed = features.where(F.col("label") != 255).withColumn("_key", cell_key(F.col("prow"), F.col("pcol")))
    quota = F.when(F.col("label") == 1, F.lit(n_vacant)).otherwise(F.lit(n_other))
    return sample_exact(keyed, quota, "_key", seed=seed, strata=("label",)).drop("_key")


def reservoir_report(features: DataFrame, sample: DataFrame) -> DataFrame:
    """Seen and kept rows per class."""
    seen = features.where(F.col("label") != 255).groupBy("label").agg(F.count("*").alias("seen"))
    kept = sample.groupBy(F.col("label").alias("_l")).agg(F.count("*").alias("kept"))
    return seen.join(kept, seen["label"] == kept["_l"], "left").select("label", "seen", F.coalesce("kept", F.lit(0)).alias("kept"))


def class_weights(report: DataFrame) -> DataFrame:
    """Weight seen/kept per class, and the non-vacant to vacant ratio."""
    weighted = report.withColumn("class_weight", F.col("seen") / F.nullif(F.col("kept"), F.lit(0)))
    one = weighted.agg(
        F.max(F.when(F.col("label") == 0, F.col("class_weight"))).alias("o"), F.max(F.when(F.col("label") == 1, F.col("class_weight"))).alias("v")
    )
    return weighted.withColumn("scale_pos_weight", one.select(F.try_divide("o", "v")).scalar())


def random_patches(patches: DataFrame, k: int, *, seed: int = 42) -> DataFrame:
    """k patches chosen by hash."""
    from lotgrid.operators.ranking import sample_exact

    keyed = patches.withColumn("_key", cell_key(F.col("row_off"), F.col("col_off")))
    return sample_exact(keyed, k, "_key", seed=seed).drop("_key")
