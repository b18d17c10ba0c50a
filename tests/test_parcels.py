"""Labels, building rules, overrides, samples and vintage change on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from lotgrid.functions import attributes as A
from lotgrid.functions import geometry as G
from lotgrid.operators import change, impute, parcels, ranking
from lotgrid.schemas import require_columns

CODES = ["G7"] + [f"V{i}" for i in range(10)]


def test_vacancy_label_exact_and_prefix(spark):
    df = spark.createDataFrame([("V1",), ("G7",), ("A1",), (None,), ("V0 ",)], "bldg_class string")
    exact = [r[0] for r in df.select(A.is_vacant(F.col("bldg_class"), CODES).cast("int")).collect()]
    prefix = [r[0] for r in df.select(A.is_vacant(F.col("bldg_class"), CODES, 2).cast("int")).collect()]
    assert exact == [1, 1, 0, 0, 0]
    assert prefix == [1, 1, 0, 0, 1]


def test_building_rules(spark):
    cases = [
        ((0.0, 0.0, 0.0), (True, False)),
        ((0.0, None, 0.0), (True, False)),
        ((None, None, None), (True, False)),
        ((None, 0.0, 0.0), (False, False)),
        ((0.0, 10.0, 0.0), (False, True)),
        ((None, None, 0.5), (False, True)),
        ((2.0, 0.0, 0.0), (False, False)),
    ]
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, num_bldgs double, bldg_area double, built_far double")
    got = parcels.building_rules(df).orderBy("i").select("potential_vacant", "inconsistent").collect()
    assert [tuple(r) for r in got] == [c[1] for c in cases]


def test_overrides_nonvacant_wins_and_omit(spark, rows):
    df = spark.createDataFrame([(1, "A1"), (2, "V1"), (3, "V2"), (4, "A1")], "bbl bigint, bldg_class string")
    ov = spark.createDataFrame(
        [(1, "force_vacant"), (2, "force_nonvacant"), (2, "force_vacant"), (3, "omit"), (99, "force_vacant")], "bbl bigint, action string"
    )
    out = parcels.apply_overrides(df, ov, CODES)
    assert rows(out) == [(1, "V0", True), (2, "XX", False), (4, "A1", False)]
    assert rows(parcels.apply_overrides(df, ov, CODES, keep="vacant"), "bbl") == [(1,)]
    assert rows(parcels.apply_overrides(df, ov, CODES, corrections=False), "bbl", "is_vacant") == [(1, False), (2, True), (4, False)]
    assert rows(parcels.unmatched_overrides(ov, df)) == [(99, "force_vacant")]


def test_threshold_text(spark):
    df = spark.createDataFrame([("0.298",), ("36.6",), ("",), ("x",), ("0",), ("150",)], "t string")
    got = [r[0] for r in df.select(F.round(A.parse_threshold(F.col("t")), 6)).collect()]
    assert got == [0.298, 0.366, None, None, None, None]


def test_clean_land_use_never_shortens(spark):
    df = spark.createDataFrame([("1",), (None,), ("110",), ("11",)], "c string")
    got = [tuple(r) for r in df.select(A.clean_land_use(F.col("c")), A.land_use_label(F.col("c"))).collect()]
    assert got == [("01", "1-2 Family Residential"), ("00", "Unknown"), ("110", "Unknown"), ("11", "Vacant Land")]


def test_require_columns(spark):
    with pytest.raises(ValueError, match="missing"):
        require_columns(spark.range(1), ["geom"])
    with pytest.raises(ValueError, match="unknown imputation"):
        impute.fit_imputer(spark.range(1), ["id"], "mode")


def test_geometry_with_hole_and_either_orientation(spark):
    shell = [(0, 0), (6, 0), (6, 4), (0, 4)]
    hole = [(1, 1), (2, 1), (2, 3), (1, 3)]
    for s, h in ((shell, hole), (shell[::-1], hole), (shell, hole[::-1])):
        g = G.polygon(s, h)
        c = G.centroid(g)
        row = spark.range(1).select(G.area(g), G.perimeter(g), c.x, c.y).first()
        assert row[0] == 22.0 and row[1] == 26.0
        assert row[2] == pytest.approx((24 * 3 - 2 * 1.5) / 22) and row[3] == pytest.approx((24 * 2 - 2 * 2) / 22)


def _vintage(spark, data):
    df = spark.createDataFrame(data, "bbl bigint, bldg_class string, borough string, lot_area double, is_vacant boolean")
    k = F.coalesce(F.col("bbl"), F.lit(0)).cast("double")
    return df.withColumn("geom", G.box(k, F.lit(0.0), k + 1.0, F.lit(2.0)))


@pytest.fixture
def vintages(spark):
    first = _vintage(
        spark,
        [(1, "V", "B", 1.0, True), (2, "A", "B", 1.0, False), (3, "V", "B", 1.0, True), (4, "A", "B", 1.0, False),
         (5, "V", "Q", 1.0, True), (6, "A", "Q", 1.0, False), (None, "V", "Q", 1.0, True)],
    )
    second = _vintage(
        spark,
        [(1, "V", "B", 2.0, True), (2, "V", "B", 2.0, True), (3, "A", "B", 2.0, False), (4, "A", "B", 2.0, False),
         (7, "V", None, 2.0, True), (8, "A", "Q", 2.0, False), (None, "V", "Q", 2.0, True)],
    )
    return first, second


def test_change_categories_and_resolution(vintages, rows):
    out = change.changed_parcels(*vintages)
    assert rows(out, "bbl", "change_category", "lot_area", "area_m2") == [
        (1, "remained_vacant", 2.0, 2.0),
        (2, "became_vacant", 2.0, 2.0),
        (3, "developed", 2.0, 2.0),
        (5, "developed", None, 2.0),
        (7, "became_vacant", 2.0, 2.0),
    ]


def test_change_stats_keep_unknown_borough_in_total_only(vintages, rows):
    stats = change.change_stats(change.changed_parcels(*vintages))
    got = {(b, c): n for b, c, n, _ in rows(stats)}
    assert got == {
        ("B", "remained_vacant"): 1, ("B", "became_vacant"): 1, ("B", "developed"): 1, ("Q", "developed"): 1,
        ("ALL", "remained_vacant"): 1, ("ALL", "became_vacant"): 2, ("ALL", "developed"): 2,
    }


def test_hotspots_strict_edges_and_ranking(spark):
    # Four squares in one 500 m cell, one far away, one whose centroid lies on a rectangle edge.
    spots = [(0, 0), (10, 10), (20, 20), (30, 30), (1999, 1999), (999.5, 100)]
    df = spark.createDataFrame([(i, "developed", float(x), float(y)) for i, (x, y) in enumerate(spots)], "bbl bigint, change_category string, x double, y double")
    changes = df.withColumn("geom", G.box(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1))
    top = change.hotspots(changes, cell=500.0, top_n=1).collect()
    assert len(top) == 1 and top[0].total_change == 4 and (top[0].xmin, top[0].xmax) == (0.0, 1000.0)
    every = change.hotspots(changes, cell=500.0, top_n=10).collect()
    assert [r.hotspot_id for r in every] == list(range(1, len(every) + 1))


def test_exact_sample_is_stable_and_full_when_small(spark, rows):
    df = spark.range(5000).withColumn("s", F.col("id") % 3)
    a = ranking.sample_exact(df, 100, "id", strata=("s",), seed=7)
    b = ranking.sample_exact(df.repartition(11), 100, "id", strata=("s",), seed=7)
    assert rows(a) == rows(b)
    assert a.groupBy("s").count().where("count = 100").count() == 3
    assert ranking.sample_exact(df, 10_000, "id").count() == 5000


@pytest.mark.parametrize("merge", ["true", "false"])
def test_running_totals_split_and_plain_agree(spark, rows, merge):
    # Adaptive merging of small ranges is switched off to have many of them.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merge)
    # One group holds nearly everything and one value repeats across groups.
    df = spark.range(400).select(F.when(F.col("id") % 50 == 0, 1).otherwise(0).alias("g"), F.col("id").cast("double").alias("v"), (F.col("id") % 7).alias("w"))
    out = ranking.running_totals(df, "v", {"t": "w"}, prior_max={"m": "w"}, by=("g",), descending=True)
    expected = []
    for g in (0, 1):
        total, best = 0, None
        for i in sorted((i for i in range(400) if (1 if i % 50 == 0 else 0) == g), reverse=True):
            total += i % 7
            expected.append((g, float(i), i % 7, total, best))
            best = i % 7 if best is None else max(best, i % 7)
    assert rows(out) == sorted(expected, key=lambda t: tuple((x is None, x) for x in t))


@pytest.mark.parametrize("merge", ["true", "false"])
def test_exact_quantiles_match_numpy(spark, merge):
    # Adaptive merging of small ranges is switched off to have many of them.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merge)
    import numpy as np

    values = [float((i * 37) % 101) for i in range(97)] + [5.0] * 60
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.prob: r.quantile for r in ranking.exact_quantiles(df, "v", [0.025, 0.5, 0.975]).collect()}
    for p, q in got.items():
        assert q == pytest.approx(np.quantile(values, p))


@pytest.mark.parametrize("merge", ["true", "false"])
def test_column_quantiles_bracketed_and_whole(spark, merge):
    # Adaptive merging of small ranges is switched off to have many of them.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merge)
    import numpy as np

    # A third of one column is a single value; the other has gaps.
    n = 30_000
    a = [7.0 if i % 3 == 0 else float((i * 7919) % 10007) / 3 for i in range(n)]
    b = [None if i % 5 == 0 else float((i * 104729) % 30011) for i in range(n)]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    probs = [0.0, 0.025, 0.25, 0.5, 0.975, 1.0]
    got = ranking.column_quantiles(df, ["a", "b"], probs)
    for c, values in (("a", a), ("b", [v for v in b if v is not None])):
        for p in probs:
            assert got[c][p] == pytest.approx(np.quantile(values, p)), (c, p)
    assert ranking.column_quantiles(df.where("a < 0"), ["a"], [0.5]) == {"a": {}}


def test_even_subset_like_linspace(spark, rows):
    import numpy as np

    df = spark.range(103).withColumn("id", F.col("id") * 10)
    for size in (1, 2, 7, 50, 103, 500):
        wanted = range(103) if size >= 103 else {int(i) for i in (np.arange(size) * 102 // max(size - 1, 1))}
        assert rows(ranking.even_subset(df, "id", size)) == sorted((i * 10,) for i in wanted)


def test_stratified_folds_are_balanced(spark):
    df = spark.range(103).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    sizes = parcels.stratified_folds(df, "y", "id", 5).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        n = [r["count"] for r in sizes if r["y"] == y]
        assert len(n) == 5 and max(n) - min(n) <= 1


def test_imputer_uses_training_medians(spark, rows):
    train = spark.createDataFrame([(1.0,), (2.0,), (9.0,), (None,)], "a double")
    new = spark.createDataFrame([(None,), (100.0,)], "a double")
    assert rows(impute.fit_imputer(train, ["a"]).apply(new)) == [(2.0,), (100.0,)]
    assert impute.impute(train, ["a"], "drop").count() == 3
    assert rows(impute.impute(train, ["a"], "mean"))[-2:] == [(4.0,), (9.0,)]


def test_centroid_of_a_whole_box_is_its_exact_centre(spark):
    corner = [F.col("id") * 37 % 5000, F.col("id") * 53 % 5000]
    side = F.col("id") % 20 + 5
    x, y = (c.cast("double") for c in corner)
    c = G.centroid(G.box(x, y, x + side, y + side))
    off = spark.range(5000).select((c.x != x + side / 2).alias("dx"), (c.y != y + side / 2).alias("dy")).where("dx OR dy")
    assert off.count() == 0
