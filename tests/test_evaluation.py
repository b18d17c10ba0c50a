"""Metrics, precision-recall, registry, histories, sources and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotgrid.operators import evaluation as E
from lotgrid.operators import ml, patches, scoring, series
from lotgrid.operators import registry as RG
from lotgrid.schemas import RUN_METRICS
from lotgrid.sources import readers, writers
from lotgrid.streaming import blend, confusion
from lotgrid.streaming.deltas import Totals


def test_metrics_and_zero_counts(spark):
    m = E.with_metrics(spark.createDataFrame([(3, 1, 2, 4), (0, 0, 0, 0)], "tp bigint, fp bigint, fn bigint, tn bigint")).orderBy(F.desc("tp")).collect()
    a = m[0]
    assert (a.iou, a.precision, a.recall) == (0.5, 0.75, 0.6)
    assert a.dice == pytest.approx(2 / 3) and a.f1 == pytest.approx(2 / 3) and a.f2 == pytest.approx(0.625) and a.kappa == pytest.approx(0.4)
    assert a.iou == pytest.approx(a.dice / (2 - a.dice))
    assert [m[1][k] for k in ("iou", "dice", "precision", "recall", "f1", "f2", "kappa")] == [0] * 7


@pytest.mark.parametrize("merge", ["true", "false"])
def test_average_precision_with_ties_and_weights(spark, merge):
    # Adaptive merging of small ranges is switched off to have many of them.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merge)
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 1)], "prob double, y int")
    ap = E.average_precision(df).first()[0]
    assert ap == pytest.approx(0.755556, abs=1e-6)
    weighted = df.withColumn("w", F.when(F.col("y") == 1, 2.0).otherwise(1.0))
    got = E.average_precision(weighted, weight="w").first()[0]
    assert got == pytest.approx(1 / 3 * 1 + 1 / 3 * 4 / 5 + 1 / 3 * 6 / 8)
    assert E.average_precision(df.where("y = 0")).first()[0] is None


def test_threshold_tie_takes_the_smaller(spark, rows):
    pts = spark.createDataFrame([("a", 0.7, 0.5, 0.5), ("a", 0.2, 0.5, 0.5), ("a", 0.9, 1.0, 0.1)], "run_id string, threshold double, precision double, recall double")
    assert rows(E.best_threshold(pts, by=("run_id",))) == [("a", 0.2)]
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    assert rows(E.thresholds_for(runs, pts)) == [("a", 0.2), ("b", 0.5)]


def test_pixel_threshold_is_strict_and_parcel_is_not(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (255, 0.9), (1, None)], "label int, prob double")
    got = [r[0] for r in df.select(scoring.outcome(F.col("label"), F.col("prob"), 0.5)).collect()]
    assert got == ["FN", "TN", "ignore", "ignore"]
    f = spark.createDataFrame([(True, 0.3), (False, 0.3), (True, None)], "is_vacant boolean, pred_fraction double")
    assert [r.label_30 for r in E.outcome_columns(f, [0.3]).collect()] == ["TP", "FP", "NA"]


def test_recall_curve_equals_recall_at(spark):
    f = spark.createDataFrame([(i / 40,) for i in range(41)] + [(None,)], "pred_fraction double")
    curve = {r.step: r.recall for r in E.recall_curve(f).collect()}
    assert len(curve) == 201
    for r in E.recall_at(f, [0.0, 0.3, 0.5, 1.0]).collect():
        assert curve[round(r.coverage * 200)] == pytest.approx(r.recall)


def test_patience_and_best_epoch(spark, rows):
    runs = {"a": [0.1, 0.2, 0.2, 0.2, 0.9], "b": [0.1, 0.2, 0.3], "c": [0.5, 0.50005, 0.50009, 0.6, 0.1]}
    df = spark.createDataFrame([(k, i, v) for k, vs in runs.items() for i, v in enumerate(vs)], "run_id string, epoch int, val_iou double")
    assert rows(RG.patience_stop(df, patience=2)) == [("a", 1, 3), ("b", 2, None), ("c", 0, 2)]
    losses = df.withColumn("val_iou", 1 - F.col("val_iou"))
    assert rows(RG.patience_stop(losses, patience=2, mode="min")) == [("a", 1, 3), ("b", 2, None), ("c", 0, 2)]
    assert rows(RG.best_epoch(df)) == [("a", 4, 0.9), ("b", 2, 0.3), ("c", 3, 0.6)]
    assert rows(RG.best_so_far(df).where("is_best"), "run_id", "epoch")[:3] == [("a", 0), ("a", 1), ("a", 4)]


def test_registry_pieces(spark, rows):
    names = spark.createDataFrame([("x/patch_splits_512_v2.json",), ("a/b.json",), ("p_v2_64_128.json",)], "p string")
    assert [r[0] for r in names.select(RG.patch_size_from_name(F.col("p"))).collect()] == ["512", None, "64"]
    cols = "run_id string, patch_size double, f2_threshold string"
    plan = RG.scoring_plan(spark.createDataFrame([("a", 1024.0, "0.298"), ("b", None, "50.4"), ("c", 256.0, "")], cols))
    assert rows(plan, "run_id", "stride", "batch_size", "second_pass", "tag") == [
        ("a", 512, 2, True, "_t298"), ("b", 256, 4, False, None), ("c", 128, 8, False, None),
    ]


def test_read_run_folders(spark, tmp_path, rows):
    for name, record in (("001", {"run_id": "1", "model_type": "unet", "metrics": {"val": {"iou": 0.12345}}}), ("002", {"model": {"type": "rf"}})):
        d = tmp_path / "cnn" / name
        d.mkdir(parents=True)
        (d / "metrics.json").write_text(json.dumps(record, indent=1))
    (tmp_path / "cnn" / "003").mkdir()
    (tmp_path / "cnn" / "003" / "config.json").write_text("{}")
    (tmp_path / "cnn" / "001" / "history.json").write_text(json.dumps([{"epoch": 0, "val_iou": 0.1}, {"epoch": 1, "val_iou": 0.2}], indent=1))
    (tmp_path / "cnn" / "001" / "config.json").write_text(json.dumps({"data_paths": {"patch_splits": "s/p_256_x.json"}}))
    got = readers.read_runs(spark, str(tmp_path))
    flat = RG.flatten_runs(got["metrics"], got["configs"], got["history"], machine="m")
    assert flat.columns == RG.REGISTRY_COLUMNS
    assert rows(flat, "run_id", "model_type", "patch_size", "epochs_ran", "val_iou", "test_iou") == [
        ("002", "rf", "", "", "", ""), ("1", "unet", "256", "2", "0.1235", ""),
    ]
    assert set(got["metrics"].columns) == set(RUN_METRICS.names)


def test_permits_and_series(spark, tmp_path, rows):
    records = [
        {"name": "Phoenix-Mesa-Chandler MSA, AZ", "year": "2001", "1_unit_units_per_capita": 2.0},
        {"name": "Other", "year": 1999, "1_unit_units_per_capita": 1.0},
        {"name": "Other", "year": 2003, "1_unit_units_per_capita": None, "5_plus_units_units_per_capita": 4.0},
    ]
    path = tmp_path / "p.json"
    path.write_text(json.dumps(records, indent=1))
    permits = readers.read_permits(spark, str(path))
    assert rows(series.metric_series(permits, "1_unit_units_per_capita")) == [("Phoenix", 2001, 2.0)]
    mix = series.mix_layers(permits)
    assert mix.count() == 8 and mix.where("name = 'Other' and layer_no = 3").first().stack_top == 4.0


def test_missing_overlay_is_skipped(spark, tmp_path, rows):
    spark.createDataFrame([("S1100",), ("S9999",)], "mtfcc string").write.parquet(str(tmp_path / "a"))
    paths = {"061": str(tmp_path / "a"), "005": str(tmp_path / "none")}
    assert rows(readers.scan_overlay(spark, paths)) == [("S1100", "061"), ("S9999", "061")]
    assert rows(readers.scan_overlay(spark, paths, classes=readers.ROAD_CLASSES)) == [("S1100", "061")]
    with pytest.raises(FileNotFoundError):
        readers.scan_overlay(spark, {"x": str(tmp_path / "none")})


def test_cached_grid_is_built_once_per_parameter_set(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(0, 0)], "row_off int, col_off int")

    for stride in (8, 8, 4, 8):
        writers.cached_grid(spark, str(tmp_path / "g"), build, patch_size=8, stride=stride, min_valid_pixels=1)
    assert len(calls) == 2


def test_outputs_are_reused_until_overwritten(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    for overwrite, size in ((False, 1), (False, 1), (True, 2)):
        assert writers.stored_or_built(spark, str(tmp_path / "ids"), build, overwrite=overwrite).count() == size


def test_bucketed_rasters_join_without_a_shuffle(spark):
    cells = spark.range(400).select((F.col("id") / 20).cast("int").alias("prow"), (F.col("id") % 20).cast("int").alias("pcol"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = writers.store_raster(cells, "bucketed_a", buckets=4)
        b = writers.store_raster(cells.withColumnRenamed("v", "w"), "bucketed_b", buckets=4)
        joined = a.join(b, ["prow", "pcol"])
        assert joined.where("v = w").count() == 400
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("bucketed_a", "bucketed_b"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_csv_order_and_layers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5)], "z int, y string, x double")
    writers.write_csv(df, str(tmp_path / "c"), ["x", "absent", "z"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["x", "z"]
    writers.write_layers({"full": df, "empty": df.where("z > 1")}, str(tmp_path / "l"))
    # Beside the layers there is only the writer's end marker.
    assert sorted(p.name for p in (tmp_path / "l").iterdir() if p.is_dir()) == ["layer=full"]


def test_streams_equal_batch(spark, tmp_path, rows):
    cells = [(r, 0, i, j, ((r + i * 3 + j) % 10) / 10, (i + j) % 2) for r in (0, 2, 4) for i in range(4) for j in range(4)]
    batch = spark.createDataFrame(cells, "row_off int, col_off int, i int, j int, prob double, y int").withColumn("split", F.lit("val"))
    m, b = str(tmp_path / "m"), str(tmp_path / "b")
    assert confusion.read_confusion(spark, m, by=["split"]) is None
    # Three files, the streams started anew for each; a base is made after the second.
    for k, r in enumerate((0, 2, 4)):
        batch.where(F.col("row_off") == r).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        confusion.start_confusion(stream, m, str(tmp_path / "ck1"), by=["split"], compact_every=2).awaitTermination()
        blend.start_blend(stream, b, str(tmp_path / "ck2"), 4, compact_every=2).awaitTermination()
    want = E.with_metrics(E.confusion_counts(batch, F.col("y"), (F.col("prob") > 0.5).cast("int"), by=["split"]))
    assert rows(confusion.read_confusion(spark, m, by=["split"]), *want.columns) == rows(want)
    got = {r[:2]: r[2] for r in rows(blend.read_blend(spark, b))}
    for (i, j, p) in rows(scoring.blend_hann(batch, 4), "prow", "pcol", "prob"):
        assert got[i, j] == pytest.approx(p)
    manifest = confusion.confusion_totals(spark, m, ["split"]).manifest()
    assert manifest["number"] == 1 and len(manifest["merged"]) == 2
    # A second stream over the same folder adds to it instead of replacing the first one's batches.
    confusion.start_confusion(stream, m, str(tmp_path / "ck3"), by=["split"]).awaitTermination()
    assert confusion.read_confusion(spark, m, by=["split"]).first()["n"] == 2 * want.first()["n"]


def test_totals_survive_replays_and_half_done_compactions(spark, tmp_path, rows):
    t = Totals(spark, str(tmp_path / "t"), ["k"], ["n"])
    df = lambda *n: spark.createDataFrame(list(n), "k string, n bigint")
    t.upsert(df(("a", 1), ("a", 2), ("b", 5)), "s", 0)
    t.upsert(df(("a", 1), ("a", 2), ("b", 5)), "s", 0)
    assert rows(t.read()) == [("a", 3), ("b", 5)]
    assert t.compact() and not t.compact()
    t.upsert(df(("a", 3), ("b", 5)), "s", 0)  # replayed after it went into the base
    t.upsert(df(("a", 10)), "s", 1)
    assert rows(t.read()) == [("a", 13), ("b", 5)]
    # A delta without its end marker, and a base that no manifest names, do not count.
    (tmp_path / "t/delta/s-2").mkdir()
    df(("a", 99)).write.parquet(str(tmp_path / "t/base/2-lost"))
    assert rows(t.read()) == [("a", 13), ("b", 5)]
    assert t.compact() and t.manifest()["merged"] == ["s-0", "s-1"] and rows(t.read()) == [("a", 13), ("b", 5)]


def test_run_folders(spark, tmp_path, rows):
    first, second = tmp_path / "unet/001", tmp_path / "unet/002"
    for d in (first, second, tmp_path / "unet/003"):
        d.mkdir(parents=True)
    (first / "metrics.json").write_text('{"run_id": "r1", "model_type": "unet",\n "metrics": {"val": {"f2": 0.5}}}')
    (first / "config.yaml").write_text(
        "# run\ndata_paths:\n  vrt: /d/a.vrt  # tiles\n  patch_splits: '/d/splits_512_64.json'\n  bands:\n    - 1\n    - 2\npatch:\n    size: 512\nlist: [1, 2]\neval_stride: 256\n"
    )
    np.savez_compressed(first / "pr_curves.npz", val_thresholds=np.array([0.1, 0.7254]), precision=np.array([1.0, 0.5]))
    (second / "metrics.json").write_text("{}")
    (second / "pr_curves.npz").write_bytes(b"no archive")
    (tmp_path / "unet/003/config.yaml").write_text("patch:\n  size: 64\n")
    runs = readers.read_runs(spark, str(tmp_path))
    assert rows(runs["metrics"], "run_id", "model_type") == [("002", None), ("r1", "unet")]
    assert rows(runs["configs"], "run_id", "data_paths.vrt", "data_paths.patch_splits", "patch.size", "eval_stride") == [("r1", "/d/a.vrt", "/d/splits_512_64.json", 512, 256)]
    points = readers.curve_points(runs["curves"])
    assert rows(points) == [("r1", "val", 0.1), ("r1", "val", 0.7254)]
    flat = RG.flatten_runs(runs["metrics"], runs["configs"], None, points)
    assert rows(flat, "run_id", "patch_size", "val_f2", "threshold_sweep_extent") == [("002", "", "", ""), ("r1", "512", "0.5000", "0.725")]


def test_config_values():
    text = "a: 1\nb: 1.5e-3\nc: true\nd: null\ne: 'x # y'\nf: \"q\"\ng: a b # c\nh:\n  i:\n    j: -2\n  k: .5\nl: ~\n"
    want = {"a": 1, "b": 0.0015, "c": True, "d": None, "e": "x # y", "f": "q", "g": "a b", "h": {"i": {"j": -2}, "k": 0.5}, "l": None}
    assert readers.parse_config(text) == want


def test_scorer_sees_whole_patches(spark):
    cells = spark.range(16).select(
        F.lit(0).alias("row_off"), F.lit(4).alias("col_off"), (F.col("id") / 4).cast("int").alias("i"), (F.col("id") % 4).cast("int").alias("j"), F.col("id").alias("r"), (F.col("id") * 2).alias("n")
    )
    tensors = scoring.patch_tensors(cells, ["r", "n"], 4)
    out = scoring.score_patches(tensors, lambda: lambda x: (x[:, 0] + x[:, 1]).transpose(0, 2, 1) / 100, ["r", "n"], 4)
    assert {(r.i, r.j): round(r.prob, 6) for r in out.collect()} == {(i, j): round((j * 4 + i) * 3 / 100, 6) for i in range(4) for j in range(4)}


def test_cluster_model_assigns_its_own_training_rows(spark):
    data = [(i, float(i % 2) * 10 + (i % 5) * 0.1, None if i == 3 else float(i % 2) * -5) for i in range(40)]
    df = spark.createDataFrame(data, "bbl bigint, a double, b double")
    model = ml.fit_clusters(df, ["a", "b"], 2, restarts=2, components=1)
    out = model.assign(df)
    assert set(out.columns) == {"bbl", "a", "b", "cluster", "pc1"}
    groups = {(r.bbl % 2, r.cluster) for r in out.where("bbl <> 3").collect()}
    assert len(groups) == 2
    assert out.where("bbl = 3").first().b is None


def test_classifiers_learn_a_separable_rule(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("bbl"), (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    df = ml.balanced_weights(df.withColumn("y", (F.col("a") >= 7).cast("int")))
    assert {round(r[0], 6) for r in df.select("weight").distinct().collect()} == {round(300 / 420, 6), round(300 / 180, 6)}
    forest = ml.forest(["a", "b"], trees=5, depth=4, min_leaf=1).fit(df)
    assert ml.evaluate_classifier(forest.transform(df))["metrics"].first()["average_precision"] == pytest.approx(1.0)
    assert ml.feature_importances(spark, forest, ["a", "b"]).first()["feature"] == "a"
    svm = ml.fit_kernel_svm(df, ["a", "b"], size=32, max_iter=20)
    assert ml.evaluate_classifier(svm.transform(df))["metrics"].first()["average_precision"] > 0.8
    ml.save_model(spark, forest, str(tmp_path / "m"), {"k": 1})
    loaded, meta = ml.load_model(spark, str(tmp_path / "m"))
    assert meta == {"k": 1} and loaded.transform(df).where("prediction <> y").count() == 0


def test_split_leaks(spark, rows):
    p = spark.createDataFrame([(0, 0, "train"), (0, 0, "val"), (0, 8, "train"), (8, 8, "excluded")], "row_off int, col_off int, split string")
    assert rows(patches.split_leaks(p)) == [(0, 0, "train", "val")]


def test_golden_registry_order(spark):
    """Order of a comparison: computed F2 first, test F2 next, missing values last."""
    df = spark.createDataFrame(
        [("1", "m_v2", 0.4, None, 0.2), ("2", "m", 0.9, 0.5, 0.1), ("3", "m", 0.9, None, 0.7), ("4", "", 0.9, None, None), ("5", "m_v2", 0.4, None, 0.3)],
        "run_id string, vacancy_mask string, best_val_f2 double, test_best_f2_computed double, test_f2 double",
    )
    out = RG.compare_runs(df).collect()
    assert [r.run_id for r in out] == ["2", "5", "1", "3", "4"]
    assert [r.mask_version for r in out] == ["v1", "v2", "v2", "v1", ""]
