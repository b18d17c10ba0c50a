"""Run registry, histories and permit series."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotgrid.operators import evaluation as E
from lotgrid.operators import ranking
from lotgrid.operators import registry as RG
from lotgrid.operators import series
from lotgrid.plans.inputs import Inputs
from lotgrid.plans.registry import query

_SIZE = "CASE WHEN c_acctbal >= 0 THEN CASE WHEN k % 4 = 0 THEN '512' ELSE ['256','512','1024'][k % 3 + 1] END ELSE '' END"
_RUN_COLUMNS = f"""CASE WHEN k % 2 = 0 THEN 'unet' WHEN k % 9 <> 0 THEN 'deeplabv3plus' ELSE 'cnn' END AS model_type,
CASE WHEN k % 7 <> 0 THEN c_mktsegment ELSE 'resnet' END AS encoder, run_id, (k % 40)::VARCHAR AS best_epoch, coalesce(epochs_ran::VARCHAR, '') AS epochs_ran,
(k % 2 + 4)::VARCHAR AS in_channels, CASE WHEN k % 2 = 1 THEN 'true' ELSE 'false' END AS use_building_prob, {_SIZE} AS patch_size, (k % 8 + 1)::VARCHAR AS batch_size, '0.001' AS lr,
printf('%.1f', (k % 30)::DOUBLE) AS pos_weight, '' AS bce_weight, '' AS dice_weight, '' AS lovasz_weight, '' AS oversample_factor, '' AS min_vacant_pixels, '' AS band_dropout_p,
'' AS cosine_t_max, '' AS seed, CASE WHEN c_acctbal >= 0 AND k % 2 = 0 THEN '256' ELSE '' END AS eval_stride,
CASE WHEN c_acctbal >= 0 THEN 'data/mask_' || CASE WHEN k % 3 = 0 THEN 'v2' ELSE 'v1' END || '.tif' ELSE '' END AS vacancy_mask,
CASE WHEN c_acctbal >= 0 THEN 'data/patch_splits_' || ['256','512','1024'][k % 3 + 1] || '_s.json' ELSE '' END AS patch_splits,
val_iou, val_f1, val_f2, val_precision, val_recall, val_ap, val_kappa, test_iou, test_f1, test_f2, test_precision, test_recall, test_ap, test_kappa,
coalesce(extent, '') AS threshold_sweep_extent, c_name AS note, '2024-05-01' AS trained_at, 'host' AS machine"""


def _points(t: Inputs):
    """Validation curves of the line-number runs, under registry-style run ids."""
    named = t.scores.withColumns({"run_id": F.format_string("%03d", "run_no"), "split": F.lit("val")})
    return E.pr_points(named, by=["run_id", "split"])


def _run_history(t: Inputs):
    return t.history.withColumn("run_id", F.format_string("%03d", "run_id"))


@query(
    "flatten_runs_G1",
    f"""SELECT {_RUN_COLUMNS} FROM runs LEFT JOIN (SELECT user_id AS k, count(*) AS epochs_ran FROM events GROUP BY 1) USING (k)
    LEFT JOIN (SELECT run_no AS k, printf('%.3f', max(prob)) AS extent FROM scores GROUP BY 1) USING (k)""",
    "runs scores",
)
def _(t: Inputs):
    # A curve ends at the highest score, so that its extent needs no curve.
    scores = t.scores.select(F.format_string("%03d", "run_no").alias("run_id"), F.lit("val").alias("split"), F.col("prob").alias("threshold"))
    return RG.flatten_runs(t.runs, t.run_configs, _run_history(t), scores, machine="host")


@query(
    "patch_size_fallback_G2",
    "SELECT run_id, ['256','512','1024'][k % 3 + 1] AS patch_size FROM runs WHERE c_acctbal >= 0",
    "runs",
)
def _(t: Inputs):
    return t.run_configs.select("run_id", RG.patch_size_from_name(F.col("data_paths.patch_splits")).alias("patch_size"))


@query("epochs_ran_G3", "SELECT user_id AS run_id, count(*) AS epochs_ran FROM events GROUP BY 1")
def _(t: Inputs):
    return RG.epochs_ran(t.history)


@query(
    "registry_compare_G4_W6",
    """SELECT CASE WHEN vacancy_mask LIKE '%v2%' AND test_best_f2_computed IS NULL THEN best_val_f2 ELSE test_best_f2_computed END AS test_best_f2_computed,
    run_id, model_type, best_val_f2, val_f2, test_f2, patch_size, CASE WHEN vacancy_mask LIKE '%v2%' THEN 'v2' WHEN vacancy_mask IS NOT NULL THEN 'v1' ELSE '' END AS mask_version FROM registry""",
    "registry",
)
def _(t: Inputs):
    return RG.compare_runs(t.registry).drop("f2_threshold")


@query(
    "top_runs_W1",
    "SELECT run_id, f AS sort_f2 FROM (SELECT run_id, coalesce(best_val_f2, val_f2, 0) AS f FROM registry) WHERE f*100 >= 25 ORDER BY f DESC, run_id LIMIT 20",
    "registry",
)
def _(t: Inputs):
    return RG.top_runs(t.registry, min_f2_pct=25.0, n=20).select("run_id", "sort_f2")


@query(
    "scoring_plan_G5",
    """WITH c AS (SELECT run_no AS k, arg_max(threshold, (f, -threshold)) AS curve FROM (SELECT run_no, threshold, 5*p*r/greatest(4*p+r, 1e-8) AS f FROM (
      SELECT run_no, prob AS threshold, cp/(cp+cn) AS p, cp/max(cp) OVER (PARTITION BY run_no) AS r FROM (
      SELECT run_no, prob, sum(pos) OVER (PARTITION BY run_no ORDER BY prob DESC) AS cp, sum(neg) OVER (PARTITION BY run_no ORDER BY prob DESC) AS cn FROM (
      SELECT run_no, prob, sum(y)::DOUBLE AS pos, sum(1-y)::DOUBLE AS neg FROM scores GROUP BY 1, 2)))) GROUP BY 1),
    t AS (SELECT k, run_id, coalesce(patch_size, 512) AS ps, coalesce(CASE WHEN f2_value > 0 AND f2_value <= 1 THEN f2_value WHEN f2_value > 1 AND f2_value <= 100 THEN f2_value/100 END, curve) AS threshold
      FROM registry LEFT JOIN c USING (k))
    SELECT run_id, ps AS patch_size, CASE WHEN ps >= 1024 THEN 512 WHEN ps >= 512 THEN 256 ELSE ps//2 END AS stride, CASE WHEN ps >= 1024 THEN 2 WHEN ps >= 512 THEN 4 ELSE 8 END AS batch_size,
    round(threshold, 6) AS threshold, coalesce(abs(threshold-0.5) >= 0.01, false) AS second_pass, CASE WHEN abs(threshold-0.5) >= 0.01 THEN '_t' || round(threshold*1000)::INT::VARCHAR END AS tag FROM t""",
    "registry scores",
)
def _(t: Inputs):
    plan = RG.scoring_plan(t.registry, _points(t))
    return plan.select("run_id", "patch_size", "stride", "batch_size", F.round("threshold", 6).alias("threshold"), "second_pass", "tag")


_HIST = "PARTITION BY run_id ORDER BY epoch"


@query(
    "best_so_far_W2",
    f"""SELECT run_id, epoch, val_iou, best_before, val_iou > coalesce(best_before, 0) AS is_best FROM
    (SELECT *, max(val_iou) OVER ({_HIST} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM history)""",
    "history",
)
def _(t: Inputs):
    return RG.best_so_far(t.history).select("run_id", "epoch", "val_iou", "best_before", "is_best")


@query(
    "best_epoch_W2",
    "SELECT run_id, arg_max(epoch, (val_iou, -epoch)) AS best_epoch, max(val_iou) AS best_value FROM history GROUP BY 1",
    "history",
)
def _(t: Inputs):
    return RG.best_epoch(t.history)


# The improvement chain: the next improvement is the first later value above the current best plus min_delta.
@query(
    "patience_stop_W3",
    f"""WITH RECURSIVE h AS (SELECT run_id, epoch, val_iou AS v, row_number() OVER ({_HIST}) - 1 AS pos FROM history),
    fold AS (SELECT run_id, pos, v AS best, pos AS best_pos, epoch AS best_epoch, false AS stopped, NULL::BIGINT AS stop_epoch FROM h WHERE pos = 0
      UNION ALL SELECT h.run_id, h.pos, CASE WHEN h.v > f.best + 5.0 THEN h.v ELSE f.best END, CASE WHEN h.v > f.best + 5.0 THEN h.pos ELSE f.best_pos END,
      CASE WHEN h.v > f.best + 5.0 THEN h.epoch ELSE f.best_epoch END, h.v <= f.best + 5.0 AND h.pos - f.best_pos >= 8, CASE WHEN h.v <= f.best + 5.0 AND h.pos - f.best_pos >= 8 THEN h.epoch END
      FROM fold f JOIN h ON h.run_id = f.run_id AND h.pos = f.pos + 1 WHERE NOT f.stopped)
    SELECT run_id, arg_max(best_epoch, pos) AS best_epoch, max(stop_epoch) AS stop_epoch FROM fold GROUP BY 1""",
    "history",
)
def _(t: Inputs):
    return RG.patience_stop(t.history, patience=8, min_delta=5.0)


@query(
    "resume_history_W7",
    "SELECT run_id, epoch, val_iou FROM history WHERE epoch < 4000 UNION ALL SELECT run_id, epoch, val_iou/2 FROM history WHERE epoch >= 3500",
    "history",
)
def _(t: Inputs):
    stored = t.history.select("run_id", "epoch", "val_iou")
    rerun = stored.where("epoch >= 3500").withColumn("val_iou", F.col("val_iou") / 2)
    return RG.resume_history(stored, rerun, 4000)


# ---------------------------------------------------------------- permits (T)

_NAMES = {"1-URGENT": "Urgent", "5-LOW": "Low"}
_NAME_SQL = "CASE name WHEN '1-URGENT' THEN 'Urgent' WHEN '5-LOW' THEN 'Low' ELSE name END"


@query(
    "metric_series_T1",
    f"SELECT {_NAME_SQL} AS name, year, m2 AS value FROM permits WHERE year >= 1997 AND m2 IS NOT NULL",
    "permits",
)
def _(t: Inputs):
    return series.metric_series(t.permits, "2_units_units_per_capita", start_year=1997, names=_NAMES)


@query(
    "mix_layers_T2",
    f"""SELECT {_NAME_SQL} AS name, year, layer_no::INT AS layer_no, layer, value, round(stack_top, 2) AS stack_top FROM (SELECT name, year, layer_no, layer, value,
    sum(value) OVER (PARTITION BY name, year ORDER BY layer_no) AS stack_top FROM (SELECT name, year, unnest([0,1,2,3]) AS layer_no, unnest([{", ".join(f"'{label}'" for _, label in series.MIX_LAYERS)}]) AS layer,
    unnest([coalesce(m1,0), coalesce(m2,0), coalesce(m3,0), coalesce(m5,0)]) AS value FROM permits WHERE year >= 1997))""",
    "permits",
)
def _(t: Inputs):
    return series.mix_layers(t.permits, start_year=1997, names=_NAMES).withColumn("stack_top", F.round("stack_top", 2))


@query("global_order_W4", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_no FROM orders")
def _(t: Inputs):
    return ranking.global_row_number(t.table("orders").select("o_orderkey"), "o_orderkey")
