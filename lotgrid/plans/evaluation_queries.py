"""Scoring, blending, pixel metrics and parcel evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotgrid.functions.attributes import CLASS_PREFIX_LABELS, LAND_USE_LABELS
from lotgrid.operators import evaluation as E
from lotgrid.operators import parcels, scoring, zonal
from lotgrid.plans.inputs import VACANT_CODES, WIDTH, Inputs
from lotgrid.plans.registry import query

# ---------------------------------------------------------------- blending (I)


def _round(df, columns):
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def _mean_score(images):
    """A stand-in scorer: mean of the bands, scaled to [0, 1]."""
    return images.mean(axis=1) / 255.0


@query(
    "score_patches_I2",
    "SELECT (prow//8)*8 AS row_off, (pcol//8)*8 AS col_off, prow%8 AS i, pcol%8 AS j, round((r+n)/2.0/255, 6) AS prob FROM raster, dims WHERE (prow//8)*8+8 <= height",
    "raster dims",
)
def _(t: Inputs):
    from lotgrid.operators.patches import covering_patches

    # Only the last raster row can be partial, and a cell that has no pixel is not scored.
    cells = covering_patches(t.pixels, t.grid, 8, 8)
    ij = cells.withColumns({"i": F.col("prow") - F.col("row_off"), "j": F.col("pcol") - F.col("col_off")})
    tensors = scoring.patch_tensors(ij, ["r", "n"], 8)
    scored = scoring.score_patches(tensors, lambda: _mean_score, ["r", "n"], 8)
    placed = scoring.global_cells(scored).join(t.pixels.select("prow", "pcol"), ["prow", "pcol"], "left_semi")
    return _round(placed.select("row_off", "col_off", "i", "j", "prob"), ["prob"])


_W = "greatest((0.5-0.5*cos(2*pi()*i/7))*(0.5-0.5*cos(2*pi()*j/7)), 0.001)"
_WB = "greatest((0.5-0.5*cos(2*pi()*(i+1)/9))*(0.5-0.5*cos(2*pi()*(j+1)/9)), 0.05)"


@query("hann_blend_I3", f"SELECT prow, pcol, round(sum(prob*{_W})/sum({_W}), 6) AS prob FROM patch_px GROUP BY 1, 2", "patch_px")
def _(t: Inputs):
    return _round(scoring.blend_hann(t.patch_scores, 8), ["prob"])


@query(
    "building_blend_I4",
    f"""SELECT prow, pcol, round(p, 6) AS prob, floor(p*254 + 0.5)::INT AS prob_byte FROM (
    SELECT prow, pcol, sum(prob*{_WB})/sum({_WB}) AS p FROM patch_px GROUP BY 1, 2)""",
    "patch_px",
)
def _(t: Inputs):
    out = _round(scoring.blend_buildings(t.patch_scores, 8), ["prob"])
    return out.withColumn("prob_byte", F.col("prob_byte").cast("int"))


@query(
    "class_softmax_I4",
    "SELECT vec_id, round(exp(embedding[1])/(exp(embedding[1])+exp(embedding[2])+exp(embedding[3])), 6) AS prob FROM embeddings",
)
def _(t: Inputs):
    prob = scoring.class_zero_softmax([F.col("f0"), F.col("f1"), F.col("f2")])
    return t.features.select(F.col("bbl").alias("vec_id"), F.round(prob, 6).alias("prob"))


@query(
    "blend_coverage_I4",
    """SELECT round(100.0*(SELECT count(*) FROM (SELECT DISTINCT prow, pcol FROM patch_px))/(height*width), 6) AS coverage_pct,
    (SELECT round(avg(m), 6) FROM (SELECT avg(prob) AS m FROM patch_px GROUP BY row_off, col_off)) AS mean_prob,
    (SELECT count(*) FROM (SELECT DISTINCT row_off, col_off FROM patch_px)) AS patches FROM dims""",
    "patch_px",
)
def _(t: Inputs):
    blended = scoring.blend_buildings(t.patch_scores, 8)
    return _round(scoring.coverage_report(blended, t.patch_scores, t.height * WIDTH), ["coverage_pct", "mean_prob"])


@query("overlap_average_I5", "SELECT prow, pcol, round(avg(prob), 6) AS prob, count(*) AS overlap FROM patch_px GROUP BY 1, 2", "patch_px")
def _(t: Inputs):
    return _round(scoring.overlap_average(t.patch_scores), ["prob"])


@query(
    "overlap_report_I5",
    "SELECT max(n) AS max_overlap, round(avg(n), 6) AS mean_overlap, count(*) AS cells FROM (SELECT count(*) AS n FROM patch_px GROUP BY prow, pcol)",
    "patch_px",
)
def _(t: Inputs):
    return _round(scoring.overlap_report(scoring.overlap_average(t.patch_scores)), ["mean_overlap"])


@query(
    "outcome_map_I6",
    """SELECT prow, pcol, outcome, CASE outcome WHEN 'FP' THEN 255 WHEN 'ignore' THEN 255 ELSE 0 END AS red,
    CASE outcome WHEN 'TP' THEN 255 WHEN 'ignore' THEN 255 ELSE 0 END AS green, CASE outcome WHEN 'FN' THEN 255 WHEN 'ignore' THEN 255 ELSE 0 END AS blue, CASE outcome WHEN 'ignore' THEN 0 ELSE 255 END AS alpha FROM (
    SELECT prow, pcol, CASE WHEN label = 255 OR prob IS NULL THEN 'ignore' WHEN label = 1 THEN CASE WHEN prob > 0.298 THEN 'TP' ELSE 'FN' END
    ELSE CASE WHEN prob > 0.298 THEN 'FP' ELSE 'TN' END END AS outcome FROM score_cells)""",
    "score_cells",
)
def _(t: Inputs):
    out = scoring.outcome_map(t.score_tiles, t.tiles, 0.298)
    rgba = scoring.outcome_rgba(F.col("outcome"))
    channels = [F.get(rgba, F.lit(k)).alias(c) for k, c in enumerate(("red", "green", "blue", "alpha"))]
    return out.select("prow", "pcol", "outcome", *channels)


# ---------------------------------------------------------------- pixel metrics

_COUNTS = "count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn"
_SCORED = "(SELECT *, (prob > 0.5)::INT AS p FROM scores)"


def metrics_sql(source: str, by: str) -> str:
    return f"""SELECT {by}, tp, fp, fn, tn, n, round(iou, 6) AS iou, round(dice, 6) AS dice, round(pr, 6) AS precision, round(rc, 6) AS recall,
    round(2*pr*rc/greatest(pr+rc, 1e-8), 6) AS f1, round(5*pr*rc/greatest(4*pr+rc, 1e-8), 6) AS f2, round((po-pe)/greatest(1-pe, 1e-8), 6) AS kappa FROM (
    SELECT *, tp+fp+fn+tn AS n, tp/greatest(tp+fp+fn, 1) AS iou, 2*tp/greatest(2*tp+fp+fn, 1) AS dice, tp/greatest(tp+fp, 1) AS pr, tp/greatest(tp+fn, 1) AS rc,
    (tp+tn)/greatest(tp+fp+fn+tn, 1) AS po, ((tp+fp)::DOUBLE*(tp+fn) + (tn+fn)::DOUBLE*(tn+fp))/greatest(tp+fp+fn+tn, 1)::DOUBLE/greatest(tp+fp+fn+tn, 1) AS pe FROM ({source}))"""


_ROUNDED = ("iou", "dice", "precision", "recall", "f1", "f2", "kappa")


@query("confusion_metrics_E1", metrics_sql(f"SELECT split, run_no, {_COUNTS} FROM {_SCORED} GROUP BY 1, 2", "split, run_no"), "scores")
def _(t: Inputs):
    counts = E.confusion_counts(t.scores, F.col("y"), (F.col("prob") > 0.5).cast("int"), by=["split", "run_no"])
    return _round(E.with_metrics(counts), _ROUNDED)


@query("epoch_metrics_E21", metrics_sql(f"SELECT run_no, {_COUNTS} FROM {_SCORED} GROUP BY 1", "run_no"), "scores")
def _(t: Inputs):
    batches = E.confusion_counts(t.scores, F.col("y"), (F.col("prob") > 0.5).cast("int"), by=["split", "run_no"])
    return _round(E.epoch_metrics(batches, by=["run_no"]), _ROUNDED)


def _curve(source: str, by: str = "", weight: str = "1") -> str:
    """Precision and recall at every distinct score of each group."""
    part, over = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"""SELECT {part}prob AS threshold, cp/(cp+cn) AS precision, cp/nullif(max(cp) OVER ({over}), 0) AS recall, pos/nullif(max(cp) OVER ({over}), 0) AS gain FROM (
    SELECT {part}prob, pos, sum(pos) OVER ({over}ORDER BY prob DESC) AS cp, sum(neg) OVER ({over}ORDER BY prob DESC) AS cn FROM (
    SELECT {part}prob, sum({weight}*y)::DOUBLE AS pos, sum({weight}*(1-y))::DOUBLE AS neg FROM {source} GROUP BY {part}prob))"""


@query("average_precision_E3", f"SELECT split, run_no, round(sum(gain*precision), 6) AS average_precision FROM ({_curve('scores', 'split, run_no')}) GROUP BY 1, 2", "scores")
def _(t: Inputs):
    return _round(E.average_precision(t.scores, by=["split", "run_no"]), ["average_precision"])


@query(
    "weighted_precision_E3",
    f"WITH w AS (SELECT *, CASE y WHEN 1 THEN 2.5 ELSE 1.25 END::DOUBLE AS w FROM scores) SELECT round(sum(gain*precision), 6) AS average_precision FROM ({_curve('w', weight='w')})",
    "scores",
)
def _(t: Inputs):
    weighted = t.scores.withColumn("w", F.when(F.col("y") == 1, 2.5).otherwise(1.25))
    return _round(E.average_precision(weighted, weight="w"), ["average_precision"])


@query(
    "pr_curve_E4_W4",
    f"SELECT split, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM ({_curve('scores', 'split')})",
    "scores",
)
def _(t: Inputs):
    return _round(E.pr_points(t.scores, by=["split"]), ["precision", "recall"])


for _beta, _name in ((1.0, "f1_threshold_E5"), (2.0, "f2_threshold_E5_W5")):

    @query(
        _name,
        f"""SELECT split, run_no, arg_max(threshold, (f, -threshold)) AS threshold FROM (SELECT *, round({1 + _beta**2}*precision*recall/greatest({_beta**2}*precision+recall, 1e-8), 12) AS f
        FROM ({_curve('scores', 'split, run_no')})) GROUP BY 1, 2""",
        "scores",
    )
    def _(t: Inputs, beta=_beta):
        return E.best_threshold(E.pr_points(t.scores, by=["split", "run_no"]), beta=beta, by=["split", "run_no"])


@query(
    "threshold_default_E5",
    f"""SELECT r_regionkey AS run_no, coalesce(t, 0.5) AS threshold FROM region LEFT JOIN (SELECT run_no, arg_max(threshold, (5*precision*recall/greatest(4*precision+recall, 1e-8), -threshold)) AS t
    FROM ({_curve('scores', 'run_no')}) GROUP BY 1) ON run_no = r_regionkey""",
    "scores",
)
def _(t: Inputs):
    runs = t.table("region").select(F.col("r_regionkey").alias("run_no"))
    return E.thresholds_for(runs, E.pr_points(t.scores, by=["run_no"]), by=["run_no"])


@query(
    "class_report_E6",
    """WITH c AS (SELECT o_orderstatus AS y, substr('FOP', (o_custkey % 3 + 1)::INT, 1) AS p FROM orders),
    k AS (SELECT y AS class, count(*) AS support, count(*) FILTER (p = y) AS tp FROM c GROUP BY 1), q AS (SELECT p AS class, count(*) AS called FROM c GROUP BY 1),
    m AS (SELECT class, support, tp/called AS pr, tp/support AS rc FROM k JOIN q USING (class)), f AS (SELECT *, 2*pr*rc/(pr+rc) AS f1 FROM m)
    SELECT class, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1, support FROM f
    UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(rc), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f
    UNION ALL SELECT 'weighted avg', round(sum(pr*support)/sum(support), 6), round(sum(rc*support)/sum(support), 6), round(sum(f1*support)/sum(support), 6), sum(support)::BIGINT FROM f""",
)
def _(t: Inputs):
    called = F.substring(F.lit("FOP"), (F.col("o_custkey") % 3 + 1).cast("int"), F.lit(1))
    df = t.table("orders").select(F.col("o_orderstatus").alias("y"), called.alias("p"))
    return _round(E.class_report(df, "y", "p"), ["precision", "recall", "f1"])


@query(
    "confusion_matrix_E7",
    f"SELECT split, y AS actual, p AS predicted, count(*) AS cells, round(100.0*count(*)/sum(count(*)) OVER (PARTITION BY split), 6) AS pct FROM {_SCORED} GROUP BY split, y, p",
    "scores",
)
def _(t: Inputs):
    counts = E.confusion_counts(t.scores, F.col("y"), (F.col("prob") > 0.5).cast("int"), by=["split"])
    return _round(E.confusion_matrix(counts), ["pct"])


_LABELLED = "(SELECT prob, label AS y FROM score_cells WHERE label <> 255 AND prob IS NOT NULL)"


@query(
    "score_evaluation_E2",
    "SELECT m.* EXCLUDE (one), a.average_precision FROM ("
    + metrics_sql("SELECT 1 AS one, " + _COUNTS + f" FROM (SELECT y, (prob > 0.5)::INT AS p FROM {_LABELLED})", "one")
    + f") m, (SELECT round(sum(gain*precision), 6) AS average_precision FROM ({_curve(_LABELLED)})) a",
    "score_cells",
)
def _(t: Inputs):
    scored = t.score_cells.where("prob IS NOT NULL").join(t.mask, ["prow", "pcol"])
    return _round(E.evaluate_scores(scored), [*_ROUNDED, "average_precision"])


# ---------------------------------------------------------------- parcel evaluation

_COVERAGES = (0.1, 0.2, 0.3, 0.5)


def fractions(t: Inputs):
    labelled = parcels.apply_overrides(
        t.lots.select("bbl", "bldg_class", "land_use", "boro_code", "geom"), t.overrides, VACANT_CODES + ["V0"]
    )
    return zonal.prediction_fraction(labelled, t.score_tiles, t.grid, pixel_threshold=0.5, min_pixels=5)


def outcomes(t: Inputs):
    return E.outcomes_long(fractions(t), _COVERAGES)


@query(
    "parcel_fraction_E8",
    "SELECT bbl, bldg_class, is_vacant, valid_pixels, pred_pixels, round(pred_fraction, 6) AS pred_fraction FROM fractions",
    "fractions",
)
def _(t: Inputs):
    out = fractions(t).select("bbl", "bldg_class", "is_vacant", "valid_pixels", "pred_pixels", "pred_fraction")
    return _round(out, ["pred_fraction"])


@query(
    "recall_at_coverage_E9",
    "SELECT coverage, count(*) FILTER (pred_fraction >= coverage) AS detected, count(*) AS parcels, round(count(*) FILTER (pred_fraction >= coverage)/count(*), 6) AS recall FROM fractions, (SELECT unnest([0.3,0.5,0.7])::DOUBLE AS coverage) WHERE is_vacant GROUP BY 1",
    "fractions",
)
def _(t: Inputs):
    return _round(E.recall_at(fractions(t).where("is_vacant")), ["recall"])


@query(
    "recall_curve_E10",
    "SELECT i::INT AS step, i/200.0::DOUBLE AS coverage, round((SELECT count(*) FROM fractions WHERE is_vacant AND pred_fraction >= i/200.0::DOUBLE - 1e-11)/(SELECT count(*) FROM fractions WHERE is_vacant), 6) AS recall FROM unnest(range(201)) AS a(i)",
    "fractions",
)
def _(t: Inputs):
    return _round(E.recall_curve(fractions(t).where("is_vacant")), ["recall"])


@query(
    "fraction_summary_E11",
    "SELECT round(avg(pred_fraction), 6) AS mean, round(quantile_cont(pred_fraction, 0.5), 6) AS median, round(avg((pred_fraction >= 0.1)::INT), 6) AS share_10, round(avg((pred_fraction >= 0.2)::INT), 6) AS share_20 FROM fractions WHERE is_vacant",
    "fractions",
)
def _(t: Inputs):
    return _round(E.fraction_summary(fractions(t).where("is_vacant")), ["mean", "median", "share_10", "share_20"])


@query(
    "recall_by_borough_E12",
    "SELECT boro_code, 0.3::DOUBLE AS coverage, count(*) FILTER (pred_fraction >= 0.3) AS detected, count(*) AS parcels, round(count(*) FILTER (pred_fraction >= 0.3)/count(*), 6) AS recall FROM fractions WHERE is_vacant GROUP BY 1",
    "fractions",
)
def _(t: Inputs):
    return _round(E.recall_at(fractions(t).where("is_vacant"), [0.3], by=["boro_code"]), ["recall"])


@query(
    "parcel_outcomes_E13",
    "SELECT bbl, " + ", ".join(f"max(outcome) FILTER (coverage = {c}) AS label_{round(c * 100)}" for c in _COVERAGES) + " FROM outcomes GROUP BY 1",
    "outcomes",
)
def _(t: Inputs):
    return E.outcome_columns(fractions(t), _COVERAGES).select("bbl", *[f"label_{round(c * 100)}" for c in _COVERAGES])


for _population, _zeroed in (("all", ()), ("vacant", ("fp", "tn")), ("nonvacant", ("tp", "fn"))):

    @query(
        f"parcel_confusion_{_population}_E14",
        f"""SELECT coverage, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(5*p*r/nullif(4*p+r, 0), 0), 6) AS f2 FROM (
        SELECT *, coalesce(tp/nullif(tp+fp, 0), 0) AS p, coalesce(tp/nullif(tp+fn, 0), 0) AS r FROM (
        SELECT coverage, {", ".join(f"0::BIGINT AS {c}" if c in _zeroed else f"count(*) FILTER (outcome = '{c.upper()}') AS {c}" for c in E.COUNTS)} FROM outcomes GROUP BY 1))""",
        "outcomes",
    )
    def _(t: Inputs, population=_population):
        return _round(E.parcel_confusion(outcomes(t), population), ["precision", "recall", "f2"])


def _case(column: str, mapping: dict) -> str:
    return f"coalesce(CASE {column} {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in mapping.items())} END, 'Unknown')"


@query(
    "fp_by_land_use_E15",
    f"""SELECT coverage, land_use, {_case('land_use', LAND_USE_LABELS)} AS land_use_label, fp AS fp_count, round(100.0*fp/sum(fp) OVER (PARTITION BY coverage), 6) AS pct_of_fp, round(100.0*fp/n, 6) AS fp_rate
    FROM (SELECT coverage, lpad(coalesce(land_use, ''), 2, '0') AS land_use, count(*) FILTER (outcome = 'FP') AS fp, count(*) AS n FROM outcomes GROUP BY 1, 2) WHERE fp > 0""",
    "outcomes",
)
def _(t: Inputs):
    return _round(E.false_positives_by_land_use(outcomes(t)), ["pct_of_fp", "fp_rate"])


@query(
    "fp_by_class_prefix_E16",
    f"""SELECT coverage, prefix, fp_count, round(100.0*fp_count/tot, 6) AS pct_of_fp, {_case('prefix', CLASS_PREFIX_LABELS)} AS category FROM (
    SELECT *, sum(fp_count) OVER (PARTITION BY coverage) AS tot, row_number() OVER (PARTITION BY coverage ORDER BY fp_count DESC, prefix) AS k FROM (
    SELECT coverage, upper(substr(bldg_class, 1, 1)) AS prefix, count(*) AS fp_count FROM outcomes WHERE outcome = 'FP' GROUP BY 1, 2)) WHERE k <= 15""",
    "outcomes",
)
def _(t: Inputs):
    return _round(E.false_positives_by_prefix(outcomes(t)), ["pct_of_fp"])


@query(
    "fn_by_class_E17",
    """SELECT coverage, class_code, fn_count, round(100.0*fn_count/tot, 6) AS pct_of_fn FROM (
    SELECT *, sum(fn_count) OVER (PARTITION BY coverage) AS tot, row_number() OVER (PARTITION BY coverage ORDER BY fn_count DESC, class_code) AS k FROM (
    SELECT coverage, substr(bldg_class, 1, 2) AS class_code, count(*) AS fn_count FROM outcomes WHERE outcome = 'FN' GROUP BY 1, 2)) WHERE k <= 15""",
    "outcomes",
)
def _(t: Inputs):
    return _round(E.false_negatives_by_class(outcomes(t)), ["pct_of_fn"])


@query(
    "tp_rate_by_class_E18",
    """SELECT coverage, class_code, tp, fn, parcels, round(tp/parcels, 6) AS tp_rate FROM (SELECT *, row_number() OVER (PARTITION BY coverage ORDER BY tp/parcels DESC, class_code) AS k FROM (
    SELECT coverage, substr(bldg_class, 1, 2) AS class_code, count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FN') AS fn, count(*) AS parcels
    FROM outcomes WHERE is_vacant GROUP BY 1, 2) WHERE parcels >= 3) WHERE k <= 15""",
    "outcomes",
)
def _(t: Inputs):
    return _round(E.detection_rate_by_class(outcomes(t)), ["tp_rate"])


@query("nearest_coverage_E19", "SELECT coverage, outcome, count(*) AS parcels FROM outcomes WHERE coverage = 0.3 GROUP BY 1, 2", "outcomes")
def _(t: Inputs):
    return E.nearest_coverage(outcomes(t), 0.36).groupBy("coverage", "outcome").agg(F.count("*").alias("parcels"))


@query("split_borough_filter_E20", "SELECT bbl, boro_code FROM attrs WHERE boro_code IN (1, 2, 4)", "attrs")
def _(t: Inputs):
    # Region keys 0, 1 and 3 stand for the boroughs a run held out for validation.
    held_out = F.when(F.col("r_regionkey").isin(0, 1, 3), "val").otherwise("train")
    splits = t.table("region").groupBy(held_out.alias("split")).agg(F.collect_set((F.col("r_regionkey") + 1).cast("int")).alias("boroughs"))
    return E.parcels_in_split(t.part_attributes, splits, "val").select("bbl", "boro_code")
