"""Pixel and parcel evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotgrid.functions.attributes import class_prefix, class_prefix_label, clean_land_use, land_use_label
from lotgrid.operators.ranking import best_by, column_quantiles, running_totals
from lotgrid.operators.summary import share_within
from lotgrid.session import cut_lineage

COUNTS = ("tp", "fp", "fn", "tn")
METRICS = ("iou", "dice", "precision", "recall", "f1", "f2", "kappa", "n")


# ---------------------------------------------------------------- confusion and metrics


def confusion_counts(df: DataFrame, label: Column, pred: Column, *, by=()) -> DataFrame:
    """TP/FP/FN/TN over labelled rows (0 or 1): one partial aggregate."""
    pos, hit = label == 1, pred == 1
    return df.where(label.isin(0, 1)).groupBy(*by).agg(
        F.count_if(pos & hit).alias("tp"),
        F.count_if(~pos & hit).alias("fp"),
        F.count_if(pos & ~hit).alias("fn"),
        F.count_if(~pos & ~hit).alias("tn"),
    )


def _at_least(value: Column, low) -> Column:
    return F.greatest(value, F.lit(low))


def with_metrics(counts: DataFrame) -> DataFrame:
    """IoU, Dice, precision, recall, F1, F2 and Cohen's kappa; zero counts give zeros."""
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    n = tp + fp + fn + tn
    precision, recall = tp / _at_least(tp + fp, 1), tp / _at_least(tp + fn, 1)
    base = counts.withColumns(
        {
            "n": n,
            "iou": tp / _at_least(tp + fp + fn, 1),
            "dice": 2 * tp / _at_least(2 * tp + fp + fn, 1),
            "precision": precision,
            "recall": recall,
        }
    )
    p, r = F.col("precision"), F.col("recall")
    total = _at_least(F.col("n"), 1).cast("double")
    observed = (tp + tn) / total
    expected = ((tp + fp) / total) * ((tp + fn) / total) + ((tn + fn) / total) * ((tn + fp) / total)
    return base.withColumns(
        {
            "f1": f_beta(p, r, 1.0),
            "f2": f_beta(p, r, 2.0),
            "kappa": (observed - expected) / _at_least(1 - expected, 1e-8),
        }
    )


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b2 = beta * beta
    return (1 + b2) * precision * recall / _at_least(b2 * precision + recall, 1e-8)


def epoch_metrics(batches: DataFrame, by=("run_id", "epoch")) -> DataFrame:
    """Micro-averaged metrics per epoch: batch counts are summed before any ratio."""
    return with_metrics(batches.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS]))


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """Long confusion matrix with % of all cells."""
    keys = [c for c in counts.columns if c not in COUNTS]
    cell = F.explode(
        F.array(
            *[
                F.struct(F.lit(actual).alias("actual"), F.lit(predicted).alias("predicted"), F.col(c).alias("cells"))
                for actual, predicted, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
            ]
        )
    ).alias("m")
    total = F.nullif(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), F.lit(0))
    return counts.select(*keys, cell, total.alias("_total")).select(
        *keys, "m.*", (100.0 * F.col("m.cells") / F.col("_total")).alias("pct")
    )


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1, support per class and their macro and weighted averages."""
    pairs = df.groupBy(F.col(label).alias("y"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    classes = pairs.select(F.col("y").alias("class")).union(pairs.select(F.col("p"))).distinct()
    hits = pairs.groupBy("y").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    calls = pairs.groupBy("p").agg(F.sum("n").alias("called"))
    zero = F.lit(0.0)
    per_class = (
        classes.join(hits, classes["class"] == hits["y"], "left")
        .join(calls, classes["class"] == calls["p"], "left")
        .select(
            F.col("class").cast("string").alias("class"),
            F.coalesce(F.try_divide("tp", "called"), zero).alias("precision"),
            F.coalesce(F.try_divide("tp", "support"), zero).alias("recall"),
            F.coalesce("support", F.lit(0)).alias("support"),
        )
    )
    p, r = F.col("precision"), F.col("recall")
    per_class = per_class.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), zero))
    values = ("precision", "recall", "f1")
    macro = per_class.agg(*[F.avg(v).alias(v) for v in values], F.sum("support").alias("support")).withColumn("class", F.lit("macro avg"))
    weighted = per_class.agg(
        *[(F.sum(F.col(v) * F.col("support")) / F.sum("support")).alias(v) for v in values], F.sum("support").alias("support")
    ).withColumn("class", F.lit("weighted avg"))
    return per_class.unionByName(macro).unionByName(weighted)


# ---------------------------------------------------------------- precision-recall


def score_totals(scores: DataFrame, *, by=(), weight: str | None = None) -> DataFrame:
    """Stored (by, prob, pos, neg): weighted positives and negatives per distinct score.

    The only pass over the scores; confusion counts at any threshold, the curve and
    the average precision all follow from this table.
    """
    w = F.col(weight) if weight else F.lit(1)
    merged = (
        scores.where(F.col("prob").isNotNull())
        .groupBy(*by, "prob")
        .agg(F.sum(w * F.col("y")).alias("pos"), F.sum(w * (1 - F.col("y"))).alias("neg"))
    )
    return cut_lineage(merged, "score-totals")


def counts_from_totals(totals: DataFrame, *, by=(), threshold: float = 0.5) -> DataFrame:
    """TP/FP/FN/TN of ``prob > threshold`` from unweighted score totals."""
    hit = F.col("prob") > threshold
    zero = F.lit(0).cast("bigint")

    def total(column: str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(column))), zero).cast("bigint")

    return totals.groupBy(*by).agg(
        total("pos", hit).alias("tp"), total("neg", hit).alias("fp"), total("pos", ~hit).alias("fn"), total("neg", ~hit).alias("tn")
    )


def curve_from_totals(totals: DataFrame, *, by=()) -> DataFrame:
    """(by, threshold, precision, recall) per distinct score, highest first, plus the recall gained there."""
    by = list(by)
    sums = {"_cum_pos": "pos", "_cum_neg": "neg"}
    run = running_totals(totals, "prob", sums, by=tuple(by), descending=True)
    if by:
        positives = totals.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(F.sum("pos").alias("_all"))
        joined = run.join(positives, [run[c].eqNullSafe(positives[f"_g_{c}"]) for c in by])
    else:
        joined = run.withColumn("_all", totals.agg(F.sum("pos")).scalar())
    return joined.select(
        *by,
        F.col("prob").alias("threshold"),
        F.try_divide("_cum_pos", F.col("_cum_pos") + F.col("_cum_neg")).alias("precision"),
        F.try_divide("_cum_pos", "_all").alias("recall"),
        F.try_divide("pos", "_all").alias("_gain"),
    )


def precision_from_totals(totals: DataFrame, *, by=()) -> DataFrame:
    """Step-wise average precision with tied scores merged; null without positives."""
    curve = curve_from_totals(totals, by=by)
    return curve.groupBy(*by).agg(F.sum(F.col("_gain") * F.col("precision")).alias("average_precision"))


def average_precision(scores: DataFrame, *, by=(), weight: str | None = None) -> DataFrame:
    return precision_from_totals(score_totals(scores, by=by, weight=weight), by=by)


def pr_points(scores: DataFrame, *, by=(), weight: str | None = None) -> DataFrame:
    """PR curve points: one per distinct score."""
    return curve_from_totals(score_totals(scores, by=by, weight=weight), by=by).drop("_gain")


def best_threshold(points: DataFrame, *, beta: float = 2.0, by=()) -> DataFrame:
    """Threshold with the highest F-beta, the smaller one on ties."""
    scored = points.withColumn("_f", f_beta(F.col("precision"), F.col("recall"), beta))
    return best_by(scored, "threshold", "_f", tuple(by))


def thresholds_for(runs: DataFrame, points: DataFrame, *, by=("run_id",), beta: float = 2.0, default: float = 0.5) -> DataFrame:
    """Best threshold of every run, ``default`` where it has no curve."""
    return runs.join(best_threshold(points, beta=beta, by=by), list(by), "left").withColumn(
        "threshold", F.coalesce("threshold", F.lit(default))
    )


def _combine(metrics: DataFrame, precision: DataFrame, by) -> DataFrame:
    if not by:
        return metrics.withColumn("average_precision", precision.scalar())
    return metrics.join(precision, list(by), "left")


def evaluate_scores(scored: DataFrame, *, by=(), threshold: float = 0.5) -> DataFrame:
    """Confusion metrics and average precision of a scored table (label 0/1/255, prob), in one pass over it."""
    by = list(by)
    labelled = scored.where(F.col("label").isin(0, 1)).withColumn("y", F.col("label"))
    totals = score_totals(labelled, by=by)
    metrics = with_metrics(counts_from_totals(totals, by=by, threshold=threshold))
    return _combine(metrics, precision_from_totals(totals, by=by), by)


def evaluate_model(features: DataFrame, model, *, by=()) -> DataFrame:
    """One model, a fitted pipeline or a flat forest, applied to splits: confusion and average precision over every labelled cell, each scored once."""
    from lotgrid.operators.scoring import FlatForest, score_with_forest, score_with_model

    labelled = features.where(F.col("label").isin(0, 1))
    scored = score_with_forest(labelled, model) if isinstance(model, FlatForest) else score_with_model(labelled, model)
    return evaluate_scores(scored, by=by)


# ---------------------------------------------------------------- parcel recall


def _each(values, name: str) -> Column:
    return F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(name)


def recall_at(fractions: DataFrame, coverages=(0.3, 0.5, 0.7), *, by=()) -> DataFrame:
    """Detected parcels, all parcels and recall per coverage threshold."""
    spread = fractions.select(*by, "pred_fraction", _each(coverages, "coverage"))
    return spread.groupBy(*by, "coverage").agg(
        F.count_if(F.col("pred_fraction") >= F.col("coverage")).alias("detected"), F.count("*").alias("parcels")
    ).withColumn("recall", F.col("detected") / F.col("parcels"))


def recall_curve(fractions: DataFrame, steps: int = 200) -> DataFrame:
    """Recall at coverage i/steps for i = 0..steps: a histogram of steps+1 bins, then a running sum."""
    bins = (
        fractions.where(F.col("pred_fraction").isNotNull())
        .groupBy(F.floor(F.col("pred_fraction") * steps + 1e-9).cast("int").alias("_bin"))
        .agg(F.count("*").alias("_n"))
    )
    total = fractions.agg(F.count("*")).scalar()
    axis = fractions.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    return axis.join(bins, axis["step"] == bins["_bin"], "left").select(
        "step",
        (F.col("step") / F.lit(float(steps))).alias("coverage"),
        (F.sum(F.coalesce("_n", F.lit(0))).over(above) / total).alias("recall"),
    )


def fraction_summary(fractions: DataFrame) -> DataFrame:
    """Mean, exact median, and shares of parcels at 10 % and 20 %."""
    f = F.col("pred_fraction")
    known = cut_lineage(fractions.where(f.isNotNull()).select("pred_fraction"), "fractions")
    median = F.lit(column_quantiles(known, ["pred_fraction"], [0.5])["pred_fraction"].get(0.5)).cast("double")
    return known.agg(
        F.avg(f).alias("mean"), F.avg((f >= 0.1).cast("int")).alias("share_10"), F.avg((f >= 0.2).cast("int")).alias("share_20")
    ).withColumn("median", median)


# ---------------------------------------------------------------- parcel outcomes


def parcel_outcome(coverage) -> Column:
    hit = F.col("pred_fraction") >= coverage
    return (
        F.when(F.col("pred_fraction").isNull(), "NA")
        .when(F.col("is_vacant"), F.when(hit, "TP").otherwise("FN"))
        .otherwise(F.when(hit, "FP").otherwise("TN"))
    )


def outcome_columns(fractions: DataFrame, coverages=(0.1, 0.2, 0.3, 0.5)) -> DataFrame:
    """One ``label_<pct>`` column per coverage."""
    return fractions.withColumns({f"label_{round(c * 100)}": parcel_outcome(F.lit(float(c))) for c in coverages})


def outcomes_long(fractions: DataFrame, coverages=(0.1, 0.2, 0.3, 0.5)) -> DataFrame:
    """One row per (parcel, coverage) with its outcome."""
    return fractions.select("*", _each(coverages, "coverage")).withColumn("outcome", parcel_outcome(F.col("coverage")))


def parcel_confusion(outcomes: DataFrame, population: str = "all") -> DataFrame:
    """Counts, precision, recall, F2 per coverage; ``population`` all, vacant or nonvacant."""
    counted = {"all": COUNTS, "vacant": ("tp", "fn"), "nonvacant": ("fp", "tn")}[population]
    out = outcomes.groupBy("coverage").agg(
        *[(F.count_if(F.col("outcome") == c.upper()) if c in counted else F.lit(0).cast("bigint")).alias(c) for c in COUNTS]
    )
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return out.withColumns(
        {"precision": p, "recall": r, "f2": F.coalesce(F.try_divide(5 * p * r, 4 * p + r), F.lit(0.0))}
    )


def false_positives_by_land_use(outcomes: DataFrame) -> DataFrame:
    """FP count, % of all FPs and FP rate per land use and coverage, classes without FP left out."""
    counted = outcomes.groupBy("coverage", clean_land_use(F.col("land_use")).alias("land_use")).agg(
        F.count_if(F.col("outcome") == "FP").alias("fp_count"), F.count("*").alias("parcels")
    )
    shares = share_within(counted.where("fp_count > 0"), "fp_count", ["coverage"], "pct_of_fp")
    return shares.select(
        "coverage",
        "land_use",
        land_use_label(F.col("land_use")).alias("land_use_label"),
        "fp_count",
        (100 * F.col("pct_of_fp")).alias("pct_of_fp"),
        (100.0 * F.col("fp_count") / F.col("parcels")).alias("fp_rate"),
    ).orderBy("coverage", F.desc("fp_count"), "land_use")


def _top_per_coverage(df: DataFrame, n: int, *order) -> DataFrame:
    # A rank filter: Spark keeps the first n per coverage in every task before the shuffle.
    w = Window.partitionBy("coverage").orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def false_positives_by_prefix(outcomes: DataFrame, n: int = 15) -> DataFrame:
    fp = outcomes.where(F.col("outcome") == "FP")
    counted = fp.groupBy("coverage", class_prefix(F.col("bldg_class")).alias("prefix")).agg(F.count("*").alias("fp_count"))
    shares = share_within(counted, "fp_count", ["coverage"], "pct_of_fp").withColumn("pct_of_fp", 100 * F.col("pct_of_fp"))
    return _top_per_coverage(shares, n, F.desc("fp_count"), "prefix").withColumn("category", class_prefix_label(F.col("prefix")))


def false_negatives_by_class(outcomes: DataFrame, n: int = 15) -> DataFrame:
    fn = outcomes.where(F.col("outcome") == "FN")
    counted = fn.groupBy("coverage", class_prefix(F.col("bldg_class"), 2).alias("class_code")).agg(F.count("*").alias("fn_count"))
    shares = share_within(counted, "fn_count", ["coverage"], "pct_of_fn").withColumn("pct_of_fn", 100 * F.col("pct_of_fn"))
    return _top_per_coverage(shares, n, F.desc("fn_count"), "class_code")


def detection_rate_by_class(outcomes: DataFrame, min_parcels: int = 3, n: int = 15) -> DataFrame:
    """TP, FN and TP rate per class of the vacant parcels with at least ``min_parcels``."""
    counted = (
        outcomes.where("is_vacant")
        .groupBy("coverage", class_prefix(F.col("bldg_class"), 2).alias("class_code"))
        .agg(F.count_if(F.col("outcome") == "TP").alias("tp"), F.count_if(F.col("outcome") == "FN").alias("fn"), F.count("*").alias("parcels"))
        .where(F.col("parcels") >= min_parcels)
        .withColumn("tp_rate", F.col("tp") / F.col("parcels"))
    )
    return _top_per_coverage(counted, n, F.desc("tp_rate"), "class_code")


def nearest_coverage(outcomes: DataFrame, wanted: float) -> DataFrame:
    """Rows of the available coverage closest to ``wanted`` (the lower one on ties)."""
    available = outcomes.select("coverage").distinct()
    pick = available.agg(F.min_by("coverage", F.struct(F.abs(F.col("coverage") - wanted), "coverage"))).scalar()
    return outcomes.where(F.col("coverage") == pick)


def parcels_in_split(parcels: DataFrame, run_splits: DataFrame, split: str, code: str = "boro_code") -> DataFrame:
    """Parcels in the boroughs a run assigned to ``split``; run_splits holds (split, boroughs array)."""
    codes = run_splits.where(F.col("split") == split).select(F.explode("boroughs").alias("_code")).distinct()
    return parcels.join(codes, parcels[code] == codes["_code"], "left_semi")
