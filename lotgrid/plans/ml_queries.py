"""Imputation, scaling, clustering and classifiers on the feature table and the raster."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lotgrid.functions.hashing import cell_key
from lotgrid.functions.spectral import FEATURES, feature_stack
from lotgrid.operators import evaluation as E
from lotgrid.operators import impute, ml, scoring
from lotgrid.operators import patches as PT
from lotgrid.plans.inputs import N_FEATURES, Inputs
from lotgrid.plans.raster_queries import _FEATURES_SQL, _PATCHES, _PW8, split_grid
from lotgrid.plans.registry import query
from lotgrid.plans.sql_views import hash_sql
from lotgrid.session import cut_lineage, scratch_path

COLS = [f"f{i}" for i in range(N_FEATURES)]


def _round(df, columns):
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def _filled(method: str) -> str:
    fill = "quantile_cont({c}, 0.5)" if method == "median" else "avg({c})"
    return "SELECT bbl, " + ", ".join(f"round(coalesce({c}, (SELECT {fill.format(c=c)} FROM emb_gaps)), 6) AS {c}" for c in COLS) + " FROM emb_gaps"


for _method in ("median", "mean"):

    @query(f"impute_{_method}_D17", _filled(_method), "emb_gaps")
    def _(t: Inputs, method=_method):
        return _round(impute.impute(t.features_with_gaps, COLS, method).select("bbl", *COLS), COLS)


@query("impute_drop_D17", "SELECT bbl FROM emb_gaps WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in COLS), "emb_gaps")
def _(t: Inputs):
    return impute.impute(t.features_with_gaps, COLS, "drop").select("bbl")


@query(
    "imputed_cells_D17",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER ({c} IS NULL) AS filled FROM emb_gaps" for c in COLS),
    "emb_gaps",
)
def _(t: Inputs):
    return impute.missing_counts(t.features_with_gaps, COLS)


@query("feature_selection_D18", "SELECT label, round(avg(f0), 6) AS f0_mean, round(stddev_pop(f1), 6) AS \"f1_stdDev\" FROM emb GROUP BY 1", "emb")
def _(t: Inputs):
    stats = t.features.groupBy("label").agg(F.avg("f0").alias("f0_mean"), F.stddev_pop("f1").alias("f1_stdDev"), F.count("*").alias("f0_count"))
    return _round(stats.select("label", *impute.select_features(stats)), ["f0_mean", "f1_stdDev"])


@query(
    "standard_scaling_M1",
    "SELECT bbl, " + ", ".join(f"round(({c} - avg({c}) OVER ())/stddev_pop({c}) OVER (), 6) AS {c}" for c in COLS) + " FROM emb",
    "emb",
)
def _(t: Inputs):
    return _round(impute.standardise(t.features, COLS).select("bbl", *COLS), COLS)


def _vectors(t: Inputs):
    # Numbers of a fitted scaler keep the plan small; it is part of every step's query.
    return ml.assemble(impute.fit_scaler(t.features, COLS).apply(t.features), COLS).select("bbl", "features")


def _clusters(t: Inputs):
    return ml.fit_clusters(t.features_with_gaps, COLS, 4, components=2, key="bbl")


def _scaled_sql(table: str, filled: bool) -> str:
    """Vectors of scaled features, gaps filled with medians."""
    cell = "coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM {t}))" if filled else "{c}"
    whole = f"SELECT bbl, {', '.join(f'{cell.format(c=c, t=table)} AS {c}' for c in COLS)} FROM {table}"
    return f"SELECT bbl, [{', '.join(f'({c} - avg({c}) OVER ())/stddev_pop({c}) OVER ()' for c in COLS)}] AS x FROM ({whole})"


def _lloyd_sql(vectors: str, ks, restarts: int = 10, seed: int = 42) -> str:
    """CTEs ``fitted(k, c, x)``, ``hits(k, bbl, c, d)`` and ``v(bbl, x)`` of the k-means of every k, best restart."""
    ks = list(ks)
    firsts = " UNION ALL ".join(
        f"SELECT {r} AS r, row_number() OVER (ORDER BY {hash_sql('bbl', seed + r)}, bbl) - 1 AS c, x FROM v" for r in range(restarts)
    )
    steps = []
    for i in range(ml.MAX_STEPS + 1):
        steps.append(
            f"""h{i} AS MATERIALIZED (SELECT k, r, bbl, unnest([arg_min({{'c': c, 'd': d}}, (d, c))]) AS b FROM (
                SELECT m.k, m.r, v.bbl, m.c, list_distance(v.x, m.x)**2 AS d FROM v CROSS JOIN m{i} m) GROUP BY k, r, bbl)"""
        )
        if i < ml.MAX_STEPS:
            steps.append(
                f"""m{i + 1} AS MATERIALIZED (SELECT m.k, m.r, m.c, coalesce(n.x, m.x) AS x FROM m{i} m LEFT JOIN (
                    SELECT k, r, c, list(a ORDER BY j) AS x FROM (SELECT k, r, b.c AS c, j, avg(e) AS a FROM h{i} JOIN vl USING (bbl) GROUP BY k, r, b.c, j)
                    GROUP BY k, r, c) n ON n.k = m.k AND n.r = m.r AND n.c = m.c)"""
            )
    last = ml.MAX_STEPS
    return f"""v AS MATERIALIZED ({vectors}),
    vl AS MATERIALIZED (SELECT bbl, unnest(range(1, {len(COLS)} + 1)) AS j, unnest(x) AS e FROM v),
    m0 AS MATERIALIZED (SELECT k, r, c, x FROM ({firsts}), (SELECT unnest({ks}) AS k) WHERE c < k),
    {", ".join(steps)},
    top AS (SELECT k, arg_min(r, (cost, r)) AS r FROM (SELECT k, r, round(sum(b.d), 9) AS cost FROM h{last} GROUP BY k, r) GROUP BY k),
    hits AS MATERIALIZED (SELECT k, bbl, b.c AS c, b.d AS d FROM h{last} JOIN top USING (k, r)),
    fitted AS MATERIALIZED (SELECT k, c, x FROM m{last} JOIN top USING (k, r))"""


def _kmeans_query(table: str, filled: bool, ks, body: str) -> str:
    """The views of the feature table, the k-means, and what is read from it."""
    return f"SELECT * FROM (WITH {_lloyd_sql(_scaled_sql(table, filled), ks)} {body})"


@query("kmeans_M2", _kmeans_query("emb", False, [4], "SELECT c::INT AS cluster, count(*) AS n FROM hits GROUP BY 1"), "emb")
def _(t: Inputs):
    model = ml.fit_kmeans(_vectors(t), 4, restarts=10, key="bbl")
    return model.transform(_vectors(t)).groupBy("cluster").agg(F.count("*").alias("n"))


@query("pca_M3")
def _(t: Inputs):
    return _round(ml.fit_pca(_vectors(t), 2).apply(_vectors(t)).select("bbl", "pc1", "pc2"), ["pc1", "pc2"])


@query(
    "pca_equations_M3",
    f"SELECT component, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS norm, {float(N_FEATURES)}::DOUBLE AS total_variance FROM (SELECT unnest([1, 2, 3])::INT AS component)",
)
def _(t: Inputs):
    # C v = lambda v for every component, with C from one aggregate of its own; scaled features have a variance of 1 each.
    projection = ml.fit_pca(_vectors(t), 3)
    return _round(ml.pca_residuals(_vectors(t), projection), ["residual", "norm", "total_variance"])


@query("cluster_pipeline_M4")
def _(t: Inputs):
    return _round(_clusters(t).assign(t.features_with_gaps).select("bbl", "cluster", "pc1", "pc2"), ["pc1", "pc2"])


@query("cluster_pipeline_labels_M4", _kmeans_query("emb_gaps", True, [4], "SELECT bbl, c::INT AS cluster FROM hits"), "emb_gaps")
def _(t: Inputs):
    return _clusters(t).assign(t.features_with_gaps).select("bbl", "cluster")


@query(
    "cluster_assignment_M5",
    _kmeans_query(
        "emb_gaps",
        True,
        [4],
        "SELECT bbl, unnest([arg_min(c, (d, c))])::INT AS cluster FROM (SELECT n.bbl, f.c, list_distance(n.x, f.x)**2 AS d FROM (SELECT bbl, ["
        + ", ".join(f"({c} - (SELECT avg({c}) FROM filled))/(SELECT stddev_pop({c}) FROM filled)" for c in COLS)
        + "] AS x FROM emb) n CROSS JOIN fitted f) GROUP BY bbl",
    ).replace(
        "(WITH v AS",
        "(WITH filled AS MATERIALIZED (SELECT bbl, " + ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM emb_gaps)) AS {c}" for c in COLS) + " FROM emb_gaps), v AS",
        1,
    ),
    "emb_gaps",
)
def _(t: Inputs):
    # New rows: the complete table, assigned with the fill values and scales of the gappy one.
    return _clusters(t).assign(t.features).select("bbl", "cluster")


# The mean silhouette from the definition: mean squared distances between all rows of the small table.
_SILHOUETTE = """, pair AS MATERIALIZED (SELECT a.bbl AS p, b.bbl AS q, list_distance(a.x, b.x)**2 AS d FROM v a CROSS JOIN v b),
    near AS (SELECT a.k, a.bbl, a.c, b.c AS other, sum(p.d) AS s, count(*) AS n FROM hits a JOIN pair p ON p.p = a.bbl JOIN hits b ON b.k = a.k AND b.bbl = p.q GROUP BY ALL),
    ab AS (SELECT k, bbl, max(CASE WHEN c = other THEN n END) AS own, max(CASE WHEN c = other THEN s/greatest(n - 1, 1) END) AS a, min(CASE WHEN c <> other THEN s/n END) AS b FROM near GROUP BY k, bbl)
    SELECT k::INT AS k, inertia, silhouette FROM (SELECT k, round(sum(d), 6) AS inertia FROM hits GROUP BY k) JOIN
    (SELECT k, round(avg(CASE WHEN own > 1 THEN (b - a)/greatest(a, b) ELSE 0 END), 6) AS silhouette FROM ab GROUP BY k) USING (k)"""


@query("cluster_sweep_M6", _kmeans_query("emb", False, range(2, 11), "").removesuffix(" )") + _SILHOUETTE + ")", "emb")
def _(t: Inputs):
    return _round(ml.sweep_clusters(_vectors(t), range(2, 11), restarts=10, key="bbl"), ["inertia", "silhouette"])


@query(
    "cluster_importance_M7",
    _kmeans_query(
        "emb_gaps", True, [4], "SELECT 'f' || (j - 1) AS feature, round(stddev_pop(e), 6) AS importance FROM (SELECT unnest(range(1, len(x) + 1)) AS j, unnest(x) AS e FROM fitted) GROUP BY j"
    ),
    "emb_gaps",
)
def _(t: Inputs):
    return _round(ml.cluster_feature_importance(ml.centroid_table(t.spark, _clusters(t))), ["importance"])


@query("pca_loadings_M8")
def _(t: Inputs):
    return ml.loading_table(t.spark, ml.fit_pca(_vectors(t), 3), COLS)


def _scaled(t: Inputs):
    return impute.fit_scaler(t.features, COLS).apply(t.features).select("bbl", "y", *COLS)


MODELS = {
    # The folds of each are fitted together.
    "logistic": tuple(COLS),
    "kernel_svm": ml.SharedKernel(tuple(COLS)),
    # 30 is the deepest that Spark grows; the reference has no limit.
    "forest": ml.SharedForest(lambda: ml.forest(COLS, depth=30, min_leaf=1)),
}

@query(
    "balanced_weights_M9",
    "SELECT y, count(*) AS parcels, round(sum(count(*)) OVER ()/(2.0*count(*)), 6) AS weight FROM emb GROUP BY 1",
    "emb",
)
def _(t: Inputs):
    weighted = ml.balanced_weights(t.features)
    return weighted.groupBy("y").agg(F.count("*").alias("parcels"), F.round(F.max("weight"), 6).alias("weight"))


@query("logistic_M9")
def _(t: Inputs):
    return ml.held_out_scores(_scaled(t), COLS).select("bbl", "y", "fold", F.round("prob", 6).alias("prob"))


def _newton_sql(steps: int = 12) -> str:
    """Newton's steps for two scaled features and an intercept; the 3 x 3 systems by Cramer's rule."""
    ctes = ["b0 AS (SELECT 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2)"]
    for i in range(steps):
        h = {(0, 0): "sum(q*f0*f0) + 1", (0, 1): "sum(q*f0*f1)", (0, 2): "sum(q*f0)", (1, 1): "sum(q*f1*f1) + 1", (1, 2): "sum(q*f1)", (2, 2): "sum(q)"}
        g = ["sum(e*f0) + max(w0)", "sum(e*f1) + max(w1)", "sum(e)"]
        sums = ", ".join([f"{v} AS h{a}{b}" for (a, b), v in h.items()] + [f"{v} AS g{k}" for k, v in enumerate(g)] + [f"max(w{k}) AS w{k}" for k in range(3)])
        ctes.append(
            f"""s{i} AS MATERIALIZED (SELECT {sums} FROM (SELECT *, wt*p*(1 - p) AS q, wt*(p - y) AS e FROM (
                SELECT *, 1/(1 + exp(-(w0*f0 + w1*f1 + w2))) AS p FROM z, b{i})))"""
        )

        def det(m: list[list[str]]) -> str:
            (a, b, c), (d, e, f), (g_, h_, k) = m
            return f"({a}*({e}*{k} - {f}*{h_}) - {b}*({d}*{k} - {f}*{g_}) + {c}*({d}*{h_} - {e}*{g_}))"

        full = [[f"h{min(a, b)}{max(a, b)}" for b in range(3)] for a in range(3)]
        new = [f"w{k} - {det([[f'g{a}' if b == k else full[a][b] for b in range(3)] for a in range(3)])}/{det(full)} AS w{k}" for k in range(3)]
        ctes.append(f"b{i + 1} AS MATERIALIZED (SELECT {', '.join(new)} FROM s{i})")
    return ", ".join(ctes)


@query(
    "logistic_two_features_M9",
    f"""SELECT * FROM (WITH z AS MATERIALIZED (SELECT bbl, y, (f0 - avg(f0) OVER ())/stddev_pop(f0) OVER () AS f0, (f1 - avg(f1) OVER ())/stddev_pop(f1) OVER () AS f1,
    count(*) OVER ()/(2.0*count(*) OVER (PARTITION BY y)) AS wt FROM emb), {_newton_sql()}
    SELECT bbl, y, round(1/(1 + exp(-(w0*f0 + w1*f1 + w2))), 6) AS prob FROM z, b12)""",
    "emb",
)
def _(t: Inputs):
    df = _scaled(t)
    return ml.fit_logistic_folds(df, ["f0", "f1"])[-1].transform(df).select("bbl", "y", F.round("prob", 6).alias("prob"))


@query("kernel_svm_M10")
def _(t: Inputs):
    rows = cut_lineage(_scaled(t), "scaled-rows")
    model = MODELS["kernel_svm"](ml.balanced_weights(rows))
    return ml.positive_score(model.transform(rows)).select("bbl", "y", F.round("prob", 6).alias("prob"))


@query("forest_M11")
def _(t: Inputs):
    return MODELS["forest"](_scaled(t)).select("bbl", "y", F.round("prob", 6).alias("prob"))


# Settings of the pixel models.  The sample bounds the labelled rows of a fit, per class.
PIXEL_SAMPLE = {"n_vacant": 2000, "n_other": 4000}
PIXEL_FOREST = {"trees": 200, "depth": 20, "min_leaf": 50}
# 500 rounds of depth 12 are the full setting; rounds follow each other, see README for the time.
PIXEL_BOOSTING = {"rounds": 10, "depth": 12, "rate": 0.05, "min_leaf": 50}
PATCH = 8

_KEEP = ["prow", "pcol", "label", "split", "cell_id"]


def _cells(t: Inputs):
    """Raster cells of the patches that have a split, with it and an integer key for sampling."""
    splits = split_grid(t, PATCH, PATCH).where("split <> 'excluded'").select("row_off", "col_off", "split")
    cells = t.raster.withColumn("cell_id", cell_key(F.col("prow"), F.col("pcol")))
    at = {"row_off": F.col("prow") - F.col("prow") % PATCH, "col_off": F.col("pcol") - F.col("pcol") % PATCH}
    return cells.withColumns(at).join(splits, ["row_off", "col_off"]).drop("row_off", "col_off")


def _held_out(t: Inputs):
    """Features of the validation and test cells."""
    return feature_stack(_cells(t).where("split <> 'train'"), _KEEP)


def _fit_sample(t: Inputs):
    return PT.reservoir_pixels(_cells(t).where("split = 'train'"), **PIXEL_SAMPLE)


def _pixel_model(t: Inputs, pipeline):
    """Reservoir sample of the train split, seen/kept weights, fit.  Features are computed for the sampled cells only."""
    train = _cells(t).where("split = 'train'")
    sample = cut_lineage(_fit_sample(t), "pixel-sample")
    weights = {r["label"]: r["class_weight"] for r in PT.class_weights(PT.reservoir_report(train, sample)).collect()}
    features = feature_stack(sample, _KEEP).withColumn("y", F.col("label").cast("int"))
    with ml.kept(ml.class_weight_column(features, weights)) as rows:
        return pipeline.fit(rows)


_STORED: dict[tuple[str, str], str] = {}


def forest_path(t: Inputs) -> str:
    """The pixel forest of these tables: fitted and stored once in a session."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _STORED:
        path = scratch_path(t.spark, "pixel-forest")
        ml.save_model(t.spark, _pixel_model(t, ml.forest(FEATURES, **PIXEL_FOREST)), path, {"features": FEATURES, **PIXEL_FOREST})
        _STORED[key] = path
    return _STORED[key]


def _pixel_forest(t: Inputs):
    return ml.load_model(t.spark, forest_path(t))[0]


def _flat_forest(t: Inputs) -> scoring.FlatForest:
    return scoring.FlatForest.stored(t.spark, forest_path(t), FEATURES)


@query("pixel_forest_M12")
def _(t: Inputs):
    return E.evaluate_model(_held_out(t), _flat_forest(t), by=["split"])


@query("pixel_boosting_M13")
def _(t: Inputs):
    return E.evaluate_model(_held_out(t), _pixel_model(t, ml.boosting(FEATURES, **PIXEL_BOOSTING)), by=["split"])


# Cells of a fit that are evaluated too: none with the split, some when the sample is drawn from all cells.
_FIT_SQL = (
    _PW8
    + _PATCHES
    + """, cells AS (SELECT prow, pcol, r.label, split FROM raster r JOIN sp ON row_off = (prow//8)*8 AND col_off = (pcol//8)*8 WHERE split <> 'excluded'),
    fit AS (SELECT 'train' AS drawn_from, * FROM cells WHERE split = 'train' AND label <> 255 UNION ALL SELECT 'all', * FROM cells WHERE label <> 255),
    drawn AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY drawn_from, label ORDER BY {h}, prow, pcol) <= CASE label WHEN 1 THEN {v} ELSE {o} END)
    SELECT drawn_from, count(*) AS fitted, count(*) FILTER (split <> 'train') AS evaluated_too FROM drawn GROUP BY 1""".format(
        h=hash_sql("prow*3000000019+pcol", 42), v=PIXEL_SAMPLE["n_vacant"], o=PIXEL_SAMPLE["n_other"]
    )
)


@query("fit_overlap_M12", _FIT_SQL, "raster dims")
def _(t: Inputs):
    held = _cells(t).where("split <> 'train' AND label <> 255").select("cell_id", F.lit(1).alias("held"))
    drawn = _fit_sample(t).withColumn("drawn_from", F.lit("train")).unionByName(
        PT.reservoir_pixels(_cells(t), **PIXEL_SAMPLE).withColumn("drawn_from", F.lit("all"))
    )
    return drawn.join(held, "cell_id", "left").groupBy("drawn_from").agg(F.count("*").alias("fitted"), F.count("held").alias("evaluated_too"))


@query("cross_validation_M14")
def _(t: Inputs):
    return ml.cv_summary(ml.cross_validate(_scaled(t), MODELS))


@query("classifier_report_M15")
def _(t: Inputs):
    return ml.evaluate_classifier(ml.held_out_scores(_scaled(t), COLS))["report"]


# A literal model: its scores and its report follow from these numbers alone.
GIVEN_LOGISTIC = ml.LogisticModel(("f0", "f1", "f2"), (1.5, -2.0, 0.75), -0.25)
_GIVEN_SCORES = "(SELECT bbl, y, 1/(1 + exp(-(-0.25 + 1.5*f0 - 2.0*f1 + 0.75*f2))) AS prob FROM emb)"


@query(
    "classifier_report_given_M15",
    f"""WITH c AS (SELECT y, (prob > 0.5)::INT AS p FROM {_GIVEN_SCORES}),
    k AS (SELECT y AS class, count(*) AS support, count(*) FILTER (p = y) AS tp FROM c GROUP BY 1), q AS (SELECT p AS class, count(*) AS called FROM c GROUP BY 1),
    m AS (SELECT class, support, coalesce(tp/nullif(called, 0), 0) AS pr, tp/support AS rc FROM k LEFT JOIN q USING (class)), f AS (SELECT *, coalesce(2*pr*rc/nullif(pr+rc, 0), 0) AS f1 FROM m)
    SELECT class::VARCHAR AS class, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1, support FROM f
    UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(rc), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f
    UNION ALL SELECT 'weighted avg', round(sum(pr*support)/sum(support), 6), round(sum(rc*support)/sum(support), 6), round(sum(f1*support)/sum(support), 6), sum(support)::BIGINT FROM f""",
    "emb",
)
def _(t: Inputs):
    report = ml.evaluate_classifier(GIVEN_LOGISTIC.transform(t.features))["report"]
    return _round(report, ["precision", "recall", "f1"])


# A literal forest of two small trees over pixel features: (feature, threshold, left, right, P(1)).
GIVEN_FOREST = scoring.FlatForest.of(
    ["NDVI", "Brightness", "NIR"],
    [
        [(0, 0.1, 1, 2, 0.0), (1, 0.5, 3, 4, 0.0), (-1, 0.0, 0, 0, 0.15), (-1, 0.0, 0, 0, 0.8), (-1, 0.0, 0, 0, 0.55)],
        [(2, 0.4, 1, 2, 0.0), (-1, 0.0, 0, 0, 0.7), (0, 0.6, 3, 4, 0.0), (-1, 0.0, 0, 0, 0.3), (-1, 0.0, 0, 0, 0.05)],
    ],
)
_GIVEN_FOREST_SQL = """(CASE WHEN "NDVI" <= 0.1 THEN CASE WHEN "Brightness" <= 0.5 THEN 0.8 ELSE 0.55 END ELSE 0.15 END
    + CASE WHEN "NIR" <= 0.4 THEN 0.7 WHEN "NDVI" <= 0.6 THEN 0.3 ELSE 0.05 END)::DOUBLE/2"""


@query(
    "forest_scoring_given_I1",
    f"""SELECT prow, pcol, label, CASE WHEN label = 255 THEN 255 ELSE (prob > 0.5)::INT END AS pred, CASE WHEN label <> 255 THEN round(prob, 6) END AS prob
    FROM (SELECT prow, pcol, label, {_GIVEN_FOREST_SQL} AS prob FROM (SELECT prow, pcol, label, {_FEATURES_SQL} FROM features))""",
    "features",
)
def _(t: Inputs):
    scored = scoring.score_with_forest(_round(feature_stack(t.raster, ["prow", "pcol", "label"]), FEATURES), GIVEN_FOREST)
    return scored.select("prow", "pcol", "label", "pred", F.round("prob", 6).alias("prob"))


@query(
    "forest_scoring_same_I1",
    "SELECT split, 0::BIGINT AS different FROM (SELECT 'val' AS split UNION ALL SELECT 'test')",
)
def _(t: Inputs):
    # The flat forest beside the fitted pipeline it was made from, cell by cell.
    cells = _held_out(t)
    both = _pixel_forest(t).transform(scoring.score_with_forest(cells, _flat_forest(t)).withColumnRenamed("prob", "flat"))
    return both.groupBy("split").agg(F.count_if(F.abs(F.col("flat") - vector_to_array("probability")[1]) > 1e-9).alias("different"))


def _reloaded(t: Inputs):
    """A fitted pipeline, the same after saving and loading, its metadata and the scaled rows.

    The rows are scaled once and stored: sums of doubles follow the order in which tasks end,
    so a second scaling may differ in its last digits.
    """
    path = scratch_path(t.spark, "model")
    rows = cut_lineage(_scaled(t), "scaled-rows")
    fitted = ml.logistic(COLS, reg=0.01, max_iter=50).fit(ml.balanced_weights(rows))
    ml.save_model(t.spark, fitted, path, {"features": COLS, "threshold": 0.5})
    return (fitted, *ml.load_model(t.spark, path), rows)


@query("model_round_trip_same_M16", "SELECT bbl, true AS same FROM emb", "emb")
def _(t: Inputs):
    fitted, model, _, rows = _reloaded(t)
    before = ml.positive_score(fitted.transform(rows)).select("bbl", "prob")
    after = ml.positive_score(model.transform(rows)).select("bbl", F.col("prob").alias("again"))
    return before.join(after, "bbl").select("bbl", (F.col("prob") == F.col("again")).alias("same"))


@query("model_round_trip_M16")
def _(t: Inputs):
    _, model, metadata, rows = _reloaded(t)
    return ml.positive_score(model.transform(rows)).select(
        "bbl", F.round("prob", 6).alias("prob"), (F.col("prob") > metadata["threshold"]).alias("is_vacant")
    )


@query("feature_importance_M17")
def _(t: Inputs):
    return ml.feature_importances(t.spark, _pixel_forest(t), FEATURES)


@query("model_scoring_I1")
def _(t: Inputs):
    scored = scoring.score_with_forest(_held_out(t), _flat_forest(t))
    return scored.select("prow", "pcol", "split", "label", "pred", F.round("prob", 6).alias("prob"))


@query("model_evaluation_E2")
def _(t: Inputs):
    return E.evaluate_model(_held_out(t), _flat_forest(t), by=["split"])
