"""Clustering and classification of parcel and pixel tables on ``pyspark.ml``."""

from __future__ import annotations

import json
from collections.abc import Callable, Generator, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from lotgrid.functions.hashing import hash32
from lotgrid.operators import evaluation as E
from lotgrid.operators.forest import forest_scores
from lotgrid.operators.impute import Imputer, Scaler, fit_imputer, fit_scaler
from lotgrid.operators.parcels import stratified_folds
from lotgrid.operators.summary import mean_and_spread, union_all
from lotgrid.session import cut_lineage


@contextmanager
def kept(df: DataFrame):
    """Hold a training table for repeated passes; it spills to disk and is rebuilt if an executor is lost."""
    stored = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield stored
    finally:
        stored.unpersist()


def assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.array(*[F.col(f).cast("double") for f in features])))


# ---------------------------------------------------------------- clustering


MAX_STEPS = 20  # of Lloyd's iteration, fewer where no centre moves


@dataclass(frozen=True)
class Centres:
    """Fitted k-means centres, (cluster, feature), and the sum of squared distances of the training rows."""

    values: np.ndarray
    inertia: float
    column: str = "features"

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802 - the name that fitted models of Spark have
        return list(self.values)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``cluster``, the nearest centre; the lower number on ties."""
        centres = self.values

        @F.arrow_udf("int")
        def nearest(rows: pa.Array) -> pa.Array:
            return pa.array(_distances(_points(rows), centres).argmin(axis=1).astype("i4"))

        return df.withColumn("cluster", nearest(vector_to_array(self.column)))


def _points(column: pa.Array) -> np.ndarray:
    """Rows of an ``array<double>`` column as (row, feature)."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (row, centre)."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2.0 * x @ centres.T + (centres * centres).sum(axis=1), 0.0)


def _starts(points: DataFrame, ks: list[int], restarts: int, seed: int, key: str | None) -> dict[tuple[int, int], np.ndarray]:
    """Start centres of every (k, restart): the first k rows in a seeded hash order, one order per restart.

    Only ``restarts * max(ks)`` rows come to the driver.
    """
    most = max(ks)
    number = F.col(key) if key else F.xxhash64("x")
    order = points.withColumn("_key", number)
    tops = [order.select(F.lit(r).alias("r"), hash32(F.col("_key"), seed + r).alias("h"), "_key", "x").orderBy("h", "_key", "x").limit(most) for r in range(restarts)]
    rows: dict[int, list] = {}
    for row in union_all(tops).collect():
        rows.setdefault(row["r"], []).append((row["h"], row["_key"], row["x"]))
    if not rows:
        raise ValueError("no rows to cluster")
    ordered = {r: np.array([x for _, _, x in sorted(v)]) for r, v in rows.items()}
    return {(k, r): x[:k] for r, x in ordered.items() for k in ks}


def _lloyd_pass(points: DataFrame, models: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], dict[str, np.ndarray]]:
    """One reading of the rows for all models: per cluster the rows, their sum and squares, and the distances to the centre.

    Every task adds up its own rows first; what reaches the driver is one row per cluster
    and feature.
    """
    keys = list(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            x = _points(batch.column("x"))
            for m, key in enumerate(keys):
                centres = models[key]
                at = _distances(x, centres).argmin(axis=1)
                member = np.zeros((len(centres), len(x)))
                member[at, np.arange(len(x))] = 1.0
                cost = ((x - centres[at]) ** 2).sum(axis=1)
                own = [member.sum(axis=1), member @ x, member @ (x * x).sum(axis=1), member @ cost]
                total[m] = [a + b for a, b in zip(total[m], own, strict=True)] if m in total else own
        for m, (n, sums, squares, cost) in total.items():
            k, p = sums.shape
            # Per cluster: count, squares, distances, then the sums of the features.
            flat = np.concatenate([np.stack([n, squares, cost], axis=1), sums], axis=1).reshape(-1)
            index = np.arange(k * (p + 3))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), m), pa.int32()), pa.array(index, pa.int32()), pa.array(flat, pa.float64())], ["m", "i", "v"])

    found = points.select("x").mapInArrow(run, "m int, i int, v double").groupBy("m", "i").agg(F.sum("v").alias("v"))
    merged = found.groupBy("m").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c"))
    out = {}
    for row in merged.collect():
        centres = models[keys[row["m"]]]
        table = np.array([c["v"] for c in row["c"]]).reshape(len(centres), -1)
        out[keys[row["m"]]] = {"n": table[:, 0], "squares": table[:, 1], "cost": table[:, 2], "sums": table[:, 3:]}
    return out


def fit_many_kmeans(
    df: DataFrame, ks, *, restarts: int = 10, seed: int = 42, features: str = "features", key: str | None = None, steps: int = MAX_STEPS
) -> tuple[dict[int, Centres], dict[int, dict]]:
    """k-means for every k, the lowest cost of ``restarts`` each, all fitted together.

    One reading of the rows per step assigns each row under all (k, restart) centre sets at
    once, so the number of jobs is that of the steps.  Start rows are the first of a seeded
    hash order of ``key`` (of the features without one); a cluster that loses all rows keeps
    its centre; the first restart wins equal costs.  With fewer rows than k there are as
    many clusters.  Also returns the clusters' sums for every k.
    """
    ks = [int(k) for k in ks]
    points = cut_lineage(df.select(vector_to_array(features).alias("x"), *([key] if key else [])), "cluster-points")
    models = _starts(points, ks, restarts, seed, key)
    moving = dict(models)
    for _ in range(steps):
        after = {}
        for m, s in _lloyd_pass(points, moving).items():
            n = s["n"][:, None]
            after[m] = np.where(n > 0, s["sums"] / np.maximum(n, 1.0), models[m])
        moving = {m: c for m, c in after.items() if not np.array_equal(c, models[m])}
        models.update(after)
        if not moving:
            break
    last = _lloyd_pass(points, models)
    best = {k: min((r for kk, r in models if kk == k), key=lambda r: (round(float(last[k, r]["cost"].sum()), 9), r)) for k in ks}
    fitted = {k: Centres(models[k, r], float(last[k, r]["cost"].sum()), features) for k, r in best.items()}
    return fitted, {k: last[k, r] for k, r in best.items()}


def fit_kmeans(df: DataFrame, k: int, *, restarts: int = 10, seed: int = 42, features: str = "features", key: str | None = None) -> Centres:
    """Lowest-cost of ``restarts`` k-means fits."""
    return fit_many_kmeans(df, [k], restarts=restarts, seed=seed, features=features, key=key)[0][k]


def silhouettes(df: DataFrame, fitted: dict[int, Centres], sums: dict[int, dict], *, features: str = "features") -> dict[int, float]:
    """Mean silhouette of every clustering in one reading, with squared Euclidean distances.

    The mean distance of a row to a cluster follows from the cluster's count, sum and
    squares; a row alone in its cluster has 0.
    """
    points = df.select(vector_to_array(features).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _points(batch.column("x"))
            for k, model in fitted.items():
                s, rows = sums[k], np.arange(len(x))
                at = _distances(x, model.values).argmin(axis=1)
                n = np.maximum(s["n"], 1.0)
                mean = (x * x).sum(axis=1)[:, None] + s["squares"] / n - 2.0 * x @ (s["sums"] / n[:, None]).T
                mean = np.where(s["n"] > 0, mean, np.inf)
                own_n = s["n"][at]
                a = mean[rows, at] * own_n / np.maximum(own_n - 1.0, 1.0)
                mean[rows, at] = np.inf
                b = mean.min(axis=1)
                most = np.maximum(a, b)
                value = np.where((own_n > 1) & np.isfinite(b) & (most > 0), (b - a) / np.where(most > 0, most, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([float(value.sum())]), pa.array([len(x)], pa.int64())], ["k", "s", "n"])

    found = points.mapInArrow(run, "k int, s double, n long").groupBy("k").agg((F.sum("s") / F.sum("n")).alias("v"))
    return {r["k"]: r["v"] for r in found.collect()}


@dataclass(frozen=True)
class Projection:
    """Principal components of centred data; each component's largest loading is positive."""

    model: PCAModel
    signs: tuple[float, ...]

    @property
    def variance(self) -> list[float]:
        return [float(v) for v in self.model.explainedVariance]

    @property
    def components(self) -> np.ndarray:
        """(features, components)."""
        return self.model.pc.toArray() * np.array(self.signs)

    def apply(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        values = vector_to_array("_pca")
        return self.model.transform(df).withColumns(
            {f"{prefix}{i + 1}": F.get(values, F.lit(i)) * F.lit(float(s)) for i, s in enumerate(self.signs)}
        ).drop("_pca")


def fit_pca(df: DataFrame, components: int, *, features: str = "features") -> Projection:
    """``df[features]`` must be centred (see ``fit_scaler``): Spark's PCA does not centre what it projects."""
    model = PCA(k=components, inputCol=features, outputCol="_pca").fit(df)
    loadings = model.pc.toArray()
    top = np.abs(loadings).argmax(axis=0)
    return Projection(model, tuple(float(np.sign(loadings[t, i]) or 1.0) for i, t in enumerate(top)))


def pca_residuals(df: DataFrame, projection: Projection, *, features: str = "features") -> DataFrame:
    """(component, residual, norm, total_variance): how well ``C v = lambda v`` holds, with the covariance of one aggregate.

    Driver rows: one per component.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([_points(batch.column("x")), np.ones((batch.num_rows, 1))], axis=1)
            flat = (x.T @ x).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["i", "v"])

    sums = df.select(vector_to_array(features).alias("x")).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.array([r["v"] for r in sums.orderBy("i").collect()])
    size = int(round(len(flat) ** 0.5))
    table = flat.reshape(size, size)
    n = table[-1, -1]
    mean = table[:-1, -1] / n
    covariance = table[:-1, :-1] / n - np.outer(mean, mean)
    rows = []
    for j, v in enumerate(projection.components.T):
        image = covariance @ v
        rows.append((j + 1, float(np.abs(image - (v @ image) * v).max()), float(v @ v), float(np.trace(covariance))))
    return df.sparkSession.createDataFrame(rows, "component int, residual double, norm double, total_variance double")


@dataclass(frozen=True)
class ClusterModel:
    """Imputer, scaler, k-means and optional projection, all fitted on the training table."""

    features: tuple[str, ...]
    imputer: Imputer
    scaler: Scaler
    kmeans: Centres
    projection: Projection | None

    def prepare(self, df: DataFrame) -> DataFrame:
        return assemble(self.scaler.apply(self.imputer.apply(df)), self.features)

    def assign(self, df: DataFrame) -> DataFrame:
        """Cluster (and component) columns added; missing values get the training fill values."""
        keep = df.withColumns({f"_raw_{f}": F.col(f) for f in self.features})
        out = self.kmeans.transform(self.prepare(keep))
        if self.projection is not None:
            out = self.projection.apply(out)
        return out.withColumns({f: F.col(f"_raw_{f}") for f in self.features}).drop("features", *[f"_raw_{f}" for f in self.features])


def fit_clusters(
    df: DataFrame, features, k: int, *, method: str = "median", restarts: int = 10, components: int | None = 2, seed: int = 42, key: str | None = None
) -> ClusterModel:
    features = tuple(features)
    imputer = fit_imputer(df, features, method)
    filled = imputer.apply(df)
    scaler = fit_scaler(filled, features)
    with kept(assemble(scaler.apply(filled), features).select("features", *([key] if key else []))) as train:
        kmeans = fit_kmeans(train, k, restarts=restarts, seed=seed, key=key)
        projection = fit_pca(train, components) if components else None
    return ClusterModel(features, imputer, scaler, kmeans, projection)


def sweep_clusters(df: DataFrame, ks=range(2, 11), *, restarts: int = 10, seed: int = 42, key: str | None = None) -> DataFrame:
    """(k, inertia, silhouette) per k; silhouette uses squared Euclidean distance.

    All k and restarts are fitted together.  Driver rows: one per k.
    """
    fitted, sums = fit_many_kmeans(df, ks, restarts=restarts, seed=seed, key=key)
    scores = silhouettes(df, fitted, sums)
    rows = [(k, m.inertia, float(scores[k])) for k, m in fitted.items()]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def centroid_table(spark: SparkSession, model: ClusterModel) -> DataFrame:
    """(cluster, feature, scaled, original) centroids: k x features rows."""
    rows = [
        (c, f, float(centre[i]), float(centre[i] * (model.scaler.std[f] or 1.0) + model.scaler.mean[f]))
        for c, centre in enumerate(model.kmeans.clusterCenters())
        for i, f in enumerate(model.features)
    ]
    return spark.createDataFrame(rows, "cluster int, feature string, scaled double, original double")


def cluster_feature_importance(centroids: DataFrame) -> DataFrame:
    """Population std of the scaled centroids per feature, largest first."""
    return centroids.groupBy("feature").agg(F.stddev_pop("scaled").alias("importance")).orderBy(F.desc("importance"), "feature")


def loading_table(spark: SparkSession, projection: Projection, features) -> DataFrame:
    """(component, feature, loading, variance_pct): components x features rows."""
    loadings = projection.components
    rows = [
        (j + 1, f, float(loadings[i, j]), 100.0 * projection.variance[j])
        for j in range(loadings.shape[1])
        for i, f in enumerate(features)
    ]
    return spark.createDataFrame(rows, "component int, feature string, loading double, variance_pct double")


# ---------------------------------------------------------------- classifiers


def balanced_weights(df: DataFrame, label: str = "y", out: str = "weight") -> DataFrame:
    """Add n / (2 * class size)."""
    v = F.col(label)
    n = df.agg(F.struct(F.count("*").alias("n"), F.count_if(v == 1).alias("pos"), F.count_if(v == 0).alias("neg"))).scalar()
    size = F.when(v == 1, n["pos"]).otherwise(n["neg"])
    return df.withColumn(out, n["n"] / (2.0 * size))


def class_weight_column(df: DataFrame, weights: dict[int, float], label: str = "y", out: str = "weight") -> DataFrame:
    """Add seen/kept weights of the pixel sample."""
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(weights[1]))).otherwise(F.lit(float(weights[0]))))


def _common(label: str, weight: str | None) -> dict:
    return {"featuresCol": "features", "labelCol": label, **({"weightCol": weight} if weight else {})}


def logistic(features, *, label: str = "y", weight: str | None = "weight", max_iter: int = 1000, reg: float = 0.0) -> Pipeline:
    lr = LogisticRegression(maxIter=max_iter, regParam=reg, **_common(label, weight))
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), lr])


NEWTON_STEPS = 50
INVERSE_PENALTY = 1.0  # C: the penalty is |w|^2 / (2 C) beside the weighted sum of losses


@dataclass(frozen=True)
class LogisticModel:
    """Coefficients and intercept of a fitted logistic regression."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prob`` and ``prediction``."""
        margin = F.lit(float(self.intercept))
        for f, w in zip(self.features, self.coefficients, strict=True):
            margin = margin + F.col(f) * F.lit(float(w))
        prob = 1.0 / (1.0 + F.exp(-margin))
        return df.withColumn("prob", prob).withColumn("prediction", (F.col("prob") > 0.5).cast("int"))


def _newton_pass(rows: DataFrame, betas: dict[int, np.ndarray], weights: dict[int, tuple[float, float]]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and Hessian of every model in one reading; model f leaves fold f out."""
    size = len(next(iter(betas.values())))
    at = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {f: np.zeros(1 + size + len(at[0])) for f in betas}
        for batch in batches:
            x = np.concatenate([_points(batch.column("x")), np.ones((batch.num_rows, 1))], axis=1)
            y, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold"))
            for f, beta in betas.items():
                mine = fold != f
                z, t = x[mine], y[mine]
                w = np.where(t == 1, weights[f][1], weights[f][0])
                margin = z @ beta
                p = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
                loss = (w * (np.logaddexp(0.0, margin) - t * margin)).sum()
                hessian = (z * (w * p * (1.0 - p))[:, None]).T @ z
                total[f] += np.concatenate([[loss], z.T @ (w * (p - t)), hessian[at]])
        for f, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), f), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], ["f", "i", "v"])

    sums = rows.select("x", "y", "fold").mapInArrow(run, "f int, i int, v double").groupBy("f", "i").agg(F.sum("v").alias("v"))
    out = {}
    for r in sums.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c")).collect():
        v = np.array([c["v"] for c in r["c"]])
        hessian = np.zeros((size, size))
        hessian[at] = v[1 + size :]
        out[r["f"]] = (float(v[0]), v[1 : 1 + size], hessian + np.triu(hessian, 1).T)
    return out


def fit_logistic_folds(df: DataFrame, features, *, label: str = "y", fold: str | None = None, c: float = INVERSE_PENALTY, steps: int = NEWTON_STEPS) -> dict[int, LogisticModel]:
    """Balanced logistic regressions, one that leaves out each fold and, as -1, one of all rows.

    Every step reads the rows once for all models and adds up their gradients and Hessians;
    the driver solves one small system per model.  A step that would raise a model's loss is
    halved.  Rows with a null label or feature take no part; a fold without both labels
    beside it has no model.
    """
    features = tuple(features)
    known = F.col(label).isin(0, 1)
    for f in features:
        known = known & F.col(f).isNotNull()
    number = F.col(fold).cast("int") if fold else F.lit(0)
    rows_ = df.where(known).select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col(label).cast("double").alias("y"), number.alias("fold"))
    rows = cut_lineage(rows_, "logistic-rows")
    sizes = {(r["fold"], int(r["y"])): r["n"] for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    folds = sorted({f for f, _ in sizes}) if fold else []
    weights = {}
    for f in [-1, *folds]:
        n = [sum(v for (g, y), v in sizes.items() if g != f and y == t) for t in (0, 1)]
        if all(n):
            weights[f] = (sum(n) / (2.0 * n[0]), sum(n) / (2.0 * n[1]))
    penalty = np.append(np.full(len(features), 1.0 / c), 0.0)
    best = {f: np.zeros(len(features) + 1) for f in weights}
    trial, known_at, scale = dict(best), {}, {f: 1.0 for f in best}
    for _ in range(steps):
        if not trial:
            break
        for f, (loss, gradient, hessian) in _newton_pass(rows, trial, weights).items():
            beta = trial[f]
            loss += 0.5 * float((penalty * beta * beta).sum())
            if f in known_at and loss > known_at[f][0] + 1e-12 * abs(known_at[f][0]):
                scale[f] /= 2.0
            else:
                step = np.linalg.solve(hessian + np.diag(penalty) + 1e-12 * np.eye(len(beta)), gradient + penalty * beta)
                best[f], known_at[f], scale[f] = beta, (loss, step), 1.0
            if np.abs(scale[f] * known_at[f][1]).max() < 1e-9:
                del trial[f]
            else:
                trial[f] = best[f] - scale[f] * known_at[f][1]
    return {f: LogisticModel(features, tuple(b[:-1].tolist()), float(b[-1])) for f, b in best.items()}


def forest(
    features, *, label: str = "y", weight: str | None = "weight", trees: int = 200, depth: int = 20, min_leaf: int = 50, seed: int = 42
) -> Pipeline:
    """Random forest; the defaults are the pixel model, ``min_leaf=1`` gives the parcel one."""
    rf = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed, **_common(label, weight))
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), rf])


@dataclass(frozen=True)
class SharedForest:
    """A random forest with the settings of ``make()``, grown and scored in tasks; see ``operators.forest``."""

    make: Callable[[], Pipeline]

    def __call__(self, df: DataFrame, *, label: str = "y", key: str = "bbl", fold: str | None = None) -> DataFrame:
        assembler, rf = self.make().getStages()
        settings = {"trees": rf.getNumTrees(), "depth": rf.getMaxDepth(), "min_leaf": rf.getMinInstancesPerNode(), "seed": rf.getSeed()}
        return forest_scores(df, assembler.getInputCols(), label=label, key=key, fold=fold, **settings)


def boosting(
    features, *, label: str = "y", weight: str | None = "weight", rounds: int = 500, depth: int = 12, rate: float = 0.05, min_leaf: int = 50, seed: int = 42
) -> Pipeline:
    """Gradient-boosted trees, grown level by level (Spark has no leaf-wise growth)."""
    gbt = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, minInstancesPerNode=min_leaf, seed=seed, **_common(label, weight))
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), gbt])


def _waves(width: int, gamma: float | None, size: int, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """The random Fourier features of rows of ``width`` values."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2.0 * (gamma or 1.0 / width)), (size, width))
    b = rng.uniform(0.0, 2.0 * np.pi, size)
    scale = float(np.sqrt(2.0 / size))
    return lambda x: scale * np.cos(x @ w.T + b)


def fourier_features(df: DataFrame, features, *, gamma: float | None = None, size: int = 128, seed: int = 42, prefix: str = "rff") -> tuple[DataFrame, list[str]]:
    """Random Fourier features of the RBF kernel, one product of matrices per Arrow batch; gamma defaults to 1/features."""
    features = list(features)
    made = _waves(len(features), gamma, size, seed)

    @F.arrow_udf("array<double>")
    def waves(rows: pa.Array) -> pa.Array:
        values = made(_points(rows))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * size, pa.int32()), pa.array(values.reshape(-1)))

    point = F.array(*[F.col(f).cast("double") for f in features])
    return df.withColumn("features", array_to_vector(waves(point))), [f"{prefix}{i}" for i in range(size)]


@dataclass(frozen=True)
class KernelClassifier:
    """RBF-kernel classifier: Fourier features, a linear SVM, and a logistic map of its margin."""

    features: tuple[str, ...]
    svm: object
    calibration: object
    size: int
    seed: int

    def _margin(self, df: DataFrame) -> DataFrame:
        mapped, _ = fourier_features(df, self.features, size=self.size, seed=self.seed)
        out = self.svm.transform(mapped)
        margin = vector_to_array("rawPrediction")[1]
        return out.withColumn("_margin", array_to_vector(F.array(margin))).drop("features", "rawPrediction", "prediction")

    def transform(self, df: DataFrame) -> DataFrame:
        return self.calibration.transform(self._margin(df)).drop("_margin")


def fit_kernel_svm(df: DataFrame, features, *, label: str = "y", weight: str = "weight", size: int = 128, max_iter: int = 100, seed: int = 42) -> KernelClassifier:
    features = tuple(features)
    mapped, _ = fourier_features(df, features, size=size, seed=seed)
    with kept(mapped) as train:
        svm = LinearSVC(maxIter=max_iter, regParam=SVM_PENALTY, **_common(label, weight)).fit(train)
        raw = svm.transform(train).withColumn("_margin", array_to_vector(F.array(vector_to_array("rawPrediction")[1])))
        calibration = LogisticRegression(featuresCol="_margin", labelCol=label, maxIter=100).fit(
            raw.select("_margin", label)
        )
    return KernelClassifier(features, svm, calibration, size, seed)


SVM_PENALTY = 0.001  # beside the mean weighted hinge loss, on standardised features
# The hinge's corner is rounded to width * log(1 + exp(u / width)); each search starts where the wider one ended.
HINGE_WIDTHS = (0.5, 0.15, 0.05, 0.015)
LEAST_GAIN = 1e-5  # of the loss, below which a search ends


def _newton_search(penalty: np.ndarray, widths: tuple[float, ...], steps: int) -> Generator[tuple[np.ndarray, float], tuple, np.ndarray]:
    """Newton's method as questions ``(point, width)`` answered by loss, gradient and Hessian; a step that would raise the loss is halved."""
    best, left = np.zeros(len(penalty)), steps
    for width in widths:
        trial, known, scale = best, None, 1.0
        while left:
            left -= 1
            loss, gradient, hessian = yield trial, width
            loss += 0.5 * float((penalty * trial * trial).sum())
            gain = np.inf if known is None else known[0] - loss
            if gain < 0:
                scale /= 2.0
            else:
                step = np.linalg.solve(hessian + np.diag(penalty) + 1e-9 * np.eye(len(trial)), gradient + penalty * trial)
                best, known, scale = trial, (loss, step), 1.0
            if 0 <= gain < LEAST_GAIN * max(loss, LEAST_GAIN) or scale < 1e-6:
                break
            trial = best - scale * known[1]
    return best


def _summed(rows: DataFrame, models: list[int], sums: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """``sums(f, x, y)`` added up over the rows of ``rows(x, y, fold)`` outside fold f, for all models in one reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {f: 0.0 for f in models}
        for batch in batches:
            x = _points(batch.column("x"))
            y, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold"))
            for f in models:
                mine = fold != f
                if mine.any():
                    total[f] = total[f] + sums(f, x[mine], y[mine])
        for f, v in total.items():
            if np.ndim(v):
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["f", "v"])

    def add(part: pa.Table) -> pa.Table:
        v = sum(np.frombuffer(b.as_py(), "f8") for b in part["v"])
        return pa.table({"f": part["f"].slice(0, 1), "v": pa.array([v.tobytes()], pa.binary())})

    found = rows.select("x", "y", "fold").mapInArrow(run, "f int, v binary").groupBy("f").applyInArrow(add, "f int, v binary").collect()
    return {r["f"]: np.frombuffer(r["v"], "f8") for r in found}


def _search_together(rows: DataFrame, searches: dict[int, Generator], measure: Callable) -> dict[int, np.ndarray]:
    """The points at which the models' searches end; every reading of the rows answers one question of each.

    ``measure(f, x, y, point, width)`` gives a matrix of features, and per row the loss and its first two derivatives by the margin.
    """
    asked, ended = {f: next(s) for f, s in searches.items()}, {}
    while asked:
        size = len(next(iter(asked.values()))[0])

        def sums(f: int, x: np.ndarray, y: np.ndarray, asked=dict(asked)) -> np.ndarray:
            z, loss, slope, bend = measure(f, x, y, *asked[f])
            own = np.flatnonzero(bend > 1e-9 * bend.max())
            return np.concatenate([[loss.sum()], z.T @ slope, ((z[own] * bend[own, None]).T @ z[own]).reshape(-1)])

        for f, v in _summed(rows, sorted(asked), sums).items():
            try:
                asked[f] = searches[f].send((float(v[0]), v[1 : 1 + size], v[1 + size :].reshape(size, size)))
            except StopIteration as end:
                ended[f] = end.value
                del asked[f]
    return ended


def kernel_fold_scores(folded: DataFrame, features, *, label: str = "y", fold: str = "fold", size: int = 128, max_iter: int = 100, seed: int = 42) -> DataFrame:
    """``folded`` with ``prob`` and ``prediction`` of the kernel machine of the other folds.

    The machine of ``fit_kernel_svm`` with balanced weights: the same Fourier features,
    hinge loss, penalty and logistic map of the margin.  All folds are fitted together: a
    step reads the rows once for all of them, and the driver solves one small system per
    fold.  Rows with a null label or feature teach nothing, and have no score without a
    feature; a fold without both labels beside it has none either.
    """
    features = tuple(features)
    made = _waves(len(features), None, size, seed)
    known = F.col(label).isin(0, 1)
    for f in features:
        known = known & F.col(f).isNotNull()
    point = F.array(*[F.col(f).cast("double") for f in features])
    rows = cut_lineage(folded.where(known).select(point.alias("x"), F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold")), "kernel-rows")
    sizes = {(r["fold"], int(r["y"])): r["n"] for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    counts = {f: tuple(sum(n for (g, y), n in sizes.items() if g != f and y == t) for t in (0, 1)) for f in sorted({f for f, _ in sizes})}
    counts = {f: n for f, n in counts.items() if all(n)}
    # Weights are n / (2 * class size), so that they add up to n; losses are divided by that.
    weight = {f: (0.5 / n[0], 0.5 / n[1]) for f, n in counts.items()}

    def weights(f: int, y: np.ndarray) -> np.ndarray:
        return np.where(y == 1, weight[f][1], weight[f][0])

    def moments(f: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z, w = made(x), weights(f, y)
        return np.concatenate([w @ z, w @ (z * z), [(w * w).sum()]])

    def hinge(f: int, x: np.ndarray, y: np.ndarray, at: np.ndarray, width: float) -> tuple[np.ndarray, ...]:
        z = np.concatenate([made(x), np.ones((len(x), 1))], axis=1)
        sign, w = 2.0 * y - 1.0, weights(f, y)
        u = 1.0 - sign * (z @ at)
        p = 1.0 / (1.0 + np.exp(-np.clip(u / width, -700, 700)))
        return z, w * width * np.logaddexp(0.0, u / width), -w * sign * p, w * p * (1.0 - p) / width

    penalty = {}
    for f, v in _summed(rows, sorted(counts), moments).items():
        variance = np.maximum(v[size : 2 * size] - v[:size] ** 2, 0.0) / (1.0 - v[-1])
        penalty[f] = np.append(SVM_PENALTY * variance, 0.0)
    machines = _search_together(rows, {f: _newton_search(p, HINGE_WIDTHS, max_iter) for f, p in penalty.items()}, hinge)

    def margin(f: int, x: np.ndarray) -> np.ndarray:
        return made(x) @ machines[f][:-1] + machines[f][-1]

    def logistic_loss(f: int, x: np.ndarray, y: np.ndarray, at: np.ndarray, width: float) -> tuple[np.ndarray, ...]:
        z = np.stack([margin(f, x), np.ones(len(x))], axis=1)
        m, w = z @ at, 1.0 / sum(counts[f])
        p = 1.0 / (1.0 + np.exp(-np.clip(m, -700, 700)))
        return z, w * (np.logaddexp(0.0, m) - y * m), w * (p - y), w * p * (1.0 - p)

    maps = _search_together(rows, {f: _newton_search(np.zeros(2), (1.0,), 100) for f in machines}, logistic_loss)

    @F.arrow_udf("double")
    def scores(points: pa.Array, fold_of: pa.Array) -> pa.Array:
        x, own = _points(points), fold_of.to_numpy(zero_copy_only=False)
        out = np.full(len(x), np.nan)
        for f, (slope, offset) in maps.items():
            mine = own == f
            out[mine] = 1.0 / (1.0 + np.exp(-np.clip(slope * margin(f, x[mine]) + offset, -700, 700)))
        return pa.array(out, mask=np.isnan(out))

    scored = folded.withColumn("prob", scores(point, F.col(fold).cast("int")))
    return scored.withColumn("prediction", (F.col("prob") > 0.5).cast("int"))


@dataclass(frozen=True)
class SharedKernel:
    """A kernel machine of all the defaults; the folds of a cross-validation are fitted together."""

    features: tuple[str, ...]

    def __call__(self, train: DataFrame) -> KernelClassifier:
        return fit_kernel_svm(train, self.features)


def positive_score(scored: DataFrame) -> DataFrame:
    """Add ``prob``: P(1), else the decision value, else the prediction."""
    if "prob" in scored.columns:
        return scored
    if "probability" in scored.columns:
        return scored.withColumn("prob", vector_to_array("probability")[1])
    if "rawPrediction" in scored.columns:
        return scored.withColumn("prob", vector_to_array("rawPrediction")[1])
    return scored.withColumn("prob", F.col("prediction").cast("double"))


def evaluate_classifier(scored: DataFrame, *, label: str = "y") -> dict[str, DataFrame]:
    """F1 and AP, PR curve and per-class report of a transformed table."""
    df = positive_score(scored).select(F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("p"), "prob")
    counts = E.with_metrics(E.confusion_counts(df, F.col("y"), F.col("p")))
    ap = E.average_precision(df)
    return {
        "metrics": counts.select("f1", "precision", "recall").withColumn("average_precision", ap.scalar()),
        "pr_curve": E.pr_points(df),
        "report": E.class_report(df, "y", "p"),
    }


def cross_validate(df: DataFrame, models: dict, *, label: str = "y", key: str = "bbl", folds: int = 5, seed: int = 42) -> DataFrame:
    """(model, fold, f1, average_precision) over stratified folds.

    ``models`` maps a name to a function from a weighted training table to a fitted model
    with ``transform``, to a ``SharedForest``, to a ``SharedKernel`` or to the tuple of
    features of a logistic regression; the folds of these three are fitted together.
    """
    folded = cut_lineage(stratified_folds(df, label, key, folds, seed), "folds")
    scored = []

    def held_out(name: str, fold: int, model) -> None:
        add(name, positive_score(model.transform(folded.where(F.col("fold") == fold))))

    def add(name: str, out: DataFrame) -> None:
        scored.append(
            out.select(F.lit(name).alias("model"), "fold", F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("p"), "prob")
        )

    for name, fit in models.items():
        if isinstance(fit, tuple):
            for fold, model in fit_logistic_folds(folded, fit, label=label, fold="fold").items():
                if fold >= 0:
                    held_out(name, fold, model)
            continue
        if isinstance(fit, SharedForest):
            add(name, fit(folded, label=label, key=key, fold="fold"))
            continue
        if isinstance(fit, SharedKernel):
            add(name, kernel_fold_scores(folded, fit.features, label=label))
            continue
        for fold in range(folds):
            held_out(name, fold, fit(balanced_weights(folded.where(F.col("fold") != fold), label)))
    # All folds of all models are measured together, in one aggregate and one ordering.
    rows = cut_lineage(union_all(scored), "fold-scores")
    by = ["model", "fold"]
    counts = E.with_metrics(E.confusion_counts(rows, F.col("y"), F.col("p"), by=by)).select(*by, "f1")
    return counts.join(E.average_precision(rows, by=by), by, "left")


def held_out_scores(df: DataFrame, features, *, label: str = "y", key: str = "bbl", folds: int = 5, seed: int = 42) -> DataFrame:
    """Every row of ``df`` with ``fold``, ``prob`` and ``prediction`` of the logistic model that was fitted without its fold."""
    folded = cut_lineage(stratified_folds(df, label, key, folds, seed), "folds")
    models = fit_logistic_folds(folded, features, label=label, fold="fold")
    return union_all([m.transform(folded.where(F.col("fold") == f)) for f, m in models.items() if f >= 0])


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population std per (model, metric)."""
    long = folds.unpivot(["model", "fold"], ["f1", "average_precision"], "metric", "value")
    return mean_and_spread(long, ["model", "metric"], "value")


def feature_importances(spark: SparkSession, model, features) -> DataFrame:
    """Importances of a tree model, normalised to 1, largest first."""
    stage = model.stages[-1] if isinstance(model, PipelineModel) else model
    values = stage.featureImportances.toArray()
    total = values.sum() or 1.0
    rows = [(f, float(v / total)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save_model(spark: SparkSession, model: PipelineModel, path: str, metadata: dict | None = None) -> None:
    """The fitted pipeline and its metadata side by side."""
    model.write().overwrite().save(f"{path}/model")
    record = spark.createDataFrame([(json.dumps(metadata or {}, sort_keys=True),)], "metadata string")
    record.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    record = spark.read.schema("metadata string").json(f"{path}/metadata").first()
    return PipelineModel.load(f"{path}/model"), json.loads(record["metadata"])
