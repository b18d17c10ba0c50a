"""Random forests whose trees are grown by Spark's tasks and never stand whole on the driver.

Rows are binned once.  Nodes with more than ``GROUP_ROWS`` rows are split by histograms that
all tasks add up, level by level; the rows of every smaller node then meet in one group,
which grows the rest of that tree and scores its rows.  What reaches the driver is one row
per large node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotgrid.session import cut_lineage

BINS = 32
GROUP_ROWS = 200_000
NODES_AT_ONCE = 2048
# A bootstrap draws a row 0, 1, 2 ... times: limits of Poisson's distribution with mean 1.
_DRAWS = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880], "f8"))


def _draws(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree; follows from its key."""
    with np.errstate(over="ignore"):
        z = key.astype("u8") + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return np.searchsorted(_DRAWS, (z >> np.uint64(11)) / float(1 << 53), side="right")


def _best_splits(n: np.ndarray, pos: np.ndarray, weights: tuple[float, float], min_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Per node the flat (feature, bin) of the lowest weighted Gini impurity, -1 where none lowers it, and the left child's (rows, ones).

    ``n`` and ``pos`` are (node, feature, bin) counts of rows and of ones.
    """
    left, ones = n.cumsum(axis=2), pos.cumsum(axis=2)
    all_n, all_pos = left[:, :1, -1:], ones[:, :1, -1:]

    def impurity(rows: np.ndarray, ones: np.ndarray) -> np.ndarray:
        a, b = (rows - ones) * weights[0], ones * weights[1]
        return a * b / np.maximum(a + b, 1e-300)

    whole = impurity(all_n, all_pos)
    left, ones = left[..., :-1], ones[..., :-1]
    cost = impurity(left, ones) + impurity(all_n - left, all_pos - ones)
    cost = np.where((left >= min_leaf) & (all_n - left >= min_leaf), cost, np.inf).reshape(len(n), -1)
    at = cost.argmin(axis=1)
    rows = np.arange(len(n))
    child = np.stack([left.reshape(len(n), -1)[rows, at], ones.reshape(len(n), -1)[rows, at]], axis=1)
    lowers = cost[rows, at] < whole.reshape(-1) * (1.0 - 1e-12)
    return np.where(lowers, at, -1), child


def _share(n: np.ndarray, pos: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    a, b = (n - pos) * weights[0], pos * weights[1]
    return b / np.maximum(a + b, 1e-300)


def grow_and_score(x: np.ndarray, y: np.ndarray, drawn: np.ndarray, weights: tuple[float, float], tried: int, depth: int, min_leaf: int, rng: np.random.Generator) -> np.ndarray:
    """P(1) of every row in a tree grown on the drawn ones; all nodes of a level together."""
    out = np.zeros(len(x))
    live, node, m = np.arange(len(x)), np.zeros(len(x), "i8"), 1
    for level in range(depth + 1):
        count = drawn[live].astype("f8")
        ones = count * y[live]
        n, pos = np.bincount(node, count, m), np.bincount(node, ones, m)
        best_feature, best_bin = np.full(m, -1), np.zeros(m, "i8")
        open_ = (pos > 0) & (pos < n) & (n >= 2 * min_leaf) & (level < depth)
        place = np.cumsum(open_) - 1
        taught = np.flatnonzero(open_[node] & (count > 0))
        taught = taught[np.argsort(node[taught], kind="stable")]
        at = place[node[taught]]
        numbers = np.flatnonzero(open_)
        for first in range(0, len(numbers), NODES_AT_ONCE):
            some = numbers[first : first + NODES_AT_ONCE]
            features = rng.random((len(some), x.shape[1])).argpartition(tried - 1, axis=1)[:, :tried]
            rows = slice(*np.searchsorted(at, [first, first + len(some)]))
            own, local = taught[rows], at[rows] - first
            cell = (((local[:, None] * tried) + np.arange(tried)) * BINS + x[live[own][:, None], features[local]]).reshape(-1)
            size = len(some) * tried * BINS
            hist = [np.bincount(cell, np.repeat(v[own], tried), size).reshape(len(some), tried, BINS) for v in (count, ones)]
            split, _ = _best_splits(*hist, weights, min_leaf)
            found = split >= 0
            best_feature[some[found]] = features[found, split[found] // (BINS - 1)]
            best_bin[some[found]] = split[found] % (BINS - 1)
        inner = best_feature[node] >= 0
        out[live[~inner]] = _share(n, pos, weights)[node[~inner]]
        live, node = live[inner], node[inner]
        if not len(live):
            break
        right = x[live, best_feature[node]] > best_bin[node]
        node = 2 * (np.cumsum(best_feature >= 0) - 1)[node] + right
        m = 2 * int((best_feature >= 0).sum())
    return out


def _binned(df: DataFrame, features: tuple[str, ...], label: str, key: str, fold: str | None) -> DataFrame:
    """``_id, _key, _y, _fold, _x`` and the columns of ``df``: features as one byte each, by 31 quantiles.  A null or NaN is in the last bin."""
    limits = [np.unique(q) for q in df.approxQuantile(list(features), [k / BINS for k in range(1, BINS)], 0.002)]

    @F.arrow_udf("binary")
    def bins(rows: pa.Array) -> pa.Array:
        flat = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        codes = np.stack([np.where(np.isnan(c), BINS - 1, np.searchsorted(q, c)) for c, q in zip(flat.T, limits, strict=True)], axis=1).astype("u1")
        return pa.array([row.tobytes() for row in codes], pa.binary())

    values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
    number = F.col(fold).cast("int") if fold else F.lit(-1)
    kept = [c for c in df.columns if c not in features]
    return cut_lineage(
        df.where(F.col(label).isin(0, 1)).select(
            *kept, F.monotonically_increasing_id().alias("_id"), F.xxhash64(key).alias("_key"), F.col(label).cast("int").alias("_y"), number.alias("_fold"), bins(values).alias("_x")
        ),
        "forest-rows",
    )


def _split_large(rows: DataFrame, tops: dict[int, list], tried: int, width: int, min_leaf: int, seed: int, drawn_for, weights_of) -> dict[tuple[int, int], tuple]:
    """Best split of every large node of ``tops``: (feature, bin, left rows, left ones); feature -1 where none helps."""
    large = {t: [i for i, n in enumerate(top) if n["state"] == "large"] for t, top in tops.items()}
    large = {t: ids for t, ids in large.items() if ids}
    tried_at = {(t, i): np.random.default_rng([seed, t, i]).permutation(width)[:tried] for t, ids in large.items() for i in ids}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x, y, key, fold = _arrays(batch, width)
            for t, ids in large.items():
                drawn = drawn_for(t, key, fold)
                node = _route(tops[t], x)
                for i in ids:
                    own = np.flatnonzero((node == i) & (drawn > 0))
                    cell = (np.arange(tried) * BINS + x[own][:, tried_at[t, i]]).reshape(-1)
                    hist = np.stack([np.bincount(cell, np.repeat(v[own], tried), tried * BINS) for v in (drawn, drawn * y)])
                    total[t, i] = total[t, i] + hist if (t, i) in total else hist
        for (t, i), hist in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([i], pa.int32()), pa.array([hist.tobytes()], pa.binary())], ["t", "i", "h"])

    def choose(part: pa.Table) -> pa.Table:
        t, i = part["t"][0].as_py(), part["i"][0].as_py()
        n, pos = sum(np.frombuffer(h.as_py(), "f8").reshape(2, 1, tried, BINS) for h in part["h"])
        split, child = _best_splits(n, pos, weights_of(t), min_leaf)
        feature = int(tried_at[t, i][split[0] // (BINS - 1)]) if split[0] >= 0 else -1
        columns = {"t": t, "i": i, "f": feature, "b": int(split[0] % (BINS - 1)), "n": float(child[0, 0]), "p": float(child[0, 1])}
        kinds = [pa.int32()] * 4 + [pa.float64()] * 2
        return pa.table({c: pa.array([v], k) for (c, v), k in zip(columns.items(), kinds, strict=True)})

    counted = rows.select("_x", "_y", "_key", "_fold").mapInArrow(count, "t int, i int, h binary")
    found = counted.groupBy("t", "i").applyInArrow(choose, "t int, i int, f int, b int, n double, p double").collect()
    return {(r["t"], r["i"]): (r["f"], r["b"], r["n"], r["p"]) for r in found}


def _arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    x = np.frombuffer(b"".join(batch.column("_x").to_pylist()), "u1").reshape(-1, width)
    return x, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_key", "_fold"))


def _route(top: list[dict], x: np.ndarray) -> np.ndarray:
    """Node of each row among the split large nodes; children follow their parents in the list."""
    node = np.zeros(len(x), "i8")
    for i, n in enumerate(top):
        if n["state"] == "split":
            own = np.flatnonzero(node == i)
            node[own] = np.where(x[own, n["f"]] > n["b"], n["right"], n["left"])
    return node


def forest_scores(
    df: DataFrame, features, *, label: str = "y", key: str = "bbl", fold: str | None = None, trees: int = 200, depth: int = 30, min_leaf: int = 1, seed: int = 42, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """``df`` without its features, with ``prob`` and ``prediction`` of a random forest with balanced classes.

    With ``fold`` every row is scored by the forest of the other folds, all folds at once.
    A node tries a root of the features, in 32 bins each, and splits by Gini impurity; trees
    vote with their leaves' shares.  Rows whose label is neither 0 nor 1 take no part.
    """
    features = tuple(features)
    width, tried = len(features), int(np.ceil(np.sqrt(len(features))))
    rows = _binned(df, features, label, key, fold)
    sizes = {(r["_fold"], r["_y"]): r["n"] for r in rows.groupBy("_fold", "_y").agg(F.count("*").alias("n")).collect()}
    models = sorted({f for f, _ in sizes})
    held_out = fold is not None
    taught = {f: [sum(n for (g, y), n in sizes.items() if y == v and (not held_out or g != f)) for v in (0, 1)] for f in models}
    weights = {f: tuple(sum(n) / (2.0 * v) if v else 0.0 for v in n) for f, n in taught.items()}

    def weights_of(t: int) -> tuple[float, float]:
        return weights[models[t // trees]]

    def drawn_for(t: int, key: np.ndarray, fold: np.ndarray) -> np.ndarray:
        drawn = _draws(key, t, seed)
        return np.where(fold != models[t // trees], drawn, 0) if held_out else drawn

    def node(n: float, pos: float, level: int, t: int) -> dict:
        state = "leaf" if pos in (0, n) or n < 2 * min_leaf or level >= depth else "large" if n > group_rows else "small"
        return {"state": state, "n": n, "pos": pos, "level": level, "prob": float(_share(np.float64(n), np.float64(pos), weights_of(t)))}

    tops = {}
    for t in range(len(models) * trees):
        n0, n1 = taught[models[t // trees]]
        tops[t] = [{"state": "large" if n0 + n1 > group_rows else "small", "n": None, "pos": None, "level": 0, "prob": None}]
    if any(top[0]["state"] == "large" for top in tops.values()):
        # The exact number of draws of a root comes with its first histogram.
        sums = _root_counts(rows, [t for t in tops if tops[t][0]["state"] == "large"], width, drawn_for)
        for t, (n, pos) in sums.items():
            tops[t] = [node(n, pos, 0, t)]
    while any(n["state"] == "large" for top in tops.values() for n in top):
        for (t, i), (f, b, n, pos) in _split_large(rows, tops, tried, width, min_leaf, seed, drawn_for, weights_of).items():
            own = tops[t][i]
            if f < 0:
                own["state"] = "leaf"
                continue
            own.update(state="split", f=f, b=b, left=len(tops[t]), right=len(tops[t]) + 1)
            tops[t] += [node(n, pos, own["level"] + 1, t), node(own["n"] - n, own["pos"] - pos, own["level"] + 1, t)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["t", "i", "part", "prob", "x", "y", "drawn", "id"]
        for part, batch in enumerate(batches):
            x, y, key, fold_ = _arrays(batch, width)
            ids = batch.column("_id").to_numpy(zero_copy_only=False)
            for t, top in tops.items():
                drawn = drawn_for(t, key, fold_)
                scored = fold_ == models[t // trees]
                at = _route(top, x)
                for i, n in enumerate(top):
                    if n["state"] == "split":
                        continue
                    leaf = n["state"] == "leaf"
                    own = np.flatnonzero((at == i) & (scored if leaf else scored | (drawn > 0)))
                    if not len(own):
                        continue
                    # A row that only teaches has no id to score.
                    id_ = np.where(scored[own], ids[own], -1)
                    packed = [b"", b"", b""] if leaf else [x[own].tobytes(), y[own].astype("u1").tobytes(), drawn[own].astype("u1").tobytes()]
                    values = [t, i, part if leaf else 0, n["prob"] if leaf else None, *packed, id_.astype("i8").tobytes()]
                    kinds = [pa.int32()] * 3 + [pa.float64()] + [pa.binary()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    def finish(part: pa.Table) -> pa.Table:
        t, i, prob = part["t"][0].as_py(), part["i"][0].as_py(), part["prob"][0].as_py()
        ids, x, y, drawn = (np.frombuffer(b"".join(part[c].to_pylist()), k) for c, k in (("id", "i8"), ("x", "u1"), ("y", "u1"), ("drawn", "u1")))
        own = ids >= 0
        if prob is None:
            found = grow_and_score(x.reshape(-1, width), y, drawn, weights_of(t), tried, depth - tops[t][i]["level"], min_leaf, np.random.default_rng([seed, t, i, 1]))[own]
        else:
            found = np.full(int(own.sum()), prob)
        return pa.table({"_id": pa.array(ids[own], pa.int64()), "p": pa.array(found, pa.float64())})

    dealt = rows.select("_id", "_x", "_y", "_key", "_fold").mapInArrow(deal, "t int, i int, part int, prob double, x binary, y binary, drawn binary, id binary")
    votes = dealt.groupBy("t", "i", "part").applyInArrow(finish, "_id long, p double")
    scores = votes.groupBy("_id").agg((F.sum("p") / trees).alias("prob"))
    scored = rows.join(scores, "_id").drop("_id", "_key", "_y", "_fold", "_x")
    return scored.withColumn("prediction", (F.col("prob") > 0.5).cast("int"))


def _root_counts(rows: DataFrame, wanted: list[int], width: int, drawn_for) -> dict[int, tuple[float, float]]:
    """Draws and draws of ones of whole trees."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, key, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_key", "_fold"))
            drawn = [drawn_for(t, key, fold) for t in wanted]
            arrays = [pa.array(wanted, pa.int32()), pa.array([int(d.sum()) for d in drawn], pa.int64()), pa.array([int((d * y).sum()) for d in drawn], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["t", "n", "p"])

    found = rows.select("_y", "_key", "_fold").mapInArrow(count, "t int, n long, p long").groupBy("t").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    return {r["t"]: (float(r["n"]), float(r["p"])) for r in found.collect()}
