"""Nearest neighbours by inner product with cross-polytope hashing.

Vectors are scaled to unit length within ranges of norms (one more coordinate takes up what
a shorter vector lacks, which turns the largest inner product into the smallest angle).  A
table rotates them with three rounds of random signs and fast Hadamard transforms and puts
each on the nearest signed axis.  A query looks into the buckets of its nearest axes in
every table and its candidates are ranked by exact inner products, block by block.  A query
that finds fewer others than it asks for is ranked against all vectors of its length.

Equal vectors are hashed once; of their ids only the ``k + 1`` smallest can be in a result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotgrid.llm.common import stored

# Production parameters.
NEAREST = 20
QUERY_EVERY = 20
TABLES = 4
PROBES = 56  # of the 2 * width signed axes of a table
BLOCK = 2048  # candidates and queries of one block product, at most about this many
SEED = 20240229

KEY = ["tab", "width", "band", "axis"]


def _width(dim: int) -> int:
    return 1 << max(1, dim.bit_length())  # room for one more coordinate


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-random rotation of rows whose length is a power of two."""
    n = x.shape[1]
    signs = np.random.default_rng([SEED, table, n]).choice([-1.0, 1.0], (3, n))
    for s in signs:
        x = x * s
        h = 1
        while h < n:
            y = x.reshape(len(x), -1, 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
            h *= 2
    return x / n**1.5


def axes(x: np.ndarray, top: np.ndarray | None, table: int, count: int) -> np.ndarray:
    """The ``count`` nearest signed axes of each row, nearest first.

    ``top`` is the largest norm of each row's range for stored vectors, None for queries.
    """
    norm = np.linalg.norm(x, axis=1)
    unit = np.zeros((len(x), _width(x.shape[1])))
    if top is None:
        unit[:, : x.shape[1]] = x / norm[:, None]
    else:
        unit[:, : x.shape[1]] = x / top[:, None]
        unit[:, x.shape[1]] = np.sqrt(np.maximum(0.0, 1.0 - (norm / top) ** 2))
    turned = rotate(unit, table)
    signed = np.concatenate([turned, -turned], axis=1)
    if count == 1:
        return signed.argmax(axis=1)[:, None]
    return np.argsort(-signed, axis=1, kind="stable")[:, :count]


def band_of(norm: np.ndarray) -> np.ndarray:
    """Norm ranges of a factor of two; the powers of two lie in their middles."""
    return np.floor(np.log2(norm) + 0.5).astype("i4")


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """``node, v, ids``: every usable vector once, with its ``k + 1`` smallest ids."""
    smallest = Window.partitionBy("v").orderBy("vec_id")
    ranked = vectors.dropDuplicates(["vec_id", "v"]).withColumn("at", F.row_number().over(smallest)).where(F.col("at") <= k + 1)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.xxhash64("v").alias("node"), "v", "ids")


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id, v`` without null ids and vectors that are null, zero, or hold null or non-finite numbers."""
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return embeddings.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & fine & F.exists("embedding", lambda x: x != 0)).select("vec_id", F.col("embedding").alias("v"))


def _by_width(batch: pd.DataFrame):
    dims = batch["v"].map(len)
    for _, part in batch.groupby(dims):
        yield part, np.stack(part["v"].to_numpy()).astype("f8")


def nearest(embeddings: DataFrame, k: int = NEAREST, every: int = QUERY_EVERY, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose vec_id is divisible by ``every``.

    Vectors are compared with those of their own length.  Repeated rows are one; the same id
    with two vectors is two candidates and two queries.  Every query gets ``k`` rows, or all
    others of its length if there are fewer.  An empty table gives no rows.
    """
    rows = usable(embeddings)
    kind = dict(rows.dtypes)
    nodes = stored(distinct_vectors(rows, k), "ann_nodes")
    asking = stored(rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("node")).distinct(), "ann_asking")
    queries = stored(nodes.join(asking.select("node").distinct(), "node", "left_semi").select("node", "v"), "ann_queries")

    def norms(frames):
        for batch in frames:
            for _, x in _by_width(batch):
                norm = np.linalg.norm(x, axis=1)
                yield pd.DataFrame({"dim": x.shape[1], "band": band_of(norm), "norm": norm})

    # A row per vector length and power of two of the norm.
    bands = nodes.select("v").mapInPandas(norms, "dim int, band int, norm double").groupBy("dim", "band").agg(F.max("norm").alias("top"))
    tops = {(r["dim"], r["band"]): r["top"] for r in bands.collect()}

    def placed(frames):
        for batch in frames:
            for part, x in _by_width(batch):
                dim, band = x.shape[1], band_of(np.linalg.norm(x, axis=1))
                top = np.array([tops[dim, b] for b in band.tolist()])
                for t in range(tables):
                    yield pd.DataFrame({"tab": t, "width": dim, "band": band, "axis": axes(x, top, t, 1)[:, 0], "node": part["node"].to_numpy()})

    def probed(frames):
        for batch in frames:
            for part, x in _by_width(batch):
                dim = x.shape[1]
                mine = [b for d, b in tops if d == dim]
                for t in range(tables):
                    near = axes(x, None, t, min(probes, 2 * _width(dim)))
                    for b in mine:
                        yield pd.DataFrame({"tab": t, "width": dim, "band": b, "axis": near.ravel(), "node": np.repeat(part["node"].to_numpy(), near.shape[1])})

    schema = "tab int, width int, band int, axis int, node long"
    place = stored(nodes.select("node", "v").mapInPandas(placed, schema), "ann_place")
    probe = stored(queries.mapInPandas(probed, schema), "ann_probe")
    def rank(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"qnode": [], "node": [], "score": [], "least": []}, dtype="i8").astype({"score": "f8"})
        a, b = np.stack(q["v"].to_numpy()).astype("f8"), np.stack(c["v"].to_numpy()).astype("f8")
        # Equal scores at the edge of the list are all kept for the exact order below.
        rough = a @ b.T
        if len(c) > k + 1:
            edge = -np.partition(-rough, k, axis=1)[:, k]
            i, j = np.nonzero(rough >= (edge - 1e-9 * np.abs(edge) - 1e-300)[:, None])
        else:
            i, j = (m.ravel() for m in np.indices(rough.shape))
        exact = (a[i] * b[j]).sum(axis=1)
        return pd.DataFrame({"qnode": q["node"].to_numpy()[i], "node": c["node"].to_numpy()[j], "score": exact, "least": c["least"].to_numpy()[j]})

    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block = [*KEY, "cpart", "qpart"]
    best = Window.partitionBy("qnode").orderBy(F.desc("score"), "least", "node")

    def ranked(place: DataFrame, probe: DataFrame, times: int, name: str) -> DataFrame:
        """``qnode, node, score``: the best ``k + 1`` nodes among those that share a key, at most ``times`` each."""
        # Buckets are counted to cut crowded ones into blocks; there are at most tables * axes a band.
        crowd = place.groupBy(*KEY).agg(F.count(F.lit(1)).alias("c")).join(probe.groupBy(*KEY).agg(F.count(F.lit(1)).alias("q")), KEY)
        crowd = stored(crowd.select(*KEY, F.ceil(F.col("c") / BLOCK).cast("int").alias("cs"), F.ceil(F.col("q") / BLOCK).cast("int").alias("qs")), f"{name}_crowd")
        held = place.join(crowd, KEY).select(*KEY, part("cs").alias("cpart"), spread("qs").alias("qpart"), "node").join(nodes.select("node", "v", F.col("ids")[0].alias("least")), "node")
        asked = probe.join(crowd, KEY).select(*KEY, part("qs").alias("qpart"), spread("cs").alias("cpart"), "node").join(queries, "node")
        scored = asked.groupBy(*block).cogroup(held.groupBy(*block)).applyInPandas(rank, f"qnode long, node long, score double, least {kind['vec_id']}")
        # A vector turns up ``times`` at most; after the first cut the finds are merged.
        found = scored.withColumn("at", F.row_number().over(best)).where(F.col("at") <= times * (k + 1)).dropDuplicates(["qnode", "node"])
        return stored(found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1).select("qnode", "node", "score"), f"{name}_found")

    found = ranked(place, probe, tables, "ann")
    # Queries whose buckets hold fewer than k others are ranked against all vectors of their length.
    others = F.sum(F.size("ids") - F.when(F.col("qnode") == F.col("node"), 1).otherwise(0))
    full = found.join(nodes.select("node", "ids"), "node").groupBy("qnode").agg(others.alias("n")).where(F.col("n") >= k)
    short = stored(queries.join(full, queries["node"] == full["qnode"], "left_anti").select("node", "v"), "ann_short")
    if not short.isEmpty():
        whole = lambda df: df.select(F.lit(-1).alias("tab"), F.size("v").alias("width"), F.lit(0).alias("band"), F.lit(0).alias("axis"), "node")
        every_one = ranked(whole(nodes), whole(short), 1, "ann_all")
        found = found.join(short, found["qnode"] == short["node"], "left_anti").unionByName(every_one)
    ids = found.join(nodes.select("node", "ids"), "node").select("qnode", "node", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("qnode").orderBy(F.desc("score"), "vec_id", "node")
    ids = ids.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    lists = ids.groupBy("qnode").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "node", "score"))).alias("list"))
    lists = stored(lists, "ann_lists").select(F.col("qnode").alias("node"), "list")
    others = F.filter("list", lambda r: ~((r["vec_id"] == F.col("query_id")) & (r["node"] == F.col("node"))))
    answer = asking.join(lists, "node").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("pos", "r"))
    return answer.select(F.col("query_id").cast("long").alias("query_id"), (F.col("pos") + 1).alias("rank"), F.col("r.vec_id").cast("long").alias("vec_id"), F.col("r.score").alias("score"))
