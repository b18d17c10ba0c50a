"""Rasters as tables of square tiles.

A tile is one row, ``trow, tcol`` and one row-major array per band, ``side * side`` long.
Whole-number bands are ``array<bigint>`` with ``ABSENT`` where the raster has no cell, other
bands ``array<double>`` with NaN.  Tiles are what is shuffled: map algebra works array by
array where a tile lies, neighbourhoods travel as strips along tile edges, and polygons meet
a raster as row spans cut at tile edges, never as cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 256
ABSENT = -1
TILE = ["trow", "tcol"]
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _arrow(kind: str) -> pa.DataType:
    return pa.int64() if kind == "bigint" else pa.float64()


def _kind(df: DataFrame, band: str) -> str:
    kind = dict(df.dtypes)[band]
    kind = kind.removeprefix("array<").removesuffix(">")
    return "bigint" if kind in _WHOLE else "double"


def _array(values: np.ndarray, kind: str) -> pa.Array:
    """One list value per tile."""
    flat = np.ascontiguousarray(values).reshape(-1)
    size = values[0].size if len(values) else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * size, pa.int32()), pa.array(flat, _arrow(kind)))


def _numpy(column: pa.Array | pa.ChunkedArray, side: int) -> np.ndarray:
    """Band arrays of several tiles as (tile, row, column)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, side, side)


def from_cells(cells: DataFrame, bands: list[str], side: int = SIDE) -> DataFrame:
    """Tiles of a cell table ``prow, pcol, <bands>``: the one place where cells are shuffled, once, to be stored.

    Null values are absent.  Of several rows for a cell that with the largest values stays.
    """
    kinds = {b: _kind(cells, b) for b in bands}
    schema = "trow int, tcol int, " + ", ".join(f"`{b}` array<{k}>" for b, k in kinds.items())

    def fill(part: pa.Table) -> pa.Table:
        at = part["_at"].to_numpy()
        out = {"trow": part["trow"].slice(0, 1), "tcol": part["tcol"].slice(0, 1)}
        for b, kind in kinds.items():
            tile = np.full(side * side, ABSENT, "i8") if kind == "bigint" else np.full(side * side, np.nan)
            own = part[b].drop_null().to_numpy()
            spots = at[part[b].is_valid().to_numpy()]
            order = np.argsort(own, kind="stable")
            tile[spots[order]] = own[order]
            out[b] = _array(tile[None], kind)
        return pa.table(out)

    side_ = F.lit(side)
    placed = cells.select(
        F.floor(F.col("prow") / side_).cast("int").alias("trow"),
        F.floor(F.col("pcol") / side_).cast("int").alias("tcol"),
        (F.pmod("prow", side_) * side + F.pmod("pcol", side_)).cast("int").alias("_at"),
        *[F.col(b).cast(k).alias(b) for b, k in kinds.items()],
    )
    return placed.groupBy(*TILE).applyInArrow(fill, schema)


def as_tiles(table: DataFrame, bands: list[str], side: int = SIDE) -> DataFrame:
    """The bands of a tile table, or a cell table made into one."""
    return table.select(*TILE, *bands) if "trow" in table.columns else from_cells(table, bands, side)


def to_cells(tiles: DataFrame, bands: dict[str, str], side: int = SIDE, present: str | None = None) -> DataFrame:
    """Cell rows of tiles, made where the tiles lie; absent cells of ``present`` (the first band) give none.

    ``bands`` maps a band to the type of its column.
    """
    present = present or next(iter(bands))
    whole = {b: _kind(tiles, b) == "bigint" for b in bands}
    cells = tiles.select(*TILE, F.posexplode(F.arrays_zip(*bands)).alias("_at", "_v"))
    known = F.col("_v")[present] != ABSENT if whole[present] else ~F.isnan(F.col("_v")[present])

    def value(b: str) -> Column:
        v = F.col("_v")[b]
        return F.when(v != ABSENT if whole[b] else ~F.isnan(v), v).cast(bands[b]).alias(b)

    place = [
        (F.col("trow") * side + F.floor(F.col("_at") / side)).cast("int").alias("prow"),
        (F.col("tcol") * side + F.col("_at") % side).cast("int").alias("pcol"),
    ]
    return cells.where(known).select(*place, *[value(b) for b in bands])


def stack(left: DataFrame, right: DataFrame, side: int = SIDE) -> DataFrame:
    """Bands of two co-registered tile tables side by side; tiles of ``left`` stay, what ``right`` lacks is absent."""
    bands = [c for c in right.columns if c not in TILE]
    joined = left.join(right, TILE, "left")

    def fill(b: str) -> Column:
        empty = F.array_repeat(F.lit(ABSENT).cast("bigint") if _kind(right, b) == "bigint" else F.lit(float("nan")), side * side)
        return F.coalesce(F.col(b), empty).alias(b)

    return joined.select(*left.columns, *[fill(b) for b in bands])


def map_tiles(tiles: DataFrame, bands: list[str], work: Callable[..., dict], schema: str, side: int = SIDE) -> DataFrame:
    """Rows of ``work(trow, tcol, *band arrays)`` for every tile; a dict of columns per tile, ``schema`` as Spark text."""
    wanted = tiles.select(*TILE, *bands)
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "smallint": pa.int16(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                out = work(row.column("trow")[0].as_py(), row.column("tcol")[0].as_py(), *[_numpy(row.column(b), side)[0] for b in bands])
                yield pa.RecordBatch.from_arrays([v if isinstance(v := out[n], pa.Array) else pa.array(v, t) for n, t in zip(names, kinds, strict=True)], names)

    return wanted.mapInArrow(run, schema)


# ---------------------------------------------------------------- spans


def cut_spans(spans: DataFrame, side: int = SIDE) -> DataFrame:
    """Row spans ``prow, col_lo, col_hi`` cut at tile edges: ``trow, tcol, i, lo, hi`` and the other columns."""
    keep = [c for c in spans.columns if c not in ("prow", "col_lo", "col_hi")]
    side_ = F.lit(side)
    tiles = F.sequence(F.floor(F.col("col_lo") / side_).cast("int"), F.floor(F.col("col_hi") / side_).cast("int"))
    return (
        spans.withColumn("tcol", F.explode(tiles))
        .withColumn("trow", F.floor(F.col("prow") / side_).cast("int"))
        .select(
            *keep,
            *TILE,
            F.pmod("prow", side_).cast("int").alias("i"),
            F.greatest(F.col("col_lo") - F.col("tcol") * side, F.lit(0)).cast("int").alias("lo"),
            F.least(F.col("col_hi") - F.col("tcol") * side, side_ - 1).cast("int").alias("hi"),
        )
    )


def _covered(i: np.ndarray, lo: np.ndarray, hi: np.ndarray, side: int) -> np.ndarray:
    """Cells of any span."""
    step = np.zeros((side, side + 1), "i4")
    np.add.at(step, (i, lo), 1)
    np.add.at(step, (i, hi + 1), -1)
    return np.cumsum(step, axis=1)[:, :side] > 0


def _expanded(i: np.ndarray, lo: np.ndarray, hi: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat positions of all span cells, and the span of each."""
    n = hi - lo + 1
    span = np.repeat(np.arange(len(n)), n)
    ends = np.cumsum(n)
    return (i * side + lo)[span] + np.arange(len(span)) - np.repeat(ends - n, n), span


def burn_passes(spans: DataFrame, passes: dict[int, int], out: str, side: int = SIDE, cover: int | None = None) -> DataFrame:
    """Tiles of spans with a ``pass``: a cell has ``passes[p]`` of its highest pass ``p``.

    Spans of pass ``cover`` do not count in that; they set the band ``covered``.
    """

    def paint(part: pa.Table) -> pa.Table:
        i, lo, hi, which = (part[c].to_numpy() for c in ("i", "lo", "hi", "pass"))
        tile = np.full((side, side), ABSENT, "i8")
        for p in sorted(passes):
            mine = which == p
            if mine.any():
                tile[_covered(i[mine], lo[mine], hi[mine], side)] = passes[p]
        made = {"trow": part["trow"].slice(0, 1), "tcol": part["tcol"].slice(0, 1), out: _array(tile[None], "bigint")}
        if cover is not None:
            mine = which == cover
            made["covered"] = _array(_covered(i[mine], lo[mine], hi[mine], side).astype("i8")[None], "bigint")
        return pa.table(made)

    schema = f"trow int, tcol int, `{out}` array<bigint>" + (", covered array<bigint>" if cover is not None else "")
    return cut_spans(spans.select("pass", "prow", "col_lo", "col_hi"), side).groupBy(*TILE).applyInArrow(paint, schema)


# ---------------------------------------------------------------- distance


def squared_distance(target: np.ndarray, reach: int) -> np.ndarray:
    """Squared distance to the nearest true cell, exact up to ``reach`` cells and larger than that beyond.

    Two separable passes: along rows to the nearest one of the row, then along columns over
    the rows' results.
    """
    far = reach + 1
    along = np.where(target, 0, far).astype("i4")
    row = along.copy()
    for d in range(1, reach + 1):
        row[:, d:] = np.minimum(row[:, d:], along[:, :-d] + d)
        row[:, :-d] = np.minimum(row[:, :-d], along[:, d:] + d)
    row = np.minimum(row, far) ** 2
    out = row.copy()
    for d in range(1, reach + 1):
        out[d:] = np.minimum(out[d:], row[:-d] + d * d)
        out[:-d] = np.minimum(out[:-d], row[d:] + d * d)
    return out


def with_halo(tiles: DataFrame, bands: list[str], reach: int, work: Callable[..., dict], made: dict[str, str], side: int = SIDE) -> DataFrame:
    """``work(*padded bands)`` for every tile, each band with ``reach`` cells of its neighbours around it.

    A tile sends itself and, to each neighbour within reach, the strip that the neighbour
    sees: one shuffle of tiles.  ``made`` maps result bands to "bigint" or "double".
    """
    rings = -(-reach // side) if reach else 0
    kinds = {b: _kind(tiles, b) for b in bands}

    def strip(d: int) -> tuple[slice, int]:
        """Rows of a tile that the tile ``d`` tiles further down sees, and where they start in its padded array."""
        low, high = max(0, d * side - reach), min(side, (d + 1) * side + reach)
        return slice(low, high), low - d * side + reach

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                trow, tcol = row.column("trow")[0].as_py(), row.column("tcol")[0].as_py()
                arrays = {b: _numpy(row.column(b), side)[0] for b in bands}
                for a in range(-rings, rings + 1):
                    for c in range(-rings, rings + 1):
                        rows, top = strip(a)
                        cols, left = strip(c)
                        if rows.start >= rows.stop or cols.start >= cols.stop:
                            continue
                        parts = {b: v[rows, cols] for b, v in arrays.items()}
                        if (a or c) and all((v == ABSENT).all() if kinds[b] == "bigint" else np.isnan(v).all() for b, v in parts.items()):
                            continue
                        meta = [trow + a, tcol + c, int(not (a or c)), top, left, rows.stop - rows.start, cols.stop - cols.start]
                        yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()) for m in meta] + [_array(v[None], kinds[b]) for b, v in parts.items()], [*names, *bands])

    # The strip of tile (trow, tcol) for the tile at (trow + a, tcol + c).
    names = ["trow", "tcol", "_own", "_top", "_left", "_h", "_w"]
    sent = tiles.select(*TILE, *bands).mapInArrow(send, ", ".join(f"{n} int" for n in names) + "".join(f", `{b}` array<{kinds[b]}>" for b in bands))

    def join(part: pa.Table) -> pa.Table:
        own = [m.as_py() for m in part["_own"]]
        if 1 not in own:
            return pa.table({"trow": pa.array([], pa.int32()), "tcol": pa.array([], pa.int32())} | {b: pa.array([], pa.list_(_arrow(k))) for b, k in made.items()})
        padded = []
        for b in bands:
            whole = np.full((side + 2 * reach,) * 2, ABSENT if kinds[b] == "bigint" else np.nan, "i8" if kinds[b] == "bigint" else "f8")
            values = part[b].combine_chunks() if isinstance(part[b], pa.ChunkedArray) else part[b]
            for k in range(part.num_rows):
                top, left, h, w = (part[c][k].as_py() for c in ("_top", "_left", "_h", "_w"))
                whole[top : top + h, left : left + w] = values.slice(k, 1).flatten().to_numpy(zero_copy_only=False).reshape(h, w)
            padded.append(whole)
        out = work(*padded)
        at = own.index(1)
        return pa.table({"trow": part["trow"].slice(at, 1), "tcol": part["tcol"].slice(at, 1)} | {b: _array(out[b][None], k) for b, k in made.items()})

    return sent.groupBy(*TILE).applyInArrow(join, "trow int, tcol int" + "".join(f", `{b}` array<{k}>" for b, k in made.items()))


def erode(tiles: DataFrame, radius: int, *, band: str = "label", inner: int = 1, outer: int = 0, value: int = 255, side: int = SIDE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cells of class ``inner`` whose exact distance to class ``outer`` is at most ``radius`` take ``value``; ``keep`` bands stay."""
    inside = slice(radius, radius + side) if radius else slice(None)

    def work(label: np.ndarray, *others: np.ndarray) -> dict:
        near = squared_distance(label == outer, radius) <= radius * radius if radius else np.zeros(label.shape, bool)
        out = np.where((label == inner) & near, value, label)
        return {band: out[inside, inside]} | {b: v[inside, inside] for b, v in zip(keep, others, strict=True)}

    kinds = {band: "bigint"} | {b: _kind(tiles, b) for b in keep}
    return with_halo(tiles, [band, *keep], radius, work, kinds, side)


# ---------------------------------------------------------------- counts and zones


def count_classes(tiles: DataFrame, by: str, band: str, side: int = SIDE) -> DataFrame:
    """``by, band, n``: cells per pair of values, absent ones of ``band`` included as ``ABSENT``; summed per tile first."""

    def work(_r: int, _c: int, zone: np.ndarray, label: np.ndarray) -> dict:
        known = zone != ABSENT
        kinds, n = np.unique(np.stack([zone[known], label[known]]), axis=1, return_counts=True)
        return {by: kinds[0], band: kinds[1], "n": n}

    partial = map_tiles(tiles, [by, band], work, f"{by} long, {band} long, n long", side)
    return partial.groupBy(by, band).agg(F.sum("n").alias("n"))


def _moments(zone: np.ndarray, values: dict[str, np.ndarray], kinds: dict[str, str]) -> dict:
    """Per zone and band: cells, mean and sum of squared differences from it."""
    ids, at = np.unique(zone, return_inverse=True)
    out: dict[str, list] = {"zone": [], "band": [], "n": [], "mean": [], "m2": []}
    for k, (b, v) in enumerate(values.items()):
        known = v != ABSENT if kinds[b] == "bigint" else ~np.isnan(v)
        own, x = at[known], v[known].astype("f8")
        n = np.bincount(own, minlength=len(ids))
        mean = np.bincount(own, x, len(ids)) / np.maximum(n, 1)
        m2 = np.bincount(own, (x - mean[own]) ** 2, len(ids))
        for name, column in (("zone", ids), ("band", np.full(len(ids), k)), ("n", n), ("mean", mean), ("m2", m2)):
            out[name].append(column)
    return {name: np.concatenate(v) for name, v in out.items()}


def _value_counts(zone: np.ndarray, values: dict[str, np.ndarray], kinds: dict[str, str]) -> dict:
    """Per zone and band: how often each value occurs."""
    out: dict[str, list] = {"zone": [], "band": [], "value": [], "n": []}
    for k, (b, v) in enumerate(values.items()):
        known = v != ABSENT if kinds[b] == "bigint" else ~np.isnan(v)
        pairs = np.zeros(int(known.sum()), [("z", "i8"), ("v", "f8")])
        pairs["z"], pairs["v"] = zone[known], v[known]
        kind, n = np.unique(pairs, return_counts=True)
        for name, column in (("zone", kind["z"]), ("band", np.full(len(n), k)), ("value", kind["v"]), ("n", n)):
            out[name].append(column)
    return {name: np.concatenate(v) for name, v in out.items()}


def _summaries(zone: np.ndarray, values: dict[str, np.ndarray], kinds: dict[str, str]) -> dict:
    """``_moments`` with each zone's median in the tile, NaN without a value."""
    out = _moments(zone, values, kinds)
    ids, at = np.unique(zone, return_inverse=True)
    medians = []
    for b, v in values.items():
        known = v != ABSENT if kinds[b] == "bigint" else ~np.isnan(v)
        own, x = at[known], v[known].astype("f8")
        x = x[np.lexsort((x, own))]
        n = np.bincount(own, minlength=len(ids))
        first, has = np.cumsum(n) - n, n > 0
        median = np.full(len(ids), np.nan)
        low, high = x[(first + (n - 1) // 2)[has]], x[(first + n // 2)[has]]
        median[has] = low + (high - low) * 0.5
        medians.append(median)
    return out | {"median": np.concatenate(medians)}


MOMENTS = "zone long, band int, n long, mean double, m2 double"
SUMMARIES = MOMENTS + ", median double"
COUNTS = "zone long, band int, value double, n long"


def zone_partials(tiles: DataFrame, zone: str, bands: list[str], what: str, side: int = SIDE) -> DataFrame:
    """Partial ``MOMENTS`` or ``COUNTS`` per tile, zone and band of an id band."""
    kinds = {b: _kind(tiles, b) for b in bands}
    make, schema = (_moments, MOMENTS) if what == "moments" else (_value_counts, COUNTS)

    def work(_r: int, _c: int, ids: np.ndarray, *values: np.ndarray) -> dict:
        known = ids != ABSENT
        return make(ids[known], {b: v[known] for b, v in zip(bands, values, strict=True)}, kinds)

    return map_tiles(tiles, [zone, *bands], work, schema, side)


def span_partials(tiles: DataFrame, spans: DataFrame, key: str, bands: list[str], what: str, side: int = SIDE) -> DataFrame:
    """The same, or ``SUMMARIES``, for the spans of polygons, which may overlap; spans and tiles meet by tile."""
    kinds = {b: _kind(tiles, b) for b in bands}
    make, schema = {"moments": (_moments, MOMENTS), "summaries": (_summaries, SUMMARIES), "counts": (_value_counts, COUNTS)}[what]
    names = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    fields = [(c.split()[0], names[c.split()[1]]) for c in schema.split(", ")]

    def meet(part: pa.Table, given: pa.Table) -> pa.Table:
        if not part.num_rows or not given.num_rows:
            return pa.table({c: pa.array([], k) for c, k in fields})
        zone, i, lo, hi = (part[c].to_numpy() for c in (key, "i", "lo", "hi"))
        flat, span = _expanded(i, lo, hi, side)
        values = {b: _numpy(given[b], side)[0].reshape(-1)[flat] for b in bands}
        out = make(zone[span], values, kinds)
        return pa.table({c: pa.array(out[c], k) for c, k in fields})

    cut = cut_spans(spans.select(F.col(key).cast("bigint").alias(key), "prow", "col_lo", "col_hi"), side)
    return cut.groupBy(*TILE).cogroup(tiles.select(*TILE, *bands).groupBy(*TILE)).applyInArrow(meet, schema)


def merged_moments(partials: DataFrame) -> DataFrame:
    """``zone, band, n, mean, std`` of partial moments; the population spread."""
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / F.nullif(n, F.lit(0))
    whole = partials.groupBy("zone", "band").agg(n.alias("n"), mean.alias("mean"), F.sum("m2").alias("_m2"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_q"))
    between = F.greatest(F.col("_q") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0))
    return whole.select("zone", "band", "n", "mean", F.sqrt((F.col("_m2") + between) / F.nullif("n", F.lit(0))).alias("std"))


def span_sums(tiles: DataFrame, spans: DataFrame, key: str, band: str, least: float, side: int = SIDE) -> DataFrame:
    """``key, n, hits``: cells of a double band under each polygon and those of at least ``least``.

    Every tile keeps running counts along its rows, so a span costs two look-ups however
    long it is.
    """

    def meet(part: pa.Table, given: pa.Table) -> pa.Table:
        if not part.num_rows or not given.num_rows:
            return pa.table({key: pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "hits": pa.array([], pa.int64())})
        v = _numpy(given[band], side)[0]
        i, lo, hi = (part[c].to_numpy() for c in ("i", "lo", "hi"))
        zone, at = np.unique(part[key].to_numpy(), return_inverse=True)
        out = {key: pa.array(zone, pa.int64())}
        for name, flag in (("n", ~np.isnan(v)), ("hits", v >= least)):
            upto = np.concatenate([np.zeros((side, 1), "i8"), np.cumsum(flag, axis=1)], axis=1)
            out[name] = pa.array(np.bincount(at, upto[i, hi + 1] - upto[i, lo], len(zone)).astype("i8"), pa.int64())
        return pa.table(out)

    cut = cut_spans(spans.select(F.col(key).cast("bigint").alias(key), "prow", "col_lo", "col_hi"), side)
    met = cut.groupBy(*TILE).cogroup(tiles.select(*TILE, band).groupBy(*TILE)).applyInArrow(meet, f"{key} long, n long, hits long")
    return met.groupBy(key).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
