"""Vector compression to part codes; nearest entries are found with LAESA pivots.

Vectors become integers and are cut into equal parts.  Every part position has a codebook,
started from the smallest ids and moved by rounds of assignment and integer means.  The
distances of all parts to a few fixed pivots are computed once and stored beside the parts.
In every round only pivots and entries are compared anew: the differences of the two
distances bound a part's distance to an entry from below, entries are tried in the order
of that bound, and trying ends where the bound passes the best exact distance.

Exactness: bounds are doubles, lessened by more than their rounding error, and only skip
entries that are strictly farther; what is compared is integers.  Vectors with components
beyond ``2 ** 28`` are worked on with Python's integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotgrid.llm.common import dropped, fresh, stored

# Production parameters.
SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
PIVOTS = 4
ROWS_AT_ONCE = 1024

SAFE = 1 << 28  # components below it have squared distances within 64 bits
SLACK = 1e-12  # relative; the rounding error of a bound is below 1e-15


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector and components are neither null nor non-finite; one of no components is not usable."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)


def _cut(vectors: list[list[int]], parts: int) -> np.ndarray:
    """Rows of equal length as (row, part, component); zeros fill the last parts up, which changes no distance."""
    data = np.array(vectors, dtype=object)
    width = -(-data.shape[1] // parts)
    full = np.zeros((len(data), width * parts), dtype=object)
    full[:, : data.shape[1]] = data
    small = max((abs(int(x)) for x in (full.max(), full.min())), default=0) <= SAFE
    return full.reshape(len(data), parts, width).astype("i8" if small else object)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return (gap * gap).sum(axis=-1)


def _root(squared: np.ndarray) -> np.ndarray:
    """Square roots as doubles; infinite where a double cannot hold them."""
    if squared.dtype != object:
        return np.sqrt(squared.astype("f8"))
    roots = [math.sqrt(x) if x < 1 << 1000 else math.inf for x in squared.ravel().tolist()]
    return np.array(roots, "f8").reshape(squared.shape)


def choose_pivots(entries: np.ndarray, pivots: int) -> np.ndarray:
    """Per part, entries that are far from each other: each is the farthest from those before it."""
    parts = []
    for book in np.moveaxis(entries, 1, 0):
        taken = [0]
        near = _squared(book, book[0])
        while len(taken) < min(pivots, len(book)):
            taken.append(int(np.argmax(near)))
            near = np.minimum(near, _squared(book, book[taken[-1]]))
        parts.append(book[taken])
    return np.stack(parts, axis=1)


@dataclass
class Codebook:
    """``entries`` and ``pivots`` as (number, part, component)."""

    entries: np.ndarray
    pivots: np.ndarray

    def __post_init__(self) -> None:
        gap = _squared(self.entries[:, None], self.pivots[None])
        self.reach = _root(gap)  # (entry, pivot, part)

    def assign(self, cut: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry (lower index on ties), squared distance and number of exact distances per (row, part).

        ``to_pivots`` has the distances to the pivots as (row, pivot, part).
        """
        n, parts, _ = cut.shape
        number = len(self.entries)
        if cut.dtype != self.entries.dtype:
            cut, entries = cut.astype(object), self.entries.astype(object)
        else:
            entries = self.entries
        bound = np.zeros((n, number, parts))
        for p in range(self.pivots.shape[0]):
            a, b = to_pivots[:, p, None, :], self.reach[None, :, p, :]
            with np.errstate(invalid="ignore"):
                least = np.abs(a - b) - SLACK * (a + b)
            np.maximum(bound, np.where(np.isfinite(least), least, 0.0), out=bound)
        bound = np.moveaxis(bound, 1, 2).reshape(n * parts, number)
        order = np.argsort(bound, axis=1, kind="stable")
        flat, part = cut.reshape(n * parts, -1), np.tile(np.arange(parts), n)
        code = np.zeros(n * parts, "i8")
        best = np.zeros(n * parts, cut.dtype)
        limit = np.full(n * parts, np.inf)
        tried = np.zeros(n * parts, "i4")
        live = np.arange(n * parts)
        for step in range(number):
            entry = order[live, step]
            open_ = bound[live, entry] <= limit[live]
            live, entry = live[open_], entry[open_]
            if not len(live):
                break
            far = _squared(flat[live], entries[entry, part[live]])
            first = tried[live] == 0
            better = first | (far < best[live]) | ((far == best[live]) & (entry < code[live]))
            hit = live[better]
            best[hit], code[hit] = far[better], entry[better]
            # A little above the root, so that rounding never hides a tie.
            limit[hit] = _root(best[hit]) * (1.0 + SLACK)
            tried[live] += 1
        return code.reshape(n, parts), best.reshape(n, parts), tried.reshape(n, parts)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def _whole(values: list[float]) -> list[int]:
    """``floor(SCALE * x)``; exact, as doubles times a power of two and Python's integers are."""
    return [int(np.floor(x * SCALE)) if abs(x) < 1e300 else int(x) * SCALE for x in values]


def _as_integers(column: pa.Array) -> list[list[int]]:
    values = np.asarray(column.flatten(), "f8")
    sizes = np.diff(np.asarray(column.offsets))
    if len(values) and np.abs(values).max() < 2.0**50:
        flat = np.floor(values * SCALE).astype("i8").tolist()
    else:
        flat = _whole(values.tolist())
    ends = np.cumsum(sizes).tolist()
    return [flat[e - s : e] for s, e in zip(sizes.tolist(), ends, strict=True)]


def _pivot_distances(cut: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if cut.dtype != pivots.dtype:
        cut, pivots = cut.astype(object), pivots.astype(object)
    return _root(np.stack([_squared(cut, p) for p in pivots], axis=1))


def _rows(batch: pa.RecordBatch, parts: int) -> tuple[np.ndarray, np.ndarray]:
    cut = _cut(_as_integers(batch.column("v")), parts)
    far = np.asarray(batch.column("to_pivots").flatten(), "f8").reshape(len(cut), -1, parts)
    return cut, far


def _moved(book: Codebook, measured: DataFrame, parts: int) -> Codebook:
    """One round: assign all parts, then set every used entry to the floor of its parts' mean.

    Every batch sends one row per used (part, entry); what reaches the driver is at most one
    row per part and entry.
    """
    shared = measured.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        total: dict[tuple[int, int], list] = {}
        for batch in _batches(batches):
            cut, far = _rows(batch, parts)
            code, _, _ = book.assign(cut, far)
            for part in range(parts):
                for entry in np.unique(code[:, part]).tolist():
                    mine = cut[code[:, part] == entry, part]
                    held = total.setdefault((part, entry), [0, [0] * cut.shape[2]])
                    held[0] += len(mine)
                    held[1] = [a + int(b) for a, b in zip(held[1], mine.sum(axis=0), strict=True)]
        rows = [(part, entry, at, n, str(s)) for (part, entry), (n, sums) in total.items() for at, s in enumerate(sums)]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "entry", "at", "n", "s"])

    sums = measured.select("v", "to_pivots").mapInArrow(run, "part int, entry int, at int, n long, s string")
    # Sums pass as decimal text: 38 digits hold every sum of safe components, Python adds up larger ones.
    wide = F.length("s") > 30
    per = sums.groupBy("part", "entry", "at").agg(
        F.sum("n").alias("n"), F.sum(F.when(~wide, F.col("s").cast("decimal(38,0)"))).alias("s"), F.collect_list(F.when(wide, F.col("s"))).alias("more")
    )
    entries = book.entries.astype(object)
    for r in per.collect():
        entries[r["entry"], r["part"], r["at"]] = (int(r["s"] or 0) + sum(map(int, r["more"]))) // r["n"]
    small = max(abs(int(x)) for x in (entries.max(), entries.min())) <= SAFE
    return Codebook(entries.astype("i8" if small else object), book.pivots)


def digest(entries: np.ndarray, length: int) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, without the filling."""
    width = entries.shape[2]
    listed = [int(x) for part in range(entries.shape[1]) for book in entries[:, part] for at, x in enumerate(book) if part * width + at < length]
    return hashlib.sha256(",".join(map(str, listed)).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    *,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    pivots: int = PIVOTS,
) -> DataFrame:
    """``key, code, error, label_error, codebooks_sha256, tried`` of every usable vector.

    ``tried`` is the number of exact distances of the last assignment (at most parts x
    entries).  Null vectors, vectors with a null, NaN or infinite component and vectors of
    no components are left out; so are vectors of another length than the one with the
    smallest id, since they have no place in its codebooks.  Codebooks start from the
    smallest ids, null ids last; repeated ids count as often as they stand there, in the
    order of their vectors.  With fewer rows than ``entries`` the codebooks are as short.
    Lengths that ``parts`` does not divide are filled up with zeros.  Null labels are one
    label.  An error beyond 64 bits is null, and so is its label's.  An empty table gives an empty one.
    """
    names = {c: fresh(c) for c in ("key", "label")}
    kinds = dict(vectors.dtypes)
    plain = vectors.select(F.col(key).alias(names["key"]), F.col(label).alias(names["label"]), F.col(vector).cast("array<double>").alias("v"))
    kept = usable(plain, "v")
    first = kept.select(F.col(names["key"]).alias("k"), "v").orderBy(F.asc_nulls_last("k"), "v").limit(1).collect()
    out = f"`{key}` {kinds[key]}, code string, error long, label_error long, codebooks_sha256 string, tried int"
    if not first:
        return vectors.sparkSession.createDataFrame([], out)
    length = len(first[0]["v"])
    kept = kept.where(F.size("v") == length)
    # The start of the codebooks: ``entries`` rows, whatever the table's size.
    start = kept.orderBy(F.asc_nulls_last(names["key"]), "v").limit(entries).select("v").collect()
    first_entries = _cut([_whole(r["v"]) for r in start], parts)
    fixed = choose_pivots(first_entries, pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            far = _pivot_distances(_cut(_as_integers(batch.column("v")), parts), fixed)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(far.reshape(len(far), -1).tolist(), pa.list_(pa.float64()))], [*batch.schema.names, "to_pivots"]
            )

    schema = f"`{names['key']}` {kinds[key]}, `{names['label']}` {kinds[label]}, v array<double>, to_pivots array<double>"
    measured = stored(kept.mapInArrow(measure, schema), "code_parts")
    book = Codebook(first_entries, fixed)
    for _ in range(rounds):
        book = _moved(book, measured, parts)
    shared = vectors.sparkSession.sparkContext.broadcast(book)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in _batches(batches):
            cut, far = _rows(batch, parts)
            code, error, tried = book.assign(cut, far)
            sums = [sum(map(int, e)) for e in error.tolist()]
            columns = [
                pa.array(["".join(f"{c:02x}" for c in row) for row in code.tolist()], pa.string()),
                pa.array([s if s < 1 << 63 else None for s in sums], pa.int64()),
                pa.array(tried.sum(axis=1).tolist(), pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(names["key"]), batch.column(names["label"]), *columns], [names["key"], names["label"], "code", "error", "tried"])

    coded = measured.mapInArrow(encode, f"`{names['key']}` {kinds[key]}, `{names['label']}` {kinds[label]}, code string, error long, tried int")
    coded = stored(coded, "codes")
    dropped(measured)
    # Totals are summed before the shuffle and stored, so that their size decides how they are joined.
    totals = coded.groupBy(F.col(names["label"]).alias("_l")).agg(F.when(F.count_if(F.col("error").isNull()) == 0, F.expr("try_sum(error)")).alias("label_error"))
    joined = coded.join(stored(totals, "label_errors"), F.col(names["label"]).eqNullSafe(F.col("_l")), "left")
    return joined.select(F.col(names["key"]).alias(key), "code", "error", "label_error", F.lit(digest(book.entries, length)).alias("codebooks_sha256"), "tried")


def _assignment_sql(books: str, out: str) -> str:
    """SQL for the nearest entry of every part under the codebooks of a table."""
    return f"""
    {out} AS (
      SELECT vec_id, label, part, xs, unnest([arg_min({{'e': entry, 'd': d}}, (d, entry))]) AS hit FROM (
        SELECT p.vec_id, p.label, p.part, p.xs, b.entry,
               list_sum(list_transform(list_zip(p.xs, b.xs), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM parts p JOIN {books} b ON p.part = b.part)
      GROUP BY vec_id, label, part, xs)"""


def _update_sql(books: str, hits: str, out: str) -> str:
    return f"""
    {out} AS (
      SELECT b.part, b.entry, coalesce(m.xs, b.xs) AS xs
      FROM {books} b LEFT JOIN (
        SELECT part, entry, list(x ORDER BY pos) AS xs FROM (
          SELECT part, hit.e AS entry, pos, CAST(floor(sum(xs[pos]) / count(*)) AS BIGINT) AS x
          FROM (SELECT part, hit, xs, unnest(range(1, len(xs) + 1)) AS pos FROM {hits}) GROUP BY part, hit.e, pos)
        GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry)"""


SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS (
  SELECT vec_id, label, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS xs
  FROM (SELECT vec_id, label, v, unnest(range({PARTS})) AS part FROM kept)),
    book0 AS (
  SELECT part, rank - 1 AS entry, xs FROM (SELECT part, xs, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS rank FROM parts)
  WHERE rank <= {ENTRIES}),
{_assignment_sql("book0", "hits0")},{_update_sql("book0", "hits0", "book1")},
{_assignment_sql("book1", "hits1")},{_update_sql("book1", "hits1", "book2")},
{_assignment_sql("book2", "hits2")},
    coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', hit.e), '' ORDER BY part) AS code, CAST(sum(hit.d) AS BIGINT) AS error
  FROM hits2 GROUP BY vec_id, label),
    books AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(range(1, len(xs) + 1)) AS pos, unnest(xs) AS x FROM book2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, books
"""
