"""Ordering work that must not run in one task.

A window without a partition key, or keyed on a class that holds most rows, puts
the whole table in one task.  The operators here split the order into value
buckets first, total each bucket (a small table), and only then work inside the
buckets, so the largest task handles about 1/``buckets`` of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotgrid.functions.hashing import HASH_RANGE, hash32
from lotgrid.session import cut_lineage

_HASH_BUCKETS = 1 << 16


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def sample_exact(
    df: DataFrame,
    size,
    key: str,
    *,
    seed: int = 0,
    strata: tuple[str, ...] = (),
    hash_buckets: int = _HASH_BUCKETS,
) -> DataFrame:
    """Uniform sample without replacement of exactly min(size, available) rows per stratum.

    ``size`` is a number or a Column over the strata columns.  Rows are ordered by
    a seeded hash of the integer column ``key`` (ties by the key itself), so the
    same rows come back whatever the partitioning.  Counting rows per hash bucket
    finds the bucket where the quota ends; only rows up to it are shuffled, spread
    over (stratum, bucket).
    """
    strata = list(strata)
    width = HASH_RANGE // hash_buckets
    hashed = df.withColumns({"_h": hash32(F.col(key), seed)}).withColumn("_bucket", F.floor(F.col("_h") / width))
    counts = hashed.groupBy(*strata, "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = size if isinstance(size, Column) else F.lit(size)
    # Per bucket: how many of its rows are still wanted.  Bounded: strata x buckets.
    wanted = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        .withColumn("_quota", quota.cast("bigint"))
        .where(F.col("_before") < F.col("_quota"))
        .select(*[F.col(c).alias(f"_s_{c}") for c in strata], F.col("_bucket").alias("_b"), (F.col("_quota") - F.col("_before")).alias("_want"), "_n")
    )
    on = [hashed[c].eqNullSafe(wanted[f"_s_{c}"]) for c in strata] + [hashed["_bucket"] == wanted["_b"]]
    rank = F.row_number().over(Window.partitionBy(*strata, "_bucket").orderBy("_h", key))
    return (
        hashed.join(wanted, _all(on))
        .withColumn("_rank", F.when(F.col("_want") >= F.col("_n"), F.lit(0)).otherwise(rank))
        .where(F.col("_rank") <= F.col("_want"))
        .select(*df.columns)
    )


def hash_positions(df: DataFrame, key: str, *, by: str, seed: int = 0, hash_buckets: int = _HASH_BUCKETS) -> DataFrame:
    """Add ``_pos`` (0-based place in the seeded hash order of the stratum) and ``_size`` of the stratum."""
    hashed = df.withColumn("_h", hash32(F.col(key), seed)).withColumn("_bucket", F.floor(F.col("_h") / (HASH_RANGE // hash_buckets)))
    counts = hashed.groupBy(F.col(by).alias("_s"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_s",
        "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("_s")).alias("_size"),
    )
    inside = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy("_h", key)) - 1
    return (
        hashed.join(offsets, hashed[by].eqNullSafe(offsets["_s"]) & (hashed["_bucket"] == offsets["_b"]))
        .withColumn("_pos", F.col("_before") + inside)
        .select(*df.columns, "_pos", "_size")
    )


def ranged(df: DataFrame, *order: str, name: str = "ordered") -> DataFrame:
    """``df`` stored in ranges of the ``order`` columns; ``_bucket`` numbers the ranges upwards.

    Equal values of all columns share a range.  There are as many ranges as the session has shuffle
    partitions, fewer where adaptive execution finds them small.
    """
    return cut_lineage(df.repartitionByRange(*order).withColumn("_bucket", F.spark_partition_id()), name)


def running_totals(
    df: DataFrame,
    order: str,
    totals: dict[str, str],
    *,
    prior_max: dict[str, str] | None = None,
    by: tuple[str, ...] = (),
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running sums, and maxima over earlier rows, along ``order`` within ``by``.

    ``totals`` and ``prior_max`` map new column -> source column.  (by, order) must
    be unique.  The input is stored in ranges of (by, order), the ranges are totalled, and
    rows are only ordered inside their range: a group that holds everything is shared by
    many tasks, and so are many groups that have the same few values of the order.
    """
    by, prior_max = list(by), prior_max or {}
    sign = F.desc if descending else F.asc
    b = ranged(df, *by, order)
    per_bucket = b.groupBy(*by, "_bucket").agg(
        *[F.sum(src).alias(f"_t_{out}") for out, src in totals.items()],
        *[F.max(src).alias(f"_t_{out}") for out, src in prior_max.items()],
    )
    earlier = Window.partitionBy(*by).orderBy(sign("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *[F.col(c).alias(f"_o_{c}") for c in by],
        F.col("_bucket").alias("_ob"),
        *[F.coalesce(F.sum(f"_t_{out}").over(earlier), F.lit(0)).alias(f"_off_{out}") for out in totals],
        *[F.max(f"_t_{out}").over(earlier).alias(f"_off_{out}") for out in prior_max],
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(sign(order))
    upto, above = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    on = [b[c].eqNullSafe(offsets[f"_o_{c}"]) for c in by] + [b["_bucket"] == offsets["_ob"]]
    return b.join(offsets, _all(on)).select(
        *df.columns,
        *[(F.sum(src).over(upto) + F.col(f"_off_{out}")).alias(out) for out, src in totals.items()],
        *[F.greatest(F.max(src).over(above), F.col(f"_off_{out}")).alias(out) for out, src in prior_max.items()],
    )


def global_row_number(df: DataFrame, order: str, name: str = "row_no") -> DataFrame:
    """1-based position over a unique numeric ``order`` column."""
    return running_totals(df.withColumn("_one", F.lit(1)), order, {name: "_one"}).drop("_one")


def exact_quantiles(df: DataFrame, value: str, probs, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles per group: columns (by, prob, quantile).

    Equal values are merged before anything is ordered, so a constant that fills
    the column costs one row.
    """
    by = list(by)
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return weighted_quantiles(counted, value, "_n", probs, by=tuple(by))


def weighted_quantiles(counted: DataFrame, value: str, count: str, probs, *, by: tuple[str, ...] = (), few: bool = False) -> DataFrame:
    """The same of values that occur ``count`` times each; (by, value) is unique.

    ``few`` says that no group has more distinct values than one task can hold, and saves
    the ranges.
    """
    by = list(by)
    counted = cut_lineage(counted.select(*by, value, F.col(count).alias("_n")), "value-counts")
    if few:
        upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        sized = counted.withColumns({"_upto": F.sum("_n").over(upto), "_size": F.sum("_n").over(Window.partitionBy(*by))})
    else:
        ranked = running_totals(counted, value, {"_upto": "_n"}, by=tuple(by))
        if by:
            sizes = counted.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(F.sum("_n").alias("_size"))
            sized = ranked.join(sizes, _all(ranked[c].eqNullSafe(sizes[f"_g_{c}"]) for c in by))
        else:
            sized = ranked.withColumn("_size", counted.agg(F.sum("_n")).scalar())

    # Rank r (1-based) falls on the value whose ranks (upto - n, upto] contain it.
    def holds(rank: Column) -> Column:
        return (rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_n"))

    def position(prob: Column) -> Column:
        return prob * (F.col("_size") - 1)

    wanted = F.filter(
        F.array(*[F.lit(float(p)) for p in probs]),
        lambda p: holds(F.floor(position(p)) + 1) | holds(F.ceil(position(p)) + 1),
    )
    hits = sized.withColumn("prob", F.explode(wanted)).withColumn("_pos", position(F.col("prob")))
    low = F.max(F.when(holds(F.floor("_pos") + 1), F.col(value)))
    high = F.max(F.when(holds(F.ceil("_pos") + 1), F.col(value)))
    return hits.groupBy(*by, "prob").agg((low + (high - low) * F.max(F.col("_pos") - F.floor("_pos"))).alias("quantile"))


_DIGIT_BITS = 16  # of the 64 bits of a value that one scan looks at


def order_bits(values: np.ndarray) -> np.ndarray:
    """Doubles as 64-bit numbers in the same order; both zeros are one value, NaN comes last."""
    values = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = values.view("u8")
    negative = bits >> np.uint64(63) == 1
    return np.where(negative, ~bits, bits | np.uint64(1 << 63))


def _from_order_bits(bits: int) -> float:
    raw = bits & ((1 << 63) - 1) if bits >> 63 else ~bits & ((1 << 64) - 1)
    return float(np.array([raw], "u8").view("f8")[0])


def column_quantiles(df: DataFrame, columns, probs) -> dict[str, dict[float, float]]:
    """Exact linear-interpolated quantiles of whole columns as driver numbers: {column: {prob: value}}.

    Radix selection: the bits of a value in the order of the values are looked at 16 at a
    time, highest first.  A scan counts, for all columns and wanted ranks together, the next
    digit of the values that share the digits found so far; after four scans every rank's
    value is known to the last bit.  The number of scans depends on nothing else, and the
    driver holds at most 65536 counts per wanted rank.
    """
    columns, probs = list(columns), [float(p) for p in probs]
    values = cut_lineage(df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]), "quantile-columns")
    sizes = values.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(columns))]).first()
    # Per column: 0-based rank -> (digits found so far, rank among the values that share them).
    open_ranks: dict[int, dict[int, tuple[int, int]]] = {}
    for i in range(len(columns)):
        if sizes[i]:
            wanted = {r for p in probs for r in (math.floor(p * (sizes[i] - 1)), math.ceil(p * (sizes[i] - 1)))}
            open_ranks[i] = {r: (0, r) for r in wanted}
    for shift in range(64 - _DIGIT_BITS, -1, -_DIGIT_BITS):
        prefixes = {i: sorted({prefix for prefix, _ in ranks.values()}) for i, ranks in open_ranks.items()}
        counts = _digit_counts(values, prefixes, shift) if prefixes else {}
        for i, ranks in open_ranks.items():
            for rank, (prefix, left) in ranks.items():
                digits, n = counts[i, prefix]
                at = int(np.searchsorted(np.cumsum(n), left, "right"))
                ranks[rank] = (prefix << _DIGIT_BITS | int(digits[at]), left - int(n[:at].sum()))
    out: dict[str, dict[float, float]] = {c: {} for c in columns}
    for i, ranks in open_ranks.items():
        for p in probs:
            at = p * (sizes[i] - 1)
            low, high = (_from_order_bits(ranks[r][0]) for r in (math.floor(at), math.ceil(at)))
            out[columns[i]][p] = low + (high - low) * (at - math.floor(at)) if low != high else low
    return out


def _digit_counts(values: DataFrame, prefixes: dict[int, list[int]], shift: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Counts of the digit above ``shift`` among the values with each of the given higher digits, per column."""
    names = [f"v{i}" for i in prefixes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {(i, k): np.zeros(1 << _DIGIT_BITS, "i8") for i, own in prefixes.items() for k in range(len(own))}
        for batch in batches:
            for i, own in prefixes.items():
                bits = order_bits(batch.column(f"v{i}").drop_null().to_numpy(zero_copy_only=False))
                digit = (bits >> np.uint64(shift)) & np.uint64((1 << _DIGIT_BITS) - 1)
                high = bits >> np.uint64(shift + _DIGIT_BITS) if shift + _DIGIT_BITS < 64 else np.zeros(len(bits), "u8")
                for k, prefix in enumerate(own):
                    total[i, k] += np.bincount(digit[high == np.uint64(prefix)].astype("i8"), minlength=1 << _DIGIT_BITS)
        for (i, k), n in total.items():
            digits = np.flatnonzero(n)
            columns = [pa.array(np.full(len(digits), v), pa.int32()) for v in (i, k)] + [pa.array(digits, pa.int32()), pa.array(n[digits], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["col", "prefix", "digit", "n"])

    counted = values.select(*names).mapInArrow(run, "col int, prefix int, digit int, n long").groupBy("col", "prefix", "digit").agg(F.sum("n").alias("n"))
    merged = counted.groupBy("col", "prefix").agg(F.array_sort(F.collect_list(F.struct("digit", "n"))).alias("c"))
    out = {}
    for r in merged.collect():
        out[r["col"], prefixes[r["col"]][r["prefix"]]] = (np.array([d["digit"] for d in r["c"]]), np.array([d["n"] for d in r["c"]], "i8"))
    return out


def even_subset(df: DataFrame, order: str, size: int) -> DataFrame:
    """``size`` rows evenly spread over the order (first and last included), whole table if smaller."""
    numbered = global_row_number(df, order, "_pos")
    total = numbered.agg(F.max("_pos")).scalar()
    pos, last, steps = F.col("_pos") - 1, total - 1, F.lit(max(size - 1, 1)).cast("bigint")
    # pos is wanted if some i gives i*last div steps = pos; the smallest candidate is ceil(pos*steps/last).
    i = _div(pos * steps + last - 1, F.greatest(last, F.lit(1)))
    return numbered.where((total <= size) | ((i <= size - 1) & (_div(i * last, steps) == pos))).drop("_pos")


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First n rows of the order (a report-sized n)."""
    return df.orderBy(*order).limit(n)


def best_by(df: DataFrame, value: str, score: str, by: tuple[str, ...] = (), alias: str | None = None) -> DataFrame:
    """Value with the highest score per group; the smaller value on ties."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(F.col(score), -F.col(value))).alias(alias or value))


def next_run_id(runs: DataFrame, name: str, width: int = 3) -> DataFrame:
    """Zero-padded successor of the highest all-digit name; the first id when there is none."""
    numeric = F.when(F.col(name).rlike("^[0-9]+$"), F.col(name).try_cast("bigint"))
    following = (F.coalesce(F.max(numeric), F.lit(0)) + 1).cast("string")
    return runs.agg(
        F.when(F.length(following) < width, F.lpad(following, width, "0")).otherwise(following).alias("next_run_id")
    )
