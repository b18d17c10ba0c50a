"""Additive totals per key, kept as a base table and the deltas of micro-batches.

A micro-batch stores its own totals in a folder named by the stream and the batch, so a
replayed batch replaces itself and two streams never meet.  Compaction adds finished deltas
to a new base and then names both in a new manifest; readers take the newest manifest, its
base and the deltas that it does not name.  Nothing that a reader may be reading is
overwritten, and a failure between any two steps leaves the table as it was.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Totals:
    """Sums of ``sums`` columns per ``keys`` under the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], sums: list[str]):
        self.spark, self.path, self.keys, self.sums = spark, path.rstrip("/"), list(keys), list(sums)
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where = self._hadoop.Path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def _finished(self, folder: str) -> bool:
        return self._fs.exists(self._hadoop.Path(f"{self.path}/{folder}/_SUCCESS"))

    def _added(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums])

    def upsert(self, batch: DataFrame, stream: str, number: int) -> None:
        """Store the totals of one micro-batch; the same batch again changes nothing."""
        self._added(batch).write.mode("overwrite").parquet(f"{self.path}/delta/{stream}-{number}")

    def manifest(self) -> dict:
        """The newest manifest: its number, the base folder (none at first) and the deltas that are in the base."""
        numbers = [int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json")]
        if not numbers:
            return {"number": 0, "base": None, "merged": []}
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/manifest/{max(numbers)}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _open_deltas(self, manifest: dict) -> list[str]:
        merged = set(manifest["merged"])
        return [d for d in self._names("delta") if d not in merged and self._finished(f"delta/{d}")]

    def _read(self, manifest: dict, deltas: list[str]) -> DataFrame | None:
        folders = ([manifest["base"]] if manifest["base"] else []) + [f"delta/{d}" for d in deltas]
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders]) if folders else None

    def read(self) -> DataFrame | None:
        """Totals of everything finished so far; None before the first batch."""
        manifest = self.manifest()
        rows = self._read(manifest, self._open_deltas(manifest))
        return None if rows is None else self._added(rows)

    def compact(self) -> bool:
        """Add the finished deltas to a new base and switch to it; False if there was nothing to add.

        Of two compactions at once the second one to name its manifest gives up.
        """
        manifest = self.manifest()
        deltas = self._open_deltas(manifest)
        if not deltas:
            return False
        number = manifest["number"] + 1
        base = f"base/{number}-{self.spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
        self._added(self._read(manifest, deltas)).write.parquet(f"{self.path}/{base}")
        text = json.dumps({"number": number, "base": base, "merged": sorted({*manifest["merged"], *deltas})})
        draft, final = (self._hadoop.Path(f"{self.path}/manifest/{n}") for n in (f"{number}-{base.split('/')[1]}.draft", f"{number}.json"))
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        # A rename is one step, and fails where the number is taken.
        return not self._fs.exists(final) and self._fs.rename(draft, final)


def store_batches(totals: Totals, partial: Callable[[DataFrame], DataFrame], *, compact_every: int = 100) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that stores ``partial(batch)`` and now and then compacts.

    The stream's own id, which its checkpoint keeps over restarts, names its batches.
    """

    def store(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        totals.upsert(partial(batch), stream, number)
        if number % compact_every == compact_every - 1:
            totals.compact()

    return store
