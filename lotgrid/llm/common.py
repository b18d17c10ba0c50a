"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

from lotgrid.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back, so that later steps do not repeat the work."""
    return cut_lineage(df, name)


def fresh(prefix: str) -> str:
    """A column name that no input column has."""
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"


def dropped(*tables: DataFrame) -> None:
    """Delete intermediate tables that nothing reads any more, and let go of finished shuffles.

    Shuffle files go when the driver collects the garbage of finished queries, which on a
    quiet driver may take half an hour; asking for it keeps executor disks free.
    """
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def released(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished queries that nothing refers to any more.

    The first collection only finds that Python has let go of a plan; the second finds the
    plan's shuffles.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def trimmed() -> None:
    """Give memory that finished parts left free in a Python worker back to the machine; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def text_parts(lengths: list[int], rows: int, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Start and number of rows of parts of at most ``rows`` rows and ``size`` bytes; a longer text is a part alone."""
    start = held = 0
    for k, n in enumerate(lengths):
        if k > start and (k - start == rows or held + n > size):
            yield start, k - start
            start, held = k, 0
        held += n
    if len(lengths) > start:
        yield start, len(lengths) - start


def byte_lengths(texts: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def map_texts(
    df: DataFrame,
    keep: list[str],
    text: str,
    made: dict[str, tuple[str, pa.DataType]],
    work: Callable[[list[str | None]], tuple[list[int] | None, dict[str, list]]],
    at_once: int = 256,
    bytes_at_once: int = 1 << 20,
) -> DataFrame:
    """Run ``work`` over the texts of ``df``, at most ``at_once`` rows and ``bytes_at_once`` bytes at a time.

    ``work`` returns the columns of ``made`` (name to Spark and Arrow type) and, unless there
    is one output row per text, the text's position for every output row.  The ``keep``
    columns pass through Arrow untouched, so that ids keep all their digits beside nulls.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{c}` {k}" for c, (k, _) in made.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, count in text_parts(byte_lengths(whole.column(text)), at_once, bytes_at_once):
                batch = whole.slice(start, count)
                rows, columns = work(batch.column(text).to_pylist())
                kept = [batch.column(c) if rows is None else batch.column(c).take(pa.array(rows, pa.int64())) for c in keep]
                new = [pa.array(columns[c], kind) for c, (_, kind) in made.items()]
                yield pa.RecordBatch.from_arrays([*kept, *new], [*keep, *made])
        trimmed()

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def pack_integers(values: np.ndarray) -> bytes:
    """Integers as compressed bytes, low bytes of all first, which compresses small numbers well."""
    values = np.ascontiguousarray(values)
    planes = values.view("u1").reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(values.dtype.char.encode() + planes.tobytes())


def unpack_integers(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    kind = np.dtype(raw[:1].decode())
    planes = np.frombuffer(raw, "u1", offset=1).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def small_integers(values: np.ndarray) -> np.ndarray:
    """Non-negative integers in 32 bits where they fit."""
    return values.astype("u4") if not len(values) or values.max() < 1 << 32 else values.astype("u8")
