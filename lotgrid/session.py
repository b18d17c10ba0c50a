"""Session settings and lineage cutting."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on.  Everything else is left to the cluster.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "lotgrid", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """Build or fetch a session.  ``master`` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share.

    ``spark.checkpoint.dir``, else the folder given to ``setCheckpointDir``, else a folder
    in the warehouse.  A warehouse on a local disk is shared only where the whole session
    runs in one machine, so elsewhere one of the first two has to be set.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        named = context._jsc.sc().getCheckpointDir()
        base = named.get() if named.isDefined() else None
    if not base:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if urlparse(warehouse).scheme in ("", "file") and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{warehouse.rstrip('/')}/scratch"
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table under ``scratch_root``."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to shared storage and return the stored table.

    For a table that several branches of a plan read: it is computed once, survives
    the loss of executors, and is read back with column pruning and known size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
