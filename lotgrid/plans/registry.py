"""Query registry: each query keeps its Spark plan and its SQL check together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lotgrid.plans.inputs import Inputs
from lotgrid.plans.sql_views import with_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Inputs], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Inputs(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query; ``views`` names the shared SQL views its check needs."""

    def register(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, build, with_views(views.split(), sql) if sql else None)
        return build

    return register
