"""Imports every query module so that ``QUERIES`` is complete."""

from lotgrid.plans import evaluation_queries, ml_queries, parcel_queries, raster_queries, registry_queries, source_queries  # noqa: F401
from lotgrid.plans.registry import QUERIES

__all__ = ["QUERIES"]
