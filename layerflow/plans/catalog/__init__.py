"""The query catalog: importing it registers every query."""

from layerflow.plans.catalog import columns, lineage, quality, refresh, runs, tables
from layerflow.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "columns", "lineage", "quality", "refresh", "runs", "tables"]
