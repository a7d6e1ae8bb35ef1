"""All registered queries."""

import importlib

from shardloom.plans.registry import ORACLES, QUERIES

for _part in ("rows", "shards", "loading", "raster", "runs", "streams"):
    importlib.import_module(f"shardloom.plans.catalog_{_part}")

__all__ = ["ORACLES", "QUERIES"]
