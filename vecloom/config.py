"""Defaults of a database and their deep merge with what a caller gives."""

from __future__ import annotations

import copy
import os
from typing import Any

#: Default settings; the numbers are fixed values of the data model.
DEFAULTS: dict[str, Any] = {
    "path": None,
    "auto_save": True,
    "vector": {"size": 1536, "k": 10, "metric": "euclidean", "cache_size": 1000, "mismatch_penalty": 0.01},
    "clustering": {"cluster_size": 100, "size_factor": 1.5, "distance_threshold": 0.5, "max_clusters": 1000},
    "partitioning": {"capacity": 100_000, "auto_create": True},
    "hnsw": {"m": 16, "ef_construction": 200, "ef_search": 50},
    "lsh": {"hashes": 10, "tables": 8, "buckets": 1024, "probes": 2},
    "pq": {"subvector_size": 8, "clusters": 256},
    "monitoring": {"window": 1000, "interval_s": 60, "history": 60},
}


def merged(base: dict[str, Any], over: dict[str, Any] | None) -> dict[str, Any]:
    """``base`` with ``over``'s values, section by section at any depth; None leaves a value as it is."""
    out = copy.deepcopy(base)
    for k, v in (over or {}).items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged(out[k], v)
        elif v is not None:
            out[k] = copy.deepcopy(v)
    return out


def config(**over: Any) -> dict[str, Any]:
    """Defaults, then ``VECLOOM_PATH``, then the arguments."""
    return merged(merged(DEFAULTS, {"path": os.environ.get("VECLOOM_PATH")}), over)
