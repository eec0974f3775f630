"""Queries of the training-data operators, by name, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = {
    "p1_subset": ("p1_subset",),
    "p2_knn": ("p2_found", "p2_knn", "p2_recall"),
    "p3_clusters": ("p3_found", "p3_clusters"),
    "p4_top_n": ("p4_found", "p4_topn"),
    "p5_near_duplicates": ("p5_found", "p5_groups"),
    "p6_rank_fusion": ("p6_found", "p6_ranking"),
    "p7_encode": ("p7_ids",),
    "p8_containers": ("p8_containers",),
    "p9_spans": ("p9_found", "p9_shared"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for module, names in _MODULES.items() for name in names}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _MODULES:
        out |= getattr(import_module(f"{__package__}.{module}"), "SQL", {})
    return out
