"""Registered queries: one per operator of the inventory, each with a SQL twin."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["anomaly_plans", "header_plans", "series_plans", "split_plans", "local_plans", "eval_plans", "score_plans", "io_plans",
            "roundtrip_plans"]


def all_queries() -> dict:
    out = {}
    for m in _MODULES:
        out.update(import_module(f"{__name__}.{m}").QUERIES)
    return out


def all_oracles() -> dict:
    out = {}
    for m in _MODULES:
        out.update(import_module(f"{__name__}.{m}").ORACLE)
    return out
