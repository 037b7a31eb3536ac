"""Queries over the shared test tables, each with its check in plain SQL."""

from __future__ import annotations

import importlib

MODULES = ("history_queries", "model_queries", "ingest_queries", "market_queries", "audit_queries", "stream_queries", "storage_queries")


def _load():
    for name in MODULES:
        importlib.import_module(f"cutline.workload.{name}")
    return importlib.import_module("cutline.workload.catalog")


def queries() -> dict:
    return dict(_load().QUERIES)


def checks() -> dict[str, str]:
    return dict(_load().CHECKS)
