"""Registered queries and their checking SQL, one module per area."""

from __future__ import annotations

import importlib

_AREAS = (
    "panel_checks", "process_checks", "metric_checks", "product_checks", "text_checks", "spatial_checks", "ingest_checks", "model_checks",
)


def registered() -> dict:
    merged: dict = {}
    for area in _AREAS:
        merged.update(importlib.import_module(f"{__name__}.{area}").QUERIES)
    return merged


def checking_sql() -> dict[str, str]:
    merged: dict[str, str] = {}
    for area in _AREAS:
        merged.update(importlib.import_module(f"{__name__}.{area}").SQL)
    return merged
