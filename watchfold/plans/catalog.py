"""All registered queries and their check SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["feature_queries", "detection_queries", "source_queries", "incident_queries", "response_queries", "model_queries", "stream_queries"]


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"{__package__}.{name}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
