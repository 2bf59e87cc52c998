"""Every registered query with its SQL oracle, one module per operator family."""

from __future__ import annotations

from importlib import import_module

from panelworks.catalogue.registry import ORACLES, QUERIES, Query

FAMILIES = ("rows", "joins", "grouped", "series", "scores", "graphs", "forecasts", "streams")


def _load() -> None:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")


def all_queries() -> dict[str, Query]:
    """Name to query."""
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    """Name to SQL text."""
    _load()
    return dict(ORACLES)
