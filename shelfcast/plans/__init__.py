"""Layers, sessions and the catalog of named queries."""

from __future__ import annotations


def all_queries() -> dict:
    from shelfcast.plans import (  # noqa: F401
        forecast_queries, mart_queries, quality_queries, source_queries, staging_queries, stream_queries)
    from shelfcast.plans.catalog import CATALOG

    return dict(CATALOG)
