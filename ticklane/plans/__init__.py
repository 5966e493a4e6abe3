"""Registered queries."""

from __future__ import annotations

_loaded = False


def load_catalog():
    """Names to builders, and names to the SQL used to check them."""
    global _loaded
    from ticklane.plans import catalog, evaluation, price_volume, quality, spot, storage, tables

    if not _loaded:
        for module in (evaluation, price_volume, spot, quality, storage, tables):
            module.register()
        _loaded = True
    return catalog.QUERIES, catalog.SQL
