"""Limits and switches, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of the comparison; every operator that needs one takes a config."""

    items_per_store: int = 24
    aliases_with_plan: int = 6
    aliases_without_plan: int = 4
    search_queries: int = 6
    variants: int = 16
    cache_ttl_s: int = 1800
    plan_ttl_s: int = 2_592_000
    rate_limit: int = 80
    rate_window_s: int = 60
    popular: int = 12
    popular_most: int = 50
    page_size: int = 15
    list_items: int = 10
    related: int = 24
    normalize_cents: bool = False
    cents_threshold: float = 100_000.0


DEFAULT = EngineConfig()
