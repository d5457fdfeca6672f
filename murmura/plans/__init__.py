"""Registered queries over the benchmark tables and their SQL oracles."""

from __future__ import annotations

from importlib import import_module

from murmura.plans.registry import ORACLES, QUERIES

_MODULES = ("quality", "drift", "basic", "clustering", "sinks")


def _load() -> None:
    for name in _MODULES:
        import_module(f"murmura.plans.{name}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
