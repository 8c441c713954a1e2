"""Registered queries: one per operator, with the equivalent SQL where there is one."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

SECTIONS = ["ingest", "universe", "signals", "portfolio", "walk", "metrics", "inference", "evidence", "sweep", "streams"]


def load() -> None:
    for name in SECTIONS:
        importlib.import_module(f"{__name__}.{name}")


__all__ = ["ORACLES", "QUERIES", "load"]
