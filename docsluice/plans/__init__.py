"""Registered queries, by area; each module registers on import."""

from __future__ import annotations

import importlib

AREAS = ("aggregates", "windows", "filters", "topk", "joins", "scalars", "graph_streams", "mentions")


def load() -> None:
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
