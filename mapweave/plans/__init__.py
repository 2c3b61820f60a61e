"""Queries over the given tables, one module per area."""

import importlib

AREAS = (
    "urls", "sources", "pages", "sessions", "formulation", "text", "expansion", "networks", "compare",
    "temporal", "hygiene", "streaming",
)


def load_all() -> None:
    for area in AREAS:
        importlib.import_module(f"mapweave.plans.{area}")
