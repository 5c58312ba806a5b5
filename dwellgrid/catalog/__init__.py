"""Every registered query, by area."""

from importlib import import_module

AREAS = ["scan", "filters", "segments", "timejoins", "aggregates", "rolling", "scalars", "solves", "detect", "jobs", "hooks", "cross", "streaming"]


def load() -> None:
    for area in AREAS:
        import_module(f"dwellgrid.catalog.{area}")
