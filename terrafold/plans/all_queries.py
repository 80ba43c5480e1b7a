"""Imports every module that registers queries."""

from importlib import import_module

MODULES = ["catalog_queries", "retrieval_queries", "pixel_queries", "text_queries", "scalar_queries", "variant_queries"]


def load() -> None:
    for name in MODULES:
        import_module(f"terrafold.plans.{name}")
