"""Registered queries over the given tables, each next to its SQL oracle."""

from importlib import import_module

MODULES = ("cohort", "tables", "values", "files", "models")


def load_all() -> None:
    """Import every query module, which registers its queries."""
    for name in MODULES:
        import_module(f"dayspan.queries.{name}")
