"""Registered queries over the test tables, with the SQL that checks them."""

from importlib import import_module

_MODULES = ("descriptive", "preparation", "inference", "learning")


def load_all() -> None:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
