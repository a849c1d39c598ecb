"""Registered queries and their equivalent SQL, grouped by area."""

import importlib

AREAS = ("sweep", "stats", "evidence", "trades", "exports", "decisions")


def load() -> None:
    for area in AREAS:
        importlib.import_module(f"catalog.{area}")
