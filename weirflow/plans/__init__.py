"""Registered queries, one module per operator family."""

from functools import cache


@cache
def register() -> None:
    from importlib import import_module

    for m in ("match", "graph", "taint", "findings", "text", "engine", "names"):
        import_module(f"weirflow.plans.{m}")
