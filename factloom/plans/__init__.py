"""Queries over the test tables: each operator applied to real inputs, with its SQL twin."""

from __future__ import annotations

from importlib import import_module

from factloom.plans.registry import ORACLES, QUERIES

MODULES = (
    "triples",
    "resolution",
    "numeric",
    "vectors",
    "walks",
    "deep",
    "handmade",
    "evaluation",
    "catalogue",
    "projection",
)
for _name in MODULES:
    import_module(f"factloom.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
