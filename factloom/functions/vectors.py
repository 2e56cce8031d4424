"""Expressions over ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body uses it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def std_pop(v: Column) -> Column:
    """Population standard deviation of an array."""
    return let(
        mean(v),
        lambda centre: F.sqrt(total(F.transform(v, lambda x: (x - centre) * (x - centre))) / F.size(v)),
    )


def combine(a: Column, b: Column, fn: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, fn)


def add(a: Column, b: Column) -> Column:
    return combine(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return combine(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return combine(a, b, lambda x, y: x * y)


def scale(v: Column, by: Column) -> Column:
    return let(by, lambda factor: F.transform(v, lambda x: x * factor))


def dot(a: Column, b: Column) -> Column:
    return total(multiply(a, b))


def p_norm(v: Column, p: int) -> Column:
    if p == 1:
        return total(F.transform(v, lambda x: F.abs(x)))
    if p == 2:
        return F.sqrt(total(F.transform(v, lambda x: x * x)))
    return F.pow(total(F.transform(v, lambda x: F.pow(F.abs(x), F.lit(float(p))))), F.lit(1.0 / p))


def distance(a: Column, b: Column, p: int) -> Column:
    return p_norm(subtract(a, b), p)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def activate(v: Column, name: str | None) -> Column:
    """Apply the named activation to every element."""
    if name is None:
        return v
    fn = {
        "relu": lambda x: F.greatest(x, F.lit(0.0)),
        "sigmoid": sigmoid,
        "tanh": lambda x: F.tanh(x),
    }[name]
    return F.transform(v, fn)


def matvec(rows: Column, v: Column) -> Column:
    """Product of an ``array<array<double>>`` weight matrix with a vector."""
    return F.transform(rows, lambda row: dot(row, v))
