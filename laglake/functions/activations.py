"""Scalar activations and their registry (name -> Column function)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def x_plus_sin_sq(x: Column) -> Column:
    return x + F.pow(F.sin(x), 2)


def x_plus_sin(x: Column) -> Column:
    return x + F.sin(x)


def snake(x: Column, alpha: float) -> Column:
    a = float(alpha)
    return x - F.cos(x * (2 * a)) / (2 * a) + F.lit(1.0 / (2 * a))


# Registered activation names and snake frequencies.
ACTIVATIONS = {
    "xsinsquared": x_plus_sin_sq,
    "xsin": x_plus_sin,
    "snake_a.5": lambda x: snake(x, 0.5),
    "snake_a1": lambda x: snake(x, 1.0),
    "snake_a5": lambda x: snake(x, 5.0),
}


def apply_activation(name: str, x: Column) -> Column:
    try:
        return ACTIVATIONS[name](x)
    except KeyError:
        raise ValueError(f"unknown activation {name!r}; known: {sorted(ACTIVATIONS)}") from None
