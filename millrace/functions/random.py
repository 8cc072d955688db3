"""Randomness that depends on a seed and a position only, so neither partitioning nor retries change it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits(seed: int | str, *path: Column) -> Column:
    """32 hash bits of a seed and a position (or index path), as a long: the first 8 hex digits of an MD5."""
    key = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in path))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(seed: int | str, *path: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """A double in [low, high)."""
    u = bits(seed, *path) / F.lit(4294967296.0)
    return u if (low, high) == (0.0, 1.0) else F.lit(low) + u * F.lit(high - low)


def bernoulli(p: float, seed: int | str, *path: Column) -> Column:
    """True with probability p; 0 and 1 are decided without a draw."""
    return F.lit(p == 1) if p in (0, 1) else uniform(seed, *path) < p


def integer(low: int, high: int, seed: int | str, *path: Column) -> Column:
    """A long from low to high, both included."""
    return F.lit(low) + F.floor(uniform(seed, *path) * (high - low + 1))


def normal(mean: float, deviation: float, seed: int | str, *path: Column) -> Column:
    """A normal variate by the Box-Muller transform."""
    u, v = uniform(f"{seed}:a", *path), uniform(f"{seed}:b", *path)
    return F.lit(mean) + F.lit(deviation) * F.sqrt(-2 * F.log(1 - u)) * F.cos(F.lit(2 * math.pi) * v)


DISTRIBUTIONS = {"uniform": uniform, "bernoulli": bernoulli, "integer": integer, "normal": normal}


def draw(dist: str, params: tuple, seed: int | str, *path: Column) -> Column:
    if dist == "uniform":
        return uniform(seed, *path, **dict(zip(("low", "high"), params, strict=False)))
    return DISTRIBUTIONS[dist](*params, seed, *path)
