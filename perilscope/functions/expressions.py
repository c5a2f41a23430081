"""Scalar expressions, each ``Column`` in, ``Column`` out.

Everything is built from Spark's own functions and stays inside whole-stage
code generation. Null rules: arithmetic keeps null, a division by zero gives
null, and a lookup miss (null included) gives the stated default.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category codes of the pricing features.
COVERAGE_CODES = {"Min": 1.0, "Med1": 2.0, "Med2": 3.0, "Max": 4.0}
COVERAGE_DEFAULT = 4.0
SEX_CODES = {"M": 0.0, "F": 1.0}
SECOND_DRIVER_CODES = {"0": 0.0, "M": 1.0, "F": 1.0}
SECOND_DRIVER_MALE_CODES = {"0": 0.0, "M": 1.0, "F": 0.0}
DENSITY_FLOOR = 0.01


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def log_floored(x: Column, floor: float = DENSITY_FLOOR) -> Column:
    """``ln(max(x, floor))``. ``greatest`` skips nulls, hence the guard."""
    return F.when(x.isNotNull(), F.ln(F.greatest(x, F.lit(floor))))


def level_code(x: Column, codes: Mapping[str, float], default: float = 0.0) -> Column:
    branches = F
    for level, code in codes.items():
        branches = branches.when(x == level, F.lit(float(code)))
    return branches.otherwise(F.lit(float(default)))


def positive_flag(x: Column) -> Column:
    """1.0 where ``x > 0``, else 0.0; null stays null."""
    return F.when(x > 0, F.lit(1.0)).when(x.isNotNull(), F.lit(0.0))


def equals_flag(x: Column, value: str) -> Column:
    """1.0 where ``x`` equals ``value``, else 0.0; null stays null."""
    return F.when(x == value, F.lit(1.0)).when(x.isNotNull(), F.lit(0.0))


def differs_flag(x: Column, value: str) -> Column:
    return F.when(x != value, F.lit(1.0)).when(x.isNotNull(), F.lit(0.0))


def value_where(x: Column, key: Column, value: str) -> Column:
    return F.when(key == value, x)


def sigmoid(x: Column) -> Column:
    """Logistic function. ``exp`` may overflow to infinity, which gives 0.0, so no
    branch is needed and ``x`` appears only once in the compiled expression."""
    return 1 / (1 + F.exp(-x))


def zscore(x: Column, mean: float | None, std: float | None) -> Column:
    """Standard score. A constant feature (no spread) becomes 0.0."""
    if mean is None or not std:
        return F.when(x.isNotNull(), F.lit(0.0))
    return (x - F.lit(mean)) / F.lit(std)


def level_rank(x: Column, levels: Sequence[str]) -> Column:
    """Position 1..k in an ordered level list; anything else is null."""
    branches = F
    for rank, level in enumerate(levels, 1):
        branches = branches.when(x == level, F.lit(rank))
    return branches


def indicators(x: Column, levels: Sequence[str], prefix: str) -> dict[str, Column]:
    """One 0/1 column per fixed level; an unlisted or null value gives all zeros."""
    return {
        f"{prefix}_{level}": F.when(x == level, F.lit(1.0)).otherwise(F.lit(0.0))
        for level in levels
    }


def keep_levels(x: Column, levels: Sequence[str], other: str = "OTHER") -> Column:
    return F.when(x.isin(list(levels)), x).otherwise(F.lit(other))


def edges_at_or_below(x: Column, edges: Sequence[float]) -> Column:
    """How many of ``edges`` are at or below ``x``; null for null ``x``."""
    if not edges:
        return F.when(x.isNotNull(), F.lit(0))
    hits = [F.when(x >= F.lit(float(edge)), 1).otherwise(0) for edge in edges]
    return F.when(x.isNotNull(), reduce(lambda a, b: a + b, hits))


def linear_score(weights: Mapping[str, float], intercept: float) -> Column:
    terms = [f"`{name}` * {float(weight)!r}D" for name, weight in weights.items()]
    return F.expr(" + ".join([f"{float(intercept)!r}D", *terms]))


def log_loss(z: Column, y: Column) -> Column:
    """Logistic loss of a logit ``z``, without overflow for large ``|z|``."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def poisson_loss(z: Column, y: Column) -> Column:
    """Poisson loss of a log rate ``z``, up to a term without ``z``."""
    return F.exp(z) - z * y


def seeded_hash(seed: int | str, *keys: Column) -> Column:
    """md5 of ``seed:key:...``; the only source of randomness in this library.

    A hash of the row's own key gives the same draw after a retry, on any
    partitioning, and in any engine that has md5.
    """
    parts = [F.lit(str(seed))] + [key.cast("string") for key in keys]
    return F.md5(F.concat_ws(":", *parts))


def hash_number(digest: Column, digits: int = 13) -> Column:
    """The first hex digits of a digest as a bigint."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")
