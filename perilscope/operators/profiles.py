"""Distribution of a column: fixed-width histogram and Gaussian density curve."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilscope.operators.quantiles import exact_quantiles


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Row counts of ``bins`` equal intervals from minimum to maximum.

    Nulls are dropped after grouping: a filter on a computed score would be
    pushed down and have the score computed twice.
    """
    if bins < 1:
        raise ValueError("a histogram needs one interval at least")
    x = F.col(column).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        low = high = 0.0
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    return (
        df.groupBy(place.alias("bin"))
        .agg(F.count(x).alias("n"))
        .where("n > 0")
        .withColumn("lower", F.lit(low) + F.col("bin") * F.lit(width))
        .select("bin", "lower", "n")
        .orderBy("bin")
    )


def _bandwidth(df: DataFrame, column: str, n: int, std: float | None) -> float:
    """Silverman's rule: 0.9 * min(std, IQR / 1.34) * n ** -0.2."""
    if not std:
        return 1.0
    q25, q75 = exact_quantiles(df, [column], [0.25, 0.75])[column]
    return 0.9 * (min(std, (q75 - q25) / 1.34) or std) * n ** -0.2


def kernel_profile(
    df: DataFrame, column: str, points: int = 21, bandwidth: float | None = None
) -> DataFrame:
    """Gaussian kernel density at equally spaced points from minimum to maximum.

    One aggregate with a sum per grid point: no row is multiplied, and each task
    hands over one row. The column is scanned a few times; write it to a table
    first where it is a computed score.
    """
    if points < 2:
        raise ValueError("a curve needs two points at least")
    x = F.col(column).cast("double")
    low, high, n, std = df.agg(F.min(x), F.max(x), F.count(x), F.stddev_samp(x)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "x double, density double")
    h = bandwidth or _bandwidth(df, column, n, std)
    grid = [low + i * (high - low) / (points - 1) for i in range(points)]
    scale = 1 / (h * (2 * math.pi) ** 0.5)
    wide = df.agg(
        *[
            (F.avg(F.exp(-0.5 * ((x - F.lit(g)) / F.lit(h)) ** 2)) * F.lit(scale)).alias(f"d{i}")
            for i, g in enumerate(grid)
        ]
    )
    cells = [
        F.struct(F.lit(g).alias("x"), F.col(f"d{i}").alias("density")) for i, g in enumerate(grid)
    ]
    return wide.select(F.inline(F.array(*cells)))
