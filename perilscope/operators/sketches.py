"""Mergeable quantile sketches: one small row per group and column, to be stored and added up later.

The sketch of a group does not grow with its rows, so sketches are combined map-side and only they are shuffled;
tables of sketches of days or partitions merge into those of months without a look at the rows. A quantile read from a
sketch has a rank within ``rank_error(accuracy)`` of the wanted one, as a share of the rows, with a probability of 99 %
for each; merging does not add to it. Up to ``accuracy`` values the answer is a value of the column at that rank. Exact
quantiles are in ``quantiles``.

Defined results: null and NaN are left out, NaN counted in ``nans``; infinities are values; a group without values has a
sketch of no values and null quantiles; null group keys are a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 4096


def rank_error(accuracy: int = ACCURACY) -> float:
    """Largest distance, in ranks divided by rows, that is expected of 99 % of answers."""
    return 2.296 / accuracy**0.9723


def quantile_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """``feature``, ``n``, ``nans`` and ``sketch`` of every column, per group."""
    parts = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    known = F.when(~F.isnan("value"), F.col("value"))
    return (
        df.select(*by, F.inline(F.array(*parts))).groupBy(*by, "feature")
        .agg(
            F.count(known).alias("n"), F.count(F.when(F.isnan("value"), 1)).alias("nans"),
            F.kll_sketch_agg_double(known, accuracy).alias("sketch"),
        )
    )


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of larger groups from those of smaller ones."""
    return sketches.groupBy(*by, "feature").agg(
        F.sum("n").alias("n"), F.sum("nans").alias("nans"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """One row per sketch and probability: ``prob`` and ``value``, beside the group, ``feature`` and ``n``."""
    kept = [c for c in sketches.columns if c != "sketch"]
    probs = F.array(*[F.lit(float(p)) for p in probs])
    values = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", probs))
    pairs = F.arrays_zip(probs.alias("prob"), F.coalesce(values, F.transform(probs, lambda _: F.lit(None).cast("double"))).alias("value"))
    return sketches.select(*kept, F.inline(pairs)).toDF(*kept, "prob", "value")
