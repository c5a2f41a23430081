"""Score the same rows under changed inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilscope.operators.scoring import Scorer


def overwrite(df: DataFrame, column: str, value: object) -> DataFrame:
    """Set a column to one value, keeping its type."""
    return df.withColumn(column, F.lit(value).cast(df.schema[column].dataType))


def stack_frames(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both frames, columns matched by name."""
    return first.unionByName(second)


def whatif_spread(
    df: DataFrame, column: str, value_a: object, value_b: object, scorer: Scorer
) -> DataFrame:
    """Scores with ``column`` set to A and to B, side by side, and B minus A.

    Both scores are computed on the row itself, so a whole table is monitored
    without grouping its rows back together.
    """
    kept = f"_kept_{column}"
    a = scorer(overwrite(df.withColumn(kept, F.col(column)), column, value_a), "score_a")
    b = scorer(overwrite(a, column, value_b), "score_b")
    return (
        b.withColumn(column, F.col(kept))
        .drop(kept)
        .withColumn("spread", F.col("score_b") - F.col("score_a"))
    )


def whatif_variants(
    df: DataFrame, column: str, values: Sequence[object], scorer: Scorer
) -> DataFrame:
    """Long form: one scored row per input row and value, from one scan."""
    data_type = df.schema[column].dataType
    options = F.array(*[F.lit(v).cast(data_type) for v in values])
    long = df.select(*df.columns, F.posexplode(options).alias("variant", "_value"))
    return scorer(long.withColumn(column, F.col("_value")).drop("_value"), "score")


def variant_spread(variants: DataFrame, key: str, first: int = 0, last: int = 1) -> DataFrame:
    """Difference between two variants of each row of the long form."""
    def score_of(v: int):
        return F.max(F.when(F.col("variant") == v, F.col("score")))

    return variants.groupBy(key).agg((score_of(last) - score_of(first)).alias("spread"))
