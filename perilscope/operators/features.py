"""Fitted, replayable feature preparation for the event models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilscope.functions import expressions as X

# Model inputs, in vector order.
MODEL_FEATURES = [
    "vh_age", "vh_value", "vh_speed", "vh_weight", "drv_age1",
    "pol_no_claims_discount", "pol_coverage", "density",
    "drv_exp_yrs", "pol_duration", "pol_sit_duration",
    "drv_sex1", "has_drv2", "is_drv2_male",
]


@dataclass
class Layer:
    """Columns computed together, in one projection, from the layer before."""

    name: str
    columns: dict[str, Column]


@dataclass
class FeaturePipeline:
    """An ordered list of layers; run whole or in part.

    Every layer is a projection, so Catalyst folds a whole run into one and only
    the raw columns it needs are read.
    """

    layers: list[Layer]
    features: list[str] = field(default_factory=list)
    statistics: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)

    def transform(self, df: DataFrame, layers: Sequence[int] | slice | None = None) -> DataFrame:
        if layers is None:
            chosen = self.layers
        elif isinstance(layers, slice):
            chosen = self.layers[layers]
        else:
            chosen = [self.layers[i] for i in layers]
        return reduce(lambda out, layer: out.withColumns(layer.columns), chosen, df)

    def parameters(self, spark: SparkSession) -> DataFrame:
        """The fitted values as a table, one row per feature."""
        rows = [(i, name, *self.statistics[name]) for i, name in enumerate(self.features)]
        return spark.createDataFrame(
            rows, "position int, feature string, mean double, std double"
        )

    def save(self, spark: SparkSession, path: str) -> None:
        self.parameters(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> FeaturePipeline:
        rows = spark.read.parquet(path).orderBy("position").collect()
        return _assemble({row["feature"]: (row["mean"], row["std"]) for row in rows})


def derived_columns() -> dict[str, Column]:
    """Codes and ratios computed from the raw policy columns."""
    return {
        "density": X.log_floored(X.ratio(F.col("population"), F.col("town_surface_area"))),
        "pol_coverage": X.level_code(F.col("pol_coverage"), X.COVERAGE_CODES, X.COVERAGE_DEFAULT),
        "drv_sex1": X.level_code(F.col("drv_sex1"), X.SEX_CODES),
        "drv_exp_yrs": F.col("drv_age1") - F.col("drv_age_lic1"),
        "has_drv2": X.level_code(F.col("drv_sex2"), X.SECOND_DRIVER_CODES),
        "is_drv2_male": X.level_code(F.col("drv_sex2"), X.SECOND_DRIVER_MALE_CODES),
    }


def spread_statistics(
    df: DataFrame, columns: Sequence[str]
) -> dict[str, tuple[float | None, float | None]]:
    """Mean and sample standard deviation of every column from one scan, nulls skipped."""
    row = df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"std_{c}") for c in columns],
    ).first()
    return {c: (row[f"mean_{c}"], row[f"std_{c}"]) for c in columns}


def normalised_columns(
    statistics: dict[str, tuple[float | None, float | None]]
) -> dict[str, Column]:
    return {name: X.zscore(F.col(name), mean, std) for name, (mean, std) in statistics.items()}


def zero_filled_columns(columns: Sequence[str]) -> dict[str, Column]:
    """After normalising, 0.0 is the mean: this is mean imputation."""
    return {name: F.coalesce(F.col(name), F.lit(0.0)) for name in columns}


def fit_preprocessing(
    train: DataFrame, features: Sequence[str] = tuple(MODEL_FEATURES)
) -> FeaturePipeline:
    """Derive, normalise and impute; means and spreads come from ``train`` only."""
    derived = train.withColumns(derived_columns())
    return _assemble(spread_statistics(derived, list(features)))


def _assemble(statistics: dict[str, tuple[float | None, float | None]]) -> FeaturePipeline:
    features = list(statistics)
    return FeaturePipeline(
        layers=[
            Layer("derive", derived_columns()),
            Layer("normalise", normalised_columns(statistics)),
            Layer("impute", zero_filled_columns(features)),
        ],
        features=features,
        statistics=statistics,
    )


def feature_matrix(
    df: DataFrame, features: Sequence[str], key: str, target: str | None = None
) -> DataFrame:
    """Named features as one single-precision array column, with an optional target."""
    data = F.array(*[F.col(name).cast("float") for name in features]).alias("data")
    columns = [F.col(key), data]
    if target:
        columns.append(F.col(target).cast("float").alias("target"))
    return df.select(*columns)
