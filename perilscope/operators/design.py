"""The 61-column design matrix of the frequency and severity models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilscope.functions import expressions as X
from perilscope.operators.quantiles import exact_quantiles

# Numeric columns (median-imputed), ordered levels, one-hot levels
# and the 20 make/model levels that get a column of their own.
NUMERIC_COLUMNS = [
    "density", "year", "pol_no_claims_discount", "pol_duration", "pol_sit_duration",
    "drv_age1", "drv_age_lic1", "vh_age", "vh_speed", "vh_value", "vh_weight",
    "has_drv2", "is_drv2_male", "vh_type_commercial",
    "drv_age2", "drv_age_lic2", "is_pol_payd", "drv_age1_male", "drv_age1_age2_diff",
    "population", "town_surface_area", "vh_value_div_weight",
]
COVERAGE_LEVELS = ["Min", "Med1", "Med2", "Max"]
PAY_FREQ_LEVELS = ["Monthly", "Quarterly", "Biannual", "Yearly"]
SEX_LEVELS = ["F", "M"]
USAGE_LEVELS = ["AllTrips", "Professional", "Retired", "WorkPrivate"]
FUEL_LEVELS = ["Diesel", "Gasoline", "Hybrid"]
MAKE_MODEL_LEVELS = [
    "zoypfizhpbtpjwpv", "xkzehzohmfrsmolg", "iulvirmzdntweaee", "kvcddisqpkysmvvo",
    "prtnwsypyfnshpqx", "aparvvfowrjncdhp", "xjaddkudsebowzen", "ponwkmeaxagundzq",
    "zqruwnlzuefcpqjm", "kzwthrslljkmbqur", "iwhqpdfuhrsxyqxe", "jjycmklnkdivnypu",
    "svmjzfcsvgxiwwjt", "hselphnqlvecmmyx", "lqkdgbosdzrtitgx", "tdgkjlphosocwbgu",
    "swjkmyqytzxjwgag", "biqzvbfzjivqmrro", "johsjccpkithubii", "rthsjeyjgdlmkygk",
]
OTHER = "OTHER"


def ratio_columns() -> dict[str, Column]:
    """Derived numeric columns; here null inputs give null, imputed later."""
    return {
        "density": X.ratio(F.col("population"), F.col("town_surface_area")),
        "has_drv2": X.differs_flag(F.col("drv_sex2"), "0"),
        "is_drv2_male": X.equals_flag(F.col("drv_sex2"), "M"),
        "vh_type_commercial": X.equals_flag(F.col("vh_type"), "Commercial"),
        "is_pol_payd": X.equals_flag(F.col("pol_payd"), "Yes"),
        "drv_age1_male": X.value_where(F.col("drv_age1"), F.col("drv_sex1"), "M"),
        "drv_age1_age2_diff": F.col("drv_age1") - F.col("drv_age2"),
        "vh_value_div_weight": X.ratio(F.col("vh_value"), F.col("vh_weight")),
    }


def ordinal_columns() -> dict[str, Column]:
    return {
        "pol_coverage_fac": X.level_rank(F.col("pol_coverage"), COVERAGE_LEVELS),
        "pol_pay_freq_fac": X.level_rank(F.col("pol_pay_freq"), PAY_FREQ_LEVELS),
        "drv_sex1_fac": X.level_rank(F.col("drv_sex1"), SEX_LEVELS),
    }


def one_hot_columns() -> dict[str, Column]:
    return {
        **X.indicators(F.col("pol_usage"), USAGE_LEVELS, "pol_usage"),
        **X.indicators(F.col("vh_fuel"), FUEL_LEVELS, "vh_fuel"),
        **X.indicators(F.col("pol_coverage"), COVERAGE_LEVELS, "pol_coverage"),
        **X.indicators(F.col("pol_pay_freq"), PAY_FREQ_LEVELS, "pol_pay_freq"),
    }


def make_model_columns(levels: Sequence[str]) -> dict[str, Column]:
    """One 0/1 column per level and one for all others. The level's place is found once, by a higher-order function:
    beside one, Spark compiles a projection in small methods; as one method it is too long for the JVM's compiler."""
    known = [*levels, OTHER]
    kept = X.keep_levels(F.col("vh_make_model"), levels, OTHER)
    place = F.transform(F.array(kept), lambda level: F.array_position(F.array(*map(F.lit, known)), level))[0]
    return {f"vh_make_model_{level}": F.when(place == known.index(level) + 1, F.lit(1.0)).otherwise(F.lit(0.0)) for level in known}


def top_levels(df: DataFrame, column: str, k: int = 20) -> list[str]:
    """The ``k`` most frequent levels, most frequent first, names breaking ties."""
    rows = (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .count()
        .orderBy(F.desc("count"), column)
        .limit(k)
        .collect()
    )
    return [row[column] for row in rows]


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: v and v[0] for c, v in exact_quantiles(df, columns, [0.5]).items()}


def impute(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    return df.withColumns(
        {
            c: F.coalesce(F.col(c).cast("double"), F.lit(v).cast("double"))
            for c, v in values.items()
        }
    )


@dataclass
class DesignMatrix:
    """Fitted medians and levels; ``transform`` is a projection."""

    medians: dict[str, float | None]
    make_model_levels: list[str]

    @property
    def columns(self) -> list[str]:
        return [
            *NUMERIC_COLUMNS,
            *ordinal_columns(),
            *one_hot_columns(),
            *make_model_columns(self.make_model_levels),
        ]

    def transform(self, df: DataFrame, keep: Sequence[str] = ("id_policy",)) -> DataFrame:
        encoded = impute(df.withColumns(ratio_columns()), self.medians)
        return encoded.select(
            *keep,
            *NUMERIC_COLUMNS,
            *[c.alias(name) for name, c in ordinal_columns().items()],
            *[c.alias(name) for name, c in one_hot_columns().items()],
            *[c.alias(name) for name, c in make_model_columns(self.make_model_levels).items()],
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """Medians and kept levels as one small table."""
        rows = [("median", i, c, self.medians[c]) for i, c in enumerate(NUMERIC_COLUMNS)]
        rows += [("level", i, level, None) for i, level in enumerate(self.make_model_levels)]
        table = spark.createDataFrame(rows, "kind string, position int, name string, value double")
        table.coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> DesignMatrix:
        rows = spark.read.parquet(path).orderBy("position").collect()
        return DesignMatrix(
            {row["name"]: row["value"] for row in rows if row["kind"] == "median"},
            [row["name"] for row in rows if row["kind"] == "level"],
        )

    def vectors_ready(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``transform`` with unlisted ordered levels as 0, for models without nulls."""
        return self.transform(df, keep).fillna(0, subset=list(ordinal_columns()))


def fit_design_matrix(
    df: DataFrame, make_model_levels: Sequence[str] | None = tuple(MAKE_MODEL_LEVELS)
) -> DesignMatrix:
    """Medians from ``df``; levels as given, or its 20 most frequent if None."""
    levels = (
        top_levels(df, "vh_make_model") if make_model_levels is None else list(make_model_levels)
    )
    return DesignMatrix(column_medians(df.withColumns(ratio_columns()), NUMERIC_COLUMNS), levels)
