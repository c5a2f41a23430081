import math

import pytest
from pyspark.sql import functions as F

from perilscope.functions import expressions as X


def values(df, column):
    return [row[0] for row in df.select(column).collect()]


def test_ratio_by_zero_is_null(spark):
    df = spark.createDataFrame([(10.0, 0.0), (10.0, 4.0), (None, 4.0)], "a double, b double")
    assert values(df, X.ratio(F.col("a"), F.col("b"))) == [None, 2.5, None]


def test_floor_keeps_null(spark):
    df = spark.createDataFrame([(None,), (0.0,), (math.e,)], "x double")
    got = values(df, X.log_floored(F.col("x")))
    assert got[0] is None
    assert got[1:] == pytest.approx([math.log(0.01), 1.0])


def test_level_codes_have_defaults(spark):
    df = spark.createDataFrame([("Min",), ("Max",), ("Gold",), (None,)], "c string")
    code = X.level_code(F.col("c"), X.COVERAGE_CODES, X.COVERAGE_DEFAULT)
    assert values(df, code) == [1.0, 4.0, 4.0, 4.0]
    sexes = spark.createDataFrame([("M",), ("F",), ("U",), (None,)], "c string")
    assert values(sexes, X.level_code(F.col("c"), X.SEX_CODES)) == [0.0, 1.0, 0.0, 0.0]


def test_flags_keep_null(spark):
    df = spark.createDataFrame([(0.0,), (3.0,), (None,)], "x double")
    assert values(df, X.positive_flag(F.col("x"))) == [0.0, 1.0, None]
    text = spark.createDataFrame([("Yes",), ("No",), (None,)], "x string")
    assert values(text, X.equals_flag(F.col("x"), "Yes")) == [1.0, 0.0, None]
    assert values(text, X.differs_flag(F.col("x"), "Yes")) == [0.0, 1.0, None]


def test_level_rank_and_indicators(spark):
    df = spark.createDataFrame([("F",), ("M",), ("U",), (None,)], "x string")
    assert values(df, X.level_rank(F.col("x"), ["F", "M"])) == [1, 2, None, None]
    hot = X.indicators(F.col("x"), ["F", "M"], "x")
    assert values(df, hot["x_F"]) == [1.0, 0.0, 0.0, 0.0]
    kept = X.keep_levels(F.col("x"), ["F"])
    assert values(df, kept) == ["F", "OTHER", "OTHER", "OTHER"]


def test_sigmoid_and_losses_at_extremes(spark):
    df = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "z double")
    assert values(df, X.sigmoid(F.col("z"))) == [0.0, 0.5, 1.0]
    assert values(df, X.log_loss(F.col("z"), F.lit(1.0))) == pytest.approx([800.0, math.log(2), 0.0])


def test_constant_feature_becomes_zero(spark):
    df = spark.createDataFrame([(5.0,), (None,)], "x double")
    assert values(df, X.zscore(F.col("x"), 5.0, 0.0)) == [0.0, None]
    assert values(df, X.zscore(F.col("x"), 5.0, None)) == [0.0, None]
