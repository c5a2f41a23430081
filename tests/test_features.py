import pytest
from pyspark.sql import functions as F

from perilscope.operators import aggregates as A
from perilscope.operators.design import (
    MAKE_MODEL_LEVELS, DesignMatrix, column_medians, fit_design_matrix, ratio_columns, top_levels,
    NUMERIC_COLUMNS,
)
from perilscope.operators.features import MODEL_FEATURES, FeaturePipeline, feature_matrix, fit_preprocessing
from perilscope.session import job_folder
from perilscope.sources.tables import policies


def test_training_rows_are_centred_and_scaled(fitted_policies):
    df, pipeline = fitted_policies
    full = ["vh_value", "vh_speed", "drv_age1", "pol_duration", "pol_coverage", "has_drv2"]
    train = pipeline.transform(df.where("is_train"))
    row = train.agg(*[F.avg(c) for c in full], *[F.stddev_samp(c) for c in full]).first()
    assert list(row[: len(full)]) == pytest.approx([0.0] * len(full), abs=1e-9)
    assert list(row[len(full):]) == pytest.approx([1.0] * len(full), abs=1e-9)


def test_no_nulls_left_and_zero_area_is_mean(fitted_policies):
    df, pipeline = fitted_policies
    out = pipeline.transform(df)
    nulls = out.agg(*[F.count(F.when(F.col(c).isNull(), 1)) for c in MODEL_FEATURES]).first()
    assert set(nulls) == {0}
    zero = out.where("town_surface_area = 0").select("density").distinct().collect()
    assert [r[0] for r in zero] == [0.0]


def test_slices_compose(fitted_policies):
    df, pipeline = fitted_policies
    whole = pipeline.transform(df).select("id_policy", *MODEL_FEATURES)
    parts = pipeline.transform(pipeline.transform(df, slice(0, 1)), [1, 2])
    assert whole.exceptAll(parts.select("id_policy", *MODEL_FEATURES)).count() == 0


def test_saved_pipeline_gives_the_same_rows(spark, fitted_policies):
    df, pipeline = fitted_policies
    path = job_folder(spark, "pipeline")
    pipeline.save(spark, path)
    again = FeaturePipeline.load(spark, path)
    assert again.statistics == pipeline.statistics
    assert again.features == pipeline.features


def test_constant_and_missing_features(spark):
    df = policies(spark, "/root/testdata/sf0.001").limit(20)
    df = df.withColumn("vh_speed", F.lit(5.0)).withColumn("vh_age", F.lit(None).cast("double"))
    rows = fit_preprocessing(df).transform(df).select("vh_speed", "vh_age").distinct().collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.0)]


def test_feature_matrix_is_single_precision(fitted_policies):
    df, pipeline = fitted_policies
    out = feature_matrix(pipeline.transform(df), MODEL_FEATURES, "id_policy", "event")
    assert out.schema["data"].dataType.simpleString() == "array<float>"
    assert out.columns == ["id_policy", "data", "target"]


def test_design_matrix_has_61_columns_and_fixed_levels(spark, sf_dir):
    df = policies(spark, sf_dir)
    design = fit_design_matrix(df)
    assert len(design.columns) == 61 == len(set(design.columns))
    assert len(MAKE_MODEL_LEVELS) == 20
    out = design.transform(df)
    assert out.count() == df.count()
    # none of the fixture's makes is listed
    assert out.agg(F.min("vh_make_model_OTHER")).first()[0] == 1.0


def test_medians_fill_every_numeric_column(spark, sf_dir):
    df = policies(spark, sf_dir).withColumns(ratio_columns())
    medians = column_medians(df, NUMERIC_COLUMNS)
    assert all(v is not None for v in medians.values())
    design = DesignMatrix(medians, top_levels(df, "vh_make_model"))
    out = design.transform(policies(spark, sf_dir))
    nulls = out.agg(*[F.count(F.when(F.col(c).isNull(), 1)) for c in NUMERIC_COLUMNS]).first()
    assert set(nulls) == {0}


def test_top_levels_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "v string")
    assert top_levels(df, "v", 2) == ["c", "a"]


def test_group_statistics_keep_rows_and_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0)], "g string, x double")
    rows = A.with_group_statistics(df, "g", mean=F.avg("x")).collect()
    assert sorted((r["x"], r["mean"]) for r in rows) == [(1.0, 2.0), (3.0, 2.0), (5.0, 6.0), (7.0, 6.0)]


def test_best_setting_breaks_ties(spark):
    df = spark.createDataFrame([(3, 0.5), (2, 0.4), (1, 0.4)], "s int, m double")
    assert [tuple(r) for r in A.best_setting(df, "s", "m").collect()] == [(1, 0.4)]
