"""Queries over fitted preprocessing and the design matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from perilscope.functions import expressions as X
from perilscope.operators import design as D
from perilscope.operators.features import (
    MODEL_FEATURES, FeaturePipeline, feature_matrix, fit_preprocessing, spread_statistics,
    normalised_columns, zero_filled_columns,
)
from perilscope.operators.profiles import kernel_profile
from perilscope.plans.catalog import (
    PREPARED, STATISTICS, fitted, labelled, query, rounded, select_policies, split_policies,
    with_policies,
)
from perilscope.session import job_folder
from perilscope.sources.tables import policies

SOME = ["vh_age", "vh_value", "vh_weight", "drv_age1"]
MAKES = [f"MAKE{i}" for i in range(20)]


def _r(names, places=6):
    return ", ".join(f"round({c}, {places}) as {c}" for c in names)


@query("normalise", select_policies(
    "select id_policy, " + ", ".join(
        f"round(({c} - avg({c}) over ()) / nullif(stddev_samp({c}) over (), 0), 6) as {c}" for c in SOME)
    + " from policies"))
def normalise(spark, sf_dir):
    df = policies(spark, sf_dir).select("id_policy", *SOME)
    return rounded(df.withColumns(normalised_columns(spread_statistics(df, SOME))), *SOME)


@query("impute_mean", select_policies(
    "select id_policy, " + ", ".join(
        f"round(coalesce(({c} - avg({c}) over ()) / nullif(stddev_samp({c}) over (), 0), 0), 6) as {c}"
        for c in SOME) + " from policies"))
def impute_mean(spark, sf_dir):
    df = policies(spark, sf_dir).select("id_policy", *SOME)
    normal = df.withColumns(normalised_columns(spread_statistics(df, SOME)))
    return rounded(normal.withColumns(zero_filled_columns(SOME)), *SOME)


@query("preprocess_full", with_policies(
    PREPARED + f"\nselect id_policy, is_train, {_r(MODEL_FEATURES)} from prepared"))
def preprocess_full(spark, sf_dir):
    df, pipeline = fitted(spark, sf_dir)
    out = pipeline.transform(df).select("id_policy", "is_train", *MODEL_FEATURES)
    return rounded(out, *MODEL_FEATURES)


@query("pipeline_slice", with_policies(
    STATISTICS + f"\nselect id_policy, {_r(MODEL_FEATURES)} from derived"))
def pipeline_slice(spark, sf_dir):
    df = split_policies(spark, sf_dir)
    pipeline = fit_preprocessing(df.where("is_train"))
    out = pipeline.transform(df, layers=slice(0, 1)).select("id_policy", *MODEL_FEATURES)
    return rounded(out, *MODEL_FEATURES)


_PARAMETERS = "\nunion all ".join(
    f"select {i} as position, '{f}' as feature, round(mean_{f}, 6) as mean, round(std_{f}, 6) as std from stats"
    for i, f in enumerate(MODEL_FEATURES)
)


@query("parameters_roundtrip", with_policies(STATISTICS + "\n" + _PARAMETERS))
def parameters_roundtrip(spark, sf_dir):
    _, pipeline = fitted(spark, sf_dir)
    path = job_folder(spark, "preprocessing")
    pipeline.save(spark, path)
    return rounded(FeaturePipeline.load(spark, path).parameters(spark), "mean", "std")


@query("feature_matrix", with_policies(PREPARED + f"""
select id_policy, cast(event as double) as target, {len(MODEL_FEATURES)} as n_features,
  {", ".join(f"round(cast(cast({f} as float) as double), 5) as x{i}" for i, f in enumerate(MODEL_FEATURES))}
from prepared"""))
def matrix(spark, sf_dir):
    df, pipeline = fitted(spark, sf_dir)
    out = feature_matrix(pipeline.transform(df), MODEL_FEATURES, "id_policy", "event")
    return out.select(
        "id_policy",
        F.col("target").cast("double").alias("target"),
        F.size("data").alias("n_features"),
        *[
            F.round(F.col("data")[i].cast("double"), 5).alias(f"x{i}")
            for i in range(len(MODEL_FEATURES))
        ],
    )


@query("kernel_after_preprocessing", with_policies(PREPARED + """,
params as (select min(vh_age) as lo, max(vh_age) as hi,
  0.9 * least(stddev_samp(vh_age), (quantile_cont(vh_age, 0.75) - quantile_cont(vh_age, 0.25)) / 1.34)
  * power(cast(count(vh_age) as double), -0.2) as h from prepared where is_train),
grid as (select lo + i * (hi - lo) / 20 as x, h from params, range(21) t(i))
select round(x, 6) as x,
  round(avg(exp(-0.5 * power((vh_age - x) / h, 2))) / (h * sqrt(2 * pi())), 6) as density
from prepared, grid where is_train group by x, h"""))
def kernel_after_preprocessing(spark, sf_dir):
    df, pipeline = fitted(spark, sf_dir)
    train = pipeline.transform(df.where("is_train"))
    return rounded(kernel_profile(train, "vh_age", 21), "x", "density")


# --- design matrix ----------------------------------------------------------------

RATIOS_SQL = """,
ratios as (select id_policy, pol_coverage, pol_pay_freq, drv_sex1, pol_usage, vh_fuel, vh_make_model,
  population / nullif(town_surface_area, 0) as density, cast(year as double) as year,
  pol_no_claims_discount, pol_duration, pol_sit_duration, drv_age1, drv_age_lic1, vh_age, vh_speed,
  vh_value, vh_weight,
  case when drv_sex2 <> '0' then cast(1 as double) when drv_sex2 is not null then 0 end as has_drv2,
  case when drv_sex2 = 'M' then cast(1 as double) when drv_sex2 is not null then 0 end as is_drv2_male,
  case when vh_type = 'Commercial' then cast(1 as double) when vh_type is not null then 0 end as vh_type_commercial,
  drv_age2, drv_age_lic2,
  case when pol_payd = 'Yes' then cast(1 as double) when pol_payd is not null then 0 end as is_pol_payd,
  case when drv_sex1 = 'M' then drv_age1 end as drv_age1_male,
  drv_age1 - drv_age2 as drv_age1_age2_diff, population, town_surface_area,
  vh_value / nullif(vh_weight, 0) as vh_value_div_weight from policies)"""

_MEDIANS = ", ".join(f"quantile_cont({c}, 0.5) as med_{c}" for c in D.NUMERIC_COLUMNS)
_IMPUTED = ", ".join(f"round(coalesce({c}, med_{c}), 6) as {c}" for c in D.NUMERIC_COLUMNS)
IMPUTED_SQL = RATIOS_SQL + f",\nmedians as (select {_MEDIANS} from ratios)"


def _rank_sql(column, levels):
    branches = " ".join(f"when '{v}' then {i}" for i, v in enumerate(levels, 1))
    return f"case {column} {branches} end as {column}_fac"


def _hot_sql(column, levels):
    return ", ".join(
        f"case when {column} = '{v}' then cast(1 as double) else 0 end as {column}_{v}" for v in levels
    )


def _make_sql(levels):
    listed = ", ".join(f"'{v}'" for v in levels)
    other = f"case when vh_make_model in ({listed}) then cast(0 as double) else 1 end as vh_make_model_OTHER"
    return _hot_sql("vh_make_model", levels) + ", " + other


ORDINAL_SQL = ", ".join([
    _rank_sql("pol_coverage", D.COVERAGE_LEVELS),
    _rank_sql("pol_pay_freq", D.PAY_FREQ_LEVELS),
    _rank_sql("drv_sex1", D.SEX_LEVELS),
])
ONE_HOT_SQL = ", ".join([
    _hot_sql("pol_usage", D.USAGE_LEVELS), _hot_sql("vh_fuel", D.FUEL_LEVELS),
    _hot_sql("pol_coverage", D.COVERAGE_LEVELS), _hot_sql("pol_pay_freq", D.PAY_FREQ_LEVELS),
])


@query("impute_median", with_policies(
    IMPUTED_SQL + f"\nselect id_policy, {_IMPUTED} from ratios, medians"))
def impute_median(spark, sf_dir):
    df = policies(spark, sf_dir).withColumns(D.ratio_columns())
    filled = D.impute(df, D.column_medians(df, D.NUMERIC_COLUMNS))
    return rounded(filled.select("id_policy", *D.NUMERIC_COLUMNS), *D.NUMERIC_COLUMNS)


@query("ordinal_encode", select_policies(f"select id_policy, {ORDINAL_SQL} from policies"))
def ordinal_encode(spark, sf_dir):
    columns = [c.alias(name) for name, c in D.ordinal_columns().items()]
    return policies(spark, sf_dir).select("id_policy", *columns)


@query("one_hot", select_policies(f"select id_policy, {ONE_HOT_SQL} from policies"))
def one_hot(spark, sf_dir):
    columns = [c.alias(name) for name, c in D.one_hot_columns().items()]
    return policies(spark, sf_dir).select("id_policy", *columns)


@query("top_levels", select_policies(f"select id_policy, {_make_sql(MAKES)} from policies"))
def top_levels(spark, sf_dir):
    columns = [c.alias(name) for name, c in D.make_model_columns(MAKES).items()]
    return policies(spark, sf_dir).select("id_policy", *columns)


@query("top_levels_fitted", select_policies("""
select id_policy, case when vh_make_model in (
  select vh_make_model from policies where vh_make_model is not null
  group by vh_make_model order by count(*) desc, vh_make_model limit 20)
  then vh_make_model else 'OTHER' end as kept_level from policies"""))
def top_levels_fitted(spark, sf_dir):
    df = policies(spark, sf_dir)
    kept = X.keep_levels(F.col("vh_make_model"), D.top_levels(df, "vh_make_model", 20), D.OTHER)
    return df.select("id_policy", kept.alias("kept_level"))


@query("design_matrix_61", with_policies(IMPUTED_SQL + f"""
select id_policy, {_IMPUTED}, {ORDINAL_SQL}, {ONE_HOT_SQL}, {_make_sql(MAKES)} from ratios, medians"""))
def design_matrix_61(spark, sf_dir):
    df = labelled(spark, sf_dir)
    out = D.fit_design_matrix(df, MAKES).transform(df)
    return rounded(out, *D.NUMERIC_COLUMNS)
