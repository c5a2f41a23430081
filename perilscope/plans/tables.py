"""Queries over sources, selections, expressions, aggregates and sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from perilscope.functions import expressions as X
from perilscope.operators import aggregates as A
from perilscope.operators import sampling as S
from perilscope.operators import sketches as K
from perilscope.operators.quantiles import exact_quantiles
from perilscope.operators.selection import drop_incomplete, filter_equal
from perilscope.operators.scoring import with_user_column
from perilscope.operators.whatif import overwrite, stack_frames
from perilscope.plans.catalog import (
    SPLIT, labelled, query, rounded, select_policies, split_policies, with_policies,
)
from perilscope.session import job_folder, materialise
from perilscope.sources import files
from perilscope.sources.tables import POLICY_COLUMNS, POLICY_SCHEMA, policies, table

NO_CLAIM = ", ".join(c for c in POLICY_COLUMNS if c != "claim_amount")
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
NUMERIC = ["vh_value", "vh_age", "vh_weight", "drv_age1", "population", "claim_amount"]


# --- sources --------------------------------------------------------------------

@query("load_policies", select_policies("select * from policies"))
def load_policies(spark, sf_dir):
    return policies(spark, sf_dir)


@query("csv_roundtrip", select_policies(f"select {NO_CLAIM} from policies"))
def csv_roundtrip(spark, sf_dir):
    path = job_folder(spark, "policies-csv")
    files.write_csv(policies(spark, sf_dir), path)
    return files.load_for_prediction(spark, path)


@query("json_requests", select_policies(f"""
select cast(floor(id_policy / 100) as bigint) as request_id,
  cast(row_number() over (partition by floor(id_policy / 100) order by id_policy) - 1 as int) as position,
  {NO_CLAIM} from policies"""))
def json_requests(spark, sf_dir):
    bodies = files.request_bodies(policies(spark, sf_dir).drop("claim_amount"), "id_policy")
    schema = type(POLICY_SCHEMA)([f for f in POLICY_SCHEMA.fields if f.name != "claim_amount"])
    return files.parse_requests(bodies, schema)


@query("csv_reordered", select_policies(f"select {NO_CLAIM} from policies"))
def csv_reordered(spark, sf_dir):
    """Columns in reverse order, one more among them and the target absent: found by name."""
    path = job_folder(spark, "policies-csv")
    rows = policies(spark, sf_dir).drop("claim_amount")
    files.write_csv(rows.select(*reversed(rows.columns), F.lit("x").alias("remark")), path)
    return files.load_for_prediction(spark, path)


@query("request_errors", select_policies("""
select request_id, case request_id % 4 when 1 then 'empty' when 2 then 'bad' when 3 then 'bad' else 'ok' end as status,
  case when request_id % 4 = 0 then n else 0 end as scores
from (select cast(floor(id_policy / 100) as bigint) as request_id, count(*) as n from policies group by 1)"""))
def request_errors(spark, sf_dir):
    """One reply to every request: good ones, empty ones, cut off ones and ones that are no JSON."""
    schema = type(POLICY_SCHEMA)([f for f in POLICY_SCHEMA.fields if f.name != "claim_amount"])
    bodies = files.request_bodies(policies(spark, sf_dir).drop("claim_amount"), "id_policy")
    kind = F.col("request_id") % 4
    broken = (
        F.when(kind == 1, F.lit("[]")).when(kind == 2, F.expr("left(body, length(body) - 7)"))
        .when(kind == 3, F.lit("not json")).otherwise(F.col("body"))
    )
    replies = files.all_responses(
        bodies.withColumn("body", broken), schema, lambda rows, name: rows.withColumn(name, F.lit(0.5))
    )
    scores = F.from_json("response", "score array<double>")["score"]
    return replies.select("request_id", "status", F.greatest(F.size(scores), F.lit(0)).cast("bigint").alias("scores"))


@query("request_repeats", select_policies("""
select case when r % 3 = 0 then r % 6 end as request_id, case when r % 2 = 0 then 'ok' else 'bad' end as status,
  case when r % 2 = 0 then n else 0 end as scores
from (select cast(floor(id_policy / 100) as bigint) as r, count(*) as n from policies group by 1)"""))
def request_repeats(spark, sf_dir):
    """Requests that share an id or have none: each has a reply of its own."""
    schema = type(POLICY_SCHEMA)([f for f in POLICY_SCHEMA.fields if f.name != "claim_amount"])
    bodies = files.request_bodies(policies(spark, sf_dir).drop("claim_amount"), "id_policy")
    requests = bodies.select(
        F.when(F.col("request_id") % 3 == 0, F.col("request_id") % 6).alias("request_id"),
        F.when(F.col("request_id") % 2 == 0, F.col("body")).otherwise("not json").alias("body"),
    )
    replies = files.all_responses(requests, schema, lambda rows, name: rows.withColumn(name, F.lit(0.5)))
    scores = F.from_json("response", "score array<double>")["score"]
    return replies.select("request_id", "status", F.greatest(F.size(scores), F.lit(0)).cast("bigint").alias("scores"))


# --- selections -----------------------------------------------------------------

@query("select_cols", select_policies("select id_policy, pol_coverage, vh_value from policies"))
def select_cols(spark, sf_dir):
    return policies(spark, sf_dir).select("id_policy", "pol_coverage", "vh_value")


@query("filter_equal", select_policies(
    "select id_policy, vh_value from policies where pol_coverage = 'Max'"))
def top_coverage(spark, sf_dir):
    return filter_equal(policies(spark, sf_dir), "pol_coverage", "Max").select("id_policy", "vh_value")


@query("positive_claims", select_policies(
    "select id_policy, claim_amount from policies where claim_amount > 0"))
def positive_claims(spark, sf_dir):
    return policies(spark, sf_dir).where("claim_amount > 0").select("id_policy", "claim_amount")


@query("drop_incomplete", select_policies("select * from complete"))
def complete_rows(spark, sf_dir):
    return drop_incomplete(labelled(spark, sf_dir))


@query("first_n", select_policies("select * from policies order by id_policy limit 100"))
def first_n(spark, sf_dir):
    return S.first_rows(policies(spark, sf_dir), "id_policy", 100)


SPARSE_KEY = "case when id_policy % 50 = 0 then -id_policy * id_policy * 1000 else id_policy end"


@query("first_n_sparse", select_policies(
    f"select {SPARSE_KEY} as place, id_policy from policies order by place limit 100"))
def first_n_sparse(spark, sf_dir):
    """The same over keys with wide gaps, most of the wanted ones below zero."""
    keyed = policies(spark, sf_dir).select(F.expr(SPARSE_KEY).alias("place"), "id_policy")
    return S.first_rows(keyed, "place", 100)


@query("single_row", select_policies(
    "select * from policies where id_policy = (select max(id_policy) from policies)"))
def single_row(spark, sf_dir):
    df = policies(spark, sf_dir)
    newest = df.agg(F.max("id_policy").alias("newest"))
    return df.where(F.col("id_policy") == newest.scalar())


@query("overwrite_constant", select_policies("""
select id_policy, 'Max' as pol_coverage, cast(60 as double) as drv_age1, vh_value from policies"""))
def overwrite_constant(spark, sf_dir):
    df = policies(spark, sf_dir).select("id_policy", "pol_coverage", "drv_age1", "vh_value")
    return overwrite(overwrite(df, "pol_coverage", "Max"), "drv_age1", 60)


@query("vertical_concat", select_policies("""
select id_policy, 'Min' as pol_coverage, vh_value from policies
union all select id_policy, 'Max' as pol_coverage, vh_value from policies"""))
def vertical_concat(spark, sf_dir):
    df = policies(spark, sf_dir).select("id_policy", "pol_coverage", "vh_value")
    return stack_frames(overwrite(df, "pol_coverage", "Min"), overwrite(df, "pol_coverage", "Max"))


# --- expressions ----------------------------------------------------------------

@query("event_label", select_policies("select id_policy, event from labelled"))
def event_label(spark, sf_dir):
    return labelled(spark, sf_dir).select("id_policy", "event")


@query("coverage_map", select_policies("""
select id_policy, case pol_coverage when 'Min' then cast(1 as double) when 'Med1' then 2
  when 'Med2' then 3 else 4 end as coverage_code from policies"""))
def coverage_map(spark, sf_dir):
    code = X.level_code(F.col("pol_coverage"), X.COVERAGE_CODES, X.COVERAGE_DEFAULT)
    return policies(spark, sf_dir).select("id_policy", code.alias("coverage_code"))


@query("driver_flags", select_policies("""
select id_policy, case drv_sex1 when 'F' then cast(1 as double) else 0 end as sex_code,
  case when drv_sex2 in ('M', 'F') then cast(1 as double) else 0 end as has_drv2,
  case when drv_sex2 = 'M' then cast(1 as double) else 0 end as is_drv2_male,
  case when vh_type = 'Commercial' then cast(1 as double) else 0 end as vh_type_commercial,
  case when pol_payd = 'Yes' then cast(1 as double) else 0 end as is_pol_payd,
  case when drv_sex1 = 'M' then drv_age1 end as drv_age1_male from policies"""))
def driver_flags(spark, sf_dir):
    return policies(spark, sf_dir).select(
        "id_policy",
        X.level_code(F.col("drv_sex1"), X.SEX_CODES).alias("sex_code"),
        X.level_code(F.col("drv_sex2"), X.SECOND_DRIVER_CODES).alias("has_drv2"),
        X.level_code(F.col("drv_sex2"), X.SECOND_DRIVER_MALE_CODES).alias("is_drv2_male"),
        X.equals_flag(F.col("vh_type"), "Commercial").alias("vh_type_commercial"),
        X.equals_flag(F.col("pol_payd"), "Yes").alias("is_pol_payd"),
        X.value_where(F.col("drv_age1"), F.col("drv_sex1"), "M").alias("drv_age1_male"),
    )


@query("log_density", select_policies("""
select id_policy, round(population / nullif(town_surface_area, 0), 6) as density,
  case when population / nullif(town_surface_area, 0) is not null then
    round(ln(greatest(population / nullif(town_surface_area, 0), cast(0.01 as double))), 6)
  end as log_density from policies"""))
def log_density(spark, sf_dir):
    density = X.ratio(F.col("population"), F.col("town_surface_area"))
    df = policies(spark, sf_dir).select(
        "id_policy", density.alias("density"), X.log_floored(density).alias("log_density")
    )
    return rounded(df, "density", "log_density")


@query("experience_years", select_policies(
    "select id_policy, drv_age1 - drv_age_lic1 as drv_exp_yrs from policies"))
def experience_years(spark, sf_dir):
    return policies(spark, sf_dir).select(
        "id_policy", (F.col("drv_age1") - F.col("drv_age_lic1")).alias("drv_exp_yrs")
    )


@query("ratio_features", select_policies("""
select id_policy, drv_age1 - drv_age2 as drv_age1_age2_diff,
  round(vh_value / nullif(vh_weight, 0), 6) as vh_value_div_weight from policies"""))
def ratio_features(spark, sf_dir):
    df = policies(spark, sf_dir).select(
        "id_policy",
        (F.col("drv_age1") - F.col("drv_age2")).alias("drv_age1_age2_diff"),
        X.ratio(F.col("vh_value"), F.col("vh_weight")).alias("vh_value_div_weight"),
    )
    return rounded(df, "vh_value_div_weight")


@query("single_precision", select_policies("""
select id_policy, cast(cast(vh_value as float) as double) as vh_value_single,
  cast(cast(pol_no_claims_discount as float) as double) as discount_single from policies"""))
def single_precision(spark, sf_dir):
    def single(c):
        return F.col(c).cast("float").cast("double")

    return policies(spark, sf_dir).select(
        "id_policy",
        single("vh_value").alias("vh_value_single"),
        single("pol_no_claims_discount").alias("discount_single"),
    )


@query("exp_columns", f"""
select l_orderkey, l_linenumber, {", ".join(f"round(exp({c} / 100000), 6) as exp_{c}" for c in MEASURES)}
from lineitem""")
def exp_columns(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    exps = {f"exp_{c}": F.round(F.exp(F.col(c) / 100000), 6) for c in MEASURES}
    return df.withColumns(exps).select("l_orderkey", "l_linenumber", *exps)


@F.pandas_udf(DoubleType())
def _log1p(x: pd.Series) -> pd.Series:
    return np.log1p(x)


@query("user_function", select_policies(
    "select id_policy, round(ln(1 + vh_value), 6) as log_value from policies"))
def user_function(spark, sf_dir):
    df = with_user_column(policies(spark, sf_dir), ["vh_value"], _log1p, "log_value")
    return rounded(df.select("id_policy", "log_value"), "log_value")


# --- aggregates -----------------------------------------------------------------

@query("group_means", select_policies("""
select pol_coverage, round(avg(vh_age), 6) as vh_age, round(avg(vh_value), 6) as vh_value
from policies group by pol_coverage"""))
def group_means(spark, sf_dir):
    df = A.group_means(policies(spark, sf_dir), "pol_coverage", ["vh_age", "vh_value"])
    return rounded(df, "vh_age", "vh_value")


@query("category_profile", select_policies(
    "select pol_coverage, round(avg(vh_value), 6) as vh_value from policies group by pol_coverage"))
def category_profile(spark, sf_dir):
    df = A.group_means(policies(spark, sf_dir), "pol_coverage", ["vh_age", "vh_value"])
    return rounded(df.select("pol_coverage", "vh_value"), "vh_value")


@query("weighted_group_means", select_policies("""
select pol_coverage, round(avg(event), 6) as event, round(avg(claim_amount), 6) as claim_amount,
  count(*) as _weight from labelled group by pol_coverage"""))
def weighted_group_means(spark, sf_dir):
    df = A.weighted_group_means(
        labelled(spark, sf_dir), ["pol_coverage"], ["event", "claim_amount"]
    )
    return rounded(df, "event", "claim_amount")


@query("group_sums", f"""
select l_returnflag, {", ".join(f"round(sum({c}), 2) as {c}" for c in MEASURES)}
from lineitem group by l_returnflag""")
def group_sums(spark, sf_dir):
    df = A.group_sums(table(spark, sf_dir, "lineitem"), "l_returnflag", MEASURES)
    return df.withColumns({c: F.round(c, 2) for c in MEASURES})


@query("global_sums", f"""
select {", ".join(f"round(sum({c}), 2) as {c}" for c in MEASURES)} from lineitem""")
def global_sums(spark, sf_dir):
    df = A.total_sums(table(spark, sf_dir, "lineitem"), MEASURES)
    return df.withColumns({c: F.round(c, 2) for c in MEASURES})


@query("group_exp", f"""
select l_returnflag, l_orderkey, l_linenumber, round(exp(l_discount), 6) as exp_discount,
  round(avg(l_quantity) over (partition by l_returnflag), 6) as mean_quantity,
  round(max(l_tax) over (partition by l_returnflag), 6) as max_tax
from lineitem""")
def group_exp(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_orderkey", "l_linenumber", "l_quantity", "l_tax",
        F.exp("l_discount").alias("exp_discount"),
    )
    df = A.with_group_statistics(
        df, "l_returnflag", mean_quantity=F.avg("l_quantity"), max_tax=F.max("l_tax")
    )
    return rounded(df.drop("l_quantity", "l_tax"), "exp_discount", "mean_quantity", "max_tax")


@query("group_transform", select_policies("""
select id_policy, pol_coverage, round(vh_value - avg(vh_value) over (partition by pol_coverage), 6) as centred
from policies"""))
def group_transform(spark, sf_dir):
    df = policies(spark, sf_dir).select("id_policy", "pol_coverage", "vh_value")
    df = A.with_group_statistics(df, "pol_coverage", mean=F.avg("vh_value"))
    return rounded(
        df.select("id_policy", "pol_coverage", (F.col("vh_value") - F.col("mean")).alias("centred")),
        "centred",
    )


@query("user_aggregate", select_policies("""
select pol_usage, round(sqrt(avg(vh_value * vh_value)), 4) as rms_value,
  round(max(claim_amount) - min(claim_amount), 4) as claim_range from policies group by pol_usage"""))
def user_aggregate(spark, sf_dir):
    value = F.col("vh_value")
    return A.user_aggregate(
        policies(spark, sf_dir),
        ["pol_usage"],
        rms_value=F.round(F.sqrt(F.avg(value * value)), 4),
        claim_range=F.round(F.max("claim_amount") - F.min("claim_amount"), 4),
    )


def _per_feature(measures):
    return "\nunion all ".join(
        f"select '{c}' as feature, {', '.join(f'round({m.format(c)}, 6) as {n}' for n, m in measures.items())}"
        " from policies"
        for c in NUMERIC
    )


@query("mean_and_std", select_policies(
    _per_feature({"mean": "avg({})", "std": "stddev_samp({})"})))
def mean_and_std(spark, sf_dir):
    return rounded(A.mean_and_std(policies(spark, sf_dir), NUMERIC), "mean", "std")


@query("extrema", select_policies(_per_feature({"min": "min({})", "max": "max({})"})))
def extrema(spark, sf_dir):
    return rounded(A.extrema(policies(spark, sf_dir), NUMERIC), "min", "max")


PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


@query("quantiles", select_policies("\nunion all ".join(
    f"select '{c}' as feature, cast({p} as double) as prob, "
    f"round(quantile_cont({c}, {p}), 6) as value from policies"
    for c in NUMERIC for p in PROBS)))
def quantiles(spark, sf_dir):
    values = exact_quantiles(policies(spark, sf_dir), NUMERIC, PROBS)
    rows = [(c, p, v) for c, vs in values.items() for p, v in zip(PROBS, vs)]
    return rounded(spark.createDataFrame(rows, "feature string, prob double, value double"), "value")


@query("sketch_quantiles", select_policies("\nunion all ".join(
    f"select {g} as coverage, '{c}' as feature, cast({p} as double) as prob, cast(count({c}) as bigint) as n, true as is_near from policies group by {key}"
    for g, key in (("pol_coverage", "pol_coverage"), ("'all'", "()")) for c in NUMERIC for p in PROBS)))
def sketch_quantiles(spark, sf_dir):
    """Quantiles per coverage, and of all rows from the stored sketches; true where the value's rank is within the error."""
    df = policies(spark, sf_dir).select("pol_coverage", *NUMERIC)
    parts = materialise(K.quantile_sketches(df, NUMERIC, ["pol_coverage"]).withColumnRenamed("pol_coverage", "coverage"), "sketches")
    every = K.merge_sketches(parts).withColumn("coverage", F.lit("all"))
    found = materialise(K.sketch_quantiles(parts.unionByName(every), PROBS), "found")
    values = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in NUMERIC]))
    long = df.select(F.explode(F.array("pol_coverage", F.lit("all"))).alias("coverage"), *NUMERIC).select("coverage", values)
    # a few numbers per coverage and feature beside every row
    ranked = long.withColumnRenamed("coverage", "group").join(
        found.withColumnRenamed("feature", "name"), F.col("group").eqNullSafe(F.col("coverage")) & (F.col("feature") == F.col("name"))
    ).groupBy("coverage", "feature", "prob", "n").agg(
        F.count(F.when(F.col("x") < F.col("value"), 1)).alias("below"), F.count(F.when(F.col("x") <= F.col("value"), 1)).alias("until")
    )
    error = 3 * K.rank_error() * F.col("n") + 1
    near = (F.col("below") - error <= F.col("prob") * F.col("n")) & (F.col("prob") * F.col("n") <= F.col("until") + error)
    return ranked.select("coverage", "feature", "prob", "n", near.alias("is_near"))


@query("medians", select_policies(_per_feature({"median": "quantile_cont({}, 0.5)"})))
def medians(spark, sf_dir):
    values = exact_quantiles(policies(spark, sf_dir), NUMERIC, [0.5])
    rows = [(c, v[0]) for c, v in values.items()]
    return rounded(spark.createDataFrame(rows, "feature string, median double"), "median")


@query("distinct_years", select_policies("select distinct year from policies"))
def distinct_years(spark, sf_dir):
    return policies(spark, sf_dir).select("year").distinct()


@query("row_count", select_policies("select count(*) as n from policies"))
def row_count(spark, sf_dir):
    return policies(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


# --- sampling and splitting -----------------------------------------------------

DIGEST = "md5('123:' || cast(id_policy as varchar))"


@query("sample_k", select_policies(f"select * from policies order by {DIGEST} limit 50"))
def sample_k(spark, sf_dir):
    return S.sample_rows(policies(spark, sf_dir), "id_policy", 50)


@query("sample_large", select_policies(f"""
select id_policy, vh_value from policies
order by {DIGEST} limit cast((select count(*) // 3 from policies) as bigint)"""))
def sample_large(spark, sf_dir):
    df = policies(spark, sf_dir).select("id_policy", "vh_value")
    return S.large_sample(df, "id_policy", df.count() // 3)


@query("sample_one", select_policies(f"select * from policies order by {DIGEST} limit 1"))
def sample_one(spark, sf_dir):
    return S.one_row(policies(spark, sf_dir), "id_policy")


@query("split_train", with_policies(
    SPLIT + "\nselect id_policy, vh_value, event from split where is_train"))
def split_train(spark, sf_dir):
    train, _ = S.split(labelled(spark, sf_dir), "id_policy", 0.9, 123)
    return train.select("id_policy", "vh_value", "event")


@query("split_eval", with_policies(
    SPLIT + "\nselect id_policy, vh_value, event from split where not is_train"))
def split_eval(spark, sf_dir):
    return split_policies(spark, sf_dir).where(~F.col("is_train")).select(
        "id_policy", "vh_value", "event"
    )


@query("bags_5", select_policies("select id_policy, " + ", ".join(
    f"row_number() over (order by md5('{123 + i}:' || cast(id_policy as varchar))) "
    f"<= floor(cast(0.9 as double) * count(*) over ()) as bag_{i}" for i in range(1, 6))
    + " from policies"))
def bags_5(spark, sf_dir):
    df = policies(spark, sf_dir).select("id_policy")
    return S.with_bag_flags(df, "id_policy", 0.9, {f"bag_{i}": 123 + i for i in range(1, 6)})


@query("hash_index", select_policies("""
select id_policy, row_number() over (order by md5('reference:123:' || cast(id_policy as varchar))) - 1 as _index
from policies"""))
def hash_index(spark, sf_dir):
    return S.hash_index(policies(spark, sf_dir).select("id_policy"), "id_policy", "reference:123").all_rows()


@query("python_aggregate", select_policies("""
select pol_coverage, drv_sex1, round(exp(avg(ln(vh_value))), 4) as typical_value from policies
group by pol_coverage, drv_sex1"""))
def python_aggregate(spark, sf_dir):
    """Geometric mean by a user's functions: a count and a sum of logarithms."""
    out = A.python_aggregate(
        policies(spark, sf_dir), ["pol_coverage", "drv_sex1"], ["vh_value"],
        zero=lambda: (0, 0.0),
        add=lambda state, rows: (state[0] + len(rows), state[1] + float(np.log(rows["vh_value"]).sum())),
        merge=lambda a, b: (a[0] + b[0], a[1] + b[1]),
        finish=lambda state: float(np.exp(state[1] / state[0])),
        output="typical_value",
    )
    return out.withColumn("typical_value", F.round("typical_value", 4))
