"""Registry of named queries and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilscope.functions import expressions as X
from perilscope.operators.features import MODEL_FEATURES, FeaturePipeline, fit_preprocessing
from perilscope.operators.selection import drop_incomplete
from perilscope.operators.sampling import with_split_flag
from perilscope.operators.scoring import LogisticScorer, Scorer
from perilscope.sources.tables import POLICY_COLUMNS, policies, policies_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with SQL where the result is deterministic."""
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round to 6 places: two engines may add the same numbers in another order."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Weights of two fixed logistic scorers over the prepared features. They stand in
# for fitted models wherever a result must be reproducible in SQL.
NET_WEIGHTS = {name: round(0.35 - 0.05 * i, 2) for i, name in enumerate(MODEL_FEATURES)}
GBT_WEIGHTS = {name: round(0.04 * i - 0.2, 2) for i, name in enumerate(MODEL_FEATURES)}
NET_INTERCEPT = -0.8
GBT_INTERCEPT = -1.1


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies with the event label."""
    return policies(spark, sf_dir).withColumn("event", X.positive_flag(F.col("claim_amount")))


def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_incomplete(labelled(spark, sf_dir))


def split_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_split_flag(labelled(spark, sf_dir), "id_policy", 0.9, 123)


def fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, FeaturePipeline]:
    """Policies with their split flag, and preprocessing fitted on the training rows."""
    df = split_policies(spark, sf_dir)
    return df, fit_preprocessing(df.where("is_train"))


def logistic_scorers(pipeline: FeaturePipeline) -> dict[str, Scorer]:
    return {
        "net": LogisticScorer(pipeline, NET_WEIGHTS, NET_INTERCEPT),
        "gbt": LogisticScorer(pipeline, GBT_WEIGHTS, GBT_INTERCEPT),
    }


# --- SQL fragments ------------------------------------------------------------

def with_policies(rest: str) -> str:
    """SQL that can use the ``policies`` and ``labelled`` views."""
    return (
        f"with policies as ({policies_sql()}),\n"
        "labelled as (select *, case when claim_amount > 0 then cast(1 as double) "
        "when claim_amount is not null then cast(0 as double) end as event from policies),\n"
        "complete as (select * from labelled where "
        + " and ".join(f"{c} is not null" for c in POLICY_COLUMNS)
        + ")"
        + rest
    )


def select_policies(body: str) -> str:
    return with_policies("\n" + body)


SPLIT = """,
split as (
  select *, row_number() over (order by md5('123:' || cast(id_policy as varchar)))
    <= floor(cast(0.9 as double) * count(*) over ()) as is_train
  from labelled)"""

DENSITY = "(population / nullif(town_surface_area, 0))"
DERIVED_SQL = {
    "density": f"case when {DENSITY} is not null then ln(greatest({DENSITY}, cast(0.01 as double))) end",
    "pol_coverage": (
        "case pol_coverage when 'Min' then cast(1 as double) when 'Med1' then 2 "
        "when 'Med2' then 3 else 4 end"
    ),
    "drv_sex1": "case drv_sex1 when 'F' then cast(1 as double) else 0 end",
    "drv_exp_yrs": "drv_age1 - drv_age_lic1",
    "has_drv2": "case when drv_sex2 in ('M', 'F') then cast(1 as double) else 0 end",
    "is_drv2_male": "case when drv_sex2 = 'M' then cast(1 as double) else 0 end",
}


def feature_sql(name: str) -> str:
    return DERIVED_SQL.get(name, name)


def derived_select(extra: str, source: str) -> str:
    columns = ", ".join(f"{feature_sql(f)} as {f}" for f in MODEL_FEATURES)
    return f"select {extra}, {columns} from {source}"


STATISTICS = (
    SPLIT
    + f""",
derived as ({derived_select("id_policy, is_train, event", "split")}),
stats as (select {", ".join(f"avg({f}) as mean_{f}, stddev_samp({f}) as std_{f}" for f in MODEL_FEATURES)}
  from derived where is_train)"""
)


def prepared_select(extra: str, source: str) -> str:
    columns = ", ".join(
        f"coalesce(({f} - mean_{f}) / nullif(std_{f}, 0), 0) as {f}" for f in MODEL_FEATURES
    )
    return f"select {extra}, {columns} from {source} cross join stats"


def logit_sql(weights: dict[str, float], intercept: float) -> str:
    terms = [f"{f} * cast({w} as double)" for f, w in weights.items()]
    return f"(cast({intercept} as double) + " + " + ".join(terms) + ")"


NET_LOGIT = logit_sql(NET_WEIGHTS, NET_INTERCEPT)
GBT_LOGIT = logit_sql(GBT_WEIGHTS, GBT_INTERCEPT)


def sigmoid_sql(logit: str) -> str:
    return f"1 / (1 + exp(-{logit}))"


PREPARED = STATISTICS + f""",
prepared as ({prepared_select("id_policy, is_train, event", "derived")})"""

SCORED = PREPARED + f""",
scored as (select id_policy, is_train, event, {NET_LOGIT} as net_logit, {GBT_LOGIT} as gbt_logit,
  {sigmoid_sql(NET_LOGIT)} as net, {sigmoid_sql(GBT_LOGIT)} as gbt from prepared)"""
