"""Queries over scores, losses, what-if spreads and scoring jobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from perilscope.functions import expressions as X
from perilscope.operators import models as M
from perilscope.operators import whatif as W
from perilscope.operators.aggregates import best_setting
from perilscope.operators.profiles import histogram, kernel_profile
from perilscope.operators.scoring import (
    LogisticScorer, PandasScorer, score_difference, with_scores,
)
from perilscope.plans.catalog import (
    DERIVED_SQL, GBT_INTERCEPT, GBT_WEIGHTS, NET_INTERCEPT, NET_LOGIT, NET_WEIGHTS, SCORED,
    derived_select, fitted, logistic_scorers, prepared_select, query, rounded, select_policies,
    sigmoid_sql, with_policies, STATISTICS,
)
from perilscope.plans.oneway import histogram_sql, kernel_sql
from perilscope.session import job_folder, materialise
from perilscope.sources import files
from perilscope.sources.tables import POLICY_SCHEMA, policies


@query("score_logistic", with_policies(SCORED + "\nselect id_policy, round(net, 6) as score from scored"))
def score_logistic(spark, sf_dir):
    df, pipeline = fitted(spark, sf_dir)
    scored = logistic_scorers(pipeline)["net"](df, "score")
    return rounded(scored.select("id_policy", "score"), "score")


@query("append_scores", with_policies(SCORED + """
select p.*, s.event, round(net, 6) as net, round(gbt, 6) as gbt
from policies p join scored s using (id_policy)"""))
def append_scores(spark, sf_dir):
    df, pipeline = fitted(spark, sf_dir)
    return rounded(with_scores(df.drop("is_train"), logistic_scorers(pipeline)), "net", "gbt")


@query("score_correlation", with_policies(
    SCORED + "\nselect round(corr(net, gbt), 6) as correlation, count(*) as n from scored"))
def score_correlation(spark, sf_dir):
    df, pipeline = fitted(spark, sf_dir)
    scored = with_scores(df, logistic_scorers(pipeline))
    return rounded(
        scored.agg(F.corr("net", "gbt").alias("correlation"), F.count(F.lit(1)).alias("n")),
        "correlation",
    )


@query("log_loss", with_policies(SCORED + """
select round(avg(greatest(net_logit, 0) - net_logit * event + ln(1 + exp(-abs(net_logit)))), 6) as eval_metric
from scored where not is_train"""))
def log_loss(spark, sf_dir):
    df, pipeline = fitted(spark, sf_dir)
    scorer = LogisticScorer(pipeline, NET_WEIGHTS, NET_INTERCEPT)
    rows = scorer.logit(df.where(~F.col("is_train")), "logit")
    return rounded(M.mean_log_loss(rows, "logit", "event"), "eval_metric")


@query("poisson_loss", with_policies(SCORED + """
select round(avg(exp(gbt_logit) - gbt_logit * event), 6) as eval_metric from scored where not is_train"""))
def poisson_loss(spark, sf_dir):
    df, pipeline = fitted(spark, sf_dir)
    scorer = LogisticScorer(pipeline, GBT_WEIGHTS, GBT_INTERCEPT)
    rows = scorer.logit(df.where(~F.col("is_train")), "logit")
    return rounded(M.mean_poisson_loss(rows, "logit", "event"), "eval_metric")


# --- a sweep that SQL can follow: the same weights at eight strengths ------------------

STRENGTHS = [0.25 * i for i in range(1, 9)]

SWEEP_SQL = SCORED + ",\nresults as (" + " union all ".join(
    f"select cast({s} as double) as strength, avg(greatest({s} * net_logit, 0) - {s} * net_logit * event "
    f"+ ln(1 + exp(-abs({s} * net_logit)))) as eval_metric from scored where not is_train"
    for s in STRENGTHS) + ")"


def _strength_results(spark, sf_dir):
    df, pipeline = fitted(spark, sf_dir)
    scorer = LogisticScorer(pipeline, NET_WEIGHTS, NET_INTERCEPT)
    rows = scorer.logit(df.where(~F.col("is_train")), "logit")
    wide = rows.agg(
        *[
            F.avg(X.log_loss(F.col("logit") * s, F.col("event"))).alias(f"m{i}")
            for i, s in enumerate(STRENGTHS)
        ]
    )
    cells = [
        F.struct(F.lit(s).alias("strength"), F.col(f"m{i}").alias("eval_metric"))
        for i, s in enumerate(STRENGTHS)
    ]
    return wide.select(F.inline(F.array(*cells)))


@query("sweep_results_csv", with_policies(
    SWEEP_SQL + "\nselect strength, round(eval_metric, 6) as eval_metric from results"))
def sweep_results_csv(spark, sf_dir):
    path = job_folder(spark, "sweep")
    files.write_csv(_strength_results(spark, sf_dir), path)
    read = spark.read.schema("strength double, eval_metric double").csv(path, header=True)
    return rounded(read, "eval_metric")


@query("best_setting", with_policies(SWEEP_SQL + """
select strength, round(eval_metric, 6) as eval_metric from results order by eval_metric, strength limit 1"""))
def best_strength(spark, sf_dir):
    return rounded(
        best_setting(_strength_results(spark, sf_dir), "strength", "eval_metric"), "eval_metric"
    )


# --- what-if and spreads --------------------------------------------------------------

def _variant_sql(name: str, changes: str) -> str:
    """A CTE with the net's score of every policy after ``changes``."""
    return f""",
{name}_raw as (select * replace ({changes}) from labelled),
{name}_derived as ({derived_select("id_policy", f"{name}_raw")}),
{name}_ready as ({prepared_select("id_policy", f"{name}_derived")}),
{name} as (select id_policy, {sigmoid_sql(NET_LOGIT)} as score from {name}_ready)"""


def _spread_sql(change_a: str, change_b: str) -> str:
    return STATISTICS + _variant_sql("a", change_a) + _variant_sql("b", change_b) + """,
spreads as (select a.id_policy, a.score as score_a, b.score as score_b, b.score - a.score as spread
  from a join b using (id_policy))"""


COVERAGE_SQL = _spread_sql("'Min' as pol_coverage", "'Max' as pol_coverage")
AGE_SQL = _spread_sql("cast(40 as double) as drv_age1", "cast(60 as double) as drv_age1")
SPREAD_COLUMNS = "id_policy, round(score_a, 6) as score_a, round(score_b, 6) as score_b, round(spread, 6) as spread"


def _spread(spark, sf_dir, column, a, b):
    df, pipeline = fitted(spark, sf_dir)
    return W.whatif_spread(df, column, a, b, logistic_scorers(pipeline)["net"])


@query("whatif_coverage", with_policies(COVERAGE_SQL + f"\nselect {SPREAD_COLUMNS} from spreads"))
def whatif_coverage(spark, sf_dir):
    df = _spread(spark, sf_dir, "pol_coverage", "Min", "Max")
    return rounded(df.select("id_policy", "score_a", "score_b", "spread"), "score_a", "score_b", "spread")


@query("whatif_age", with_policies(AGE_SQL + f"\nselect {SPREAD_COLUMNS} from spreads"))
def whatif_age(spark, sf_dir):
    df = _spread(spark, sf_dir, "drv_age1", 40, 60)
    return rounded(df.select("id_policy", "score_a", "score_b", "spread"), "score_a", "score_b", "spread")


@query("whatif_variants", with_policies(COVERAGE_SQL + """
select id_policy, 0 as variant, 'Min' as pol_coverage, round(score_a, 6) as score from spreads
union all select id_policy, 1 as variant, 'Max' as pol_coverage, round(score_b, 6) as score from spreads"""))
def whatif_variants(spark, sf_dir):
    df, pipeline = fitted(spark, sf_dir)
    long = W.whatif_variants(df, "pol_coverage", ["Min", "Max"], logistic_scorers(pipeline)["net"])
    return rounded(long.select("id_policy", "variant", "pol_coverage", "score"), "score")


@query("variant_spread", with_policies(
    COVERAGE_SQL + "\nselect id_policy, round(spread, 6) as spread from spreads"))
def variant_spread(spark, sf_dir):
    df, pipeline = fitted(spark, sf_dir)
    long = W.whatif_variants(df, "pol_coverage", ["Min", "Max"], logistic_scorers(pipeline)["net"])
    return rounded(W.variant_spread(long, "id_policy"), "spread")


@query("row_difference", with_policies(COVERAGE_SQL + """
select id_policy, round(score_b - score_a, 6) as difference from spreads"""))
def row_difference(spark, sf_dir):
    df, pipeline = fitted(spark, sf_dir)
    long = W.whatif_variants(df, "pol_coverage", ["Min", "Max"], logistic_scorers(pipeline)["net"])
    # two rows per window
    before = F.lag("score").over(Window.partitionBy("id_policy").orderBy("variant"))
    steps = long.select("id_policy", (F.col("score") - before).alias("difference"))
    return rounded(steps.where(F.col("difference").isNotNull()), "difference")


@query("model_spread", with_policies(SCORED + """
select id_policy, round(net, 6) as net, round(gbt, 6) as gbt, round(gbt - net, 6) as spread from scored"""))
def model_spread(spark, sf_dir):
    df, pipeline = fitted(spark, sf_dir)
    out = score_difference(df, logistic_scorers(pipeline), minus="net", plus="gbt")
    return rounded(out.select("id_policy", "net", "gbt", "spread"), "net", "gbt", "spread")


def _spread_table(spark, sf_dir, column, a, b):
    """Spreads written once: the profiles below scan them several times."""
    return materialise(_spread(spark, sf_dir, column, a, b).select("spread"), "spreads")


@query("spread_histogram", with_policies(AGE_SQL + histogram_sql("spread", "spreads")))
def spread_histogram(spark, sf_dir):
    return rounded(histogram(_spread_table(spark, sf_dir, "drv_age1", 40, 60), "spread", 20), "lower")


@query("spread_density", with_policies(COVERAGE_SQL + kernel_sql("spread", "spreads")))
def spread_density(spark, sf_dir):
    df = _spread_table(spark, sf_dir, "pol_coverage", "Min", "Max")
    return rounded(kernel_profile(df, "spread", 21), "x", "density")


# --- jobs -------------------------------------------------------------------------------

@query("json_score_responses", with_policies(SCORED + """
select cast(floor(id_policy / 100) as bigint) as request_id,
  cast(row_number() over (partition by floor(id_policy / 100) order by id_policy) - 1 as int) as position,
  round(net, 6) as score from scored"""))
def json_score_responses(spark, sf_dir):
    df, pipeline = fitted(spark, sf_dir)
    schema = type(POLICY_SCHEMA)([f for f in POLICY_SCHEMA.fields if f.name != "claim_amount"])
    bodies = files.request_bodies(df.select(*schema.names), "id_policy")
    scored = logistic_scorers(pipeline)["net"](files.parse_requests(bodies, schema), "score")
    responses = files.score_responses(scored)
    parsed = responses.select(
        "request_id", F.from_json("response", "score array<double>").alias("r")
    )
    return rounded(
        parsed.select("request_id", F.posexplode("r.score").alias("position", "score")), "score"
    )


@query("predictions_csv", with_policies(SCORED + "\nselect round(net, 6) as prediction from scored"))
def predictions_csv(spark, sf_dir):
    df, pipeline = fitted(spark, sf_dir)
    path = job_folder(spark, "claims")
    scored = logistic_scorers(pipeline)["net"](df, "prediction")
    files.write_predictions(scored, "prediction", path, "id_policy")
    return rounded(spark.read.schema("prediction double").csv(path), "prediction")


@query("batch_scoring", with_policies(SCORED + "\nselect id_policy, round(net, 6) as prediction from scored"))
def batch_scoring(spark, sf_dir):
    df, pipeline = fitted(spark, sf_dir)
    source, destination = job_folder(spark, "dataset"), job_folder(spark, "predictions")
    files.write_csv(policies(spark, sf_dir), source)
    files.BatchScoring(logistic_scorers(pipeline)["net"]).run(spark, source, destination)
    read = spark.read.schema("id_policy bigint, prediction double").csv(destination)
    return rounded(read, "prediction")


@query("outside_model", select_policies("""
select id_policy, round(1 / (1 + exp(-(cast(0.02 as double) * drv_age1 - cast(0.00005 as double) * vh_value))), 6)
  as score from policies"""))
def outside_model(spark, sf_dir):
    # defined here so that it is shipped to the workers by value
    def predict(batch: pd.DataFrame) -> pd.Series:
        z = 0.02 * batch["drv_age1"] - 0.00005 * batch["vh_value"]
        return 1 / (1 + np.exp(-z))

    df = policies(spark, sf_dir).select("id_policy", "drv_age1", "vh_value")
    return rounded(PandasScorer(predict)(df, "score").select("id_policy", "score"), "score")
