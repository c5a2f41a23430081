"""Queries over bins, one-way tables and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from perilscope.operators.explain import EFFECT_FEATURES
from perilscope.operators.oneway import one_way, one_way_features, with_bins
from perilscope.operators.profiles import histogram, kernel_profile
from perilscope.operators.selection import drop_incomplete
from perilscope.operators.scoring import with_scores
from perilscope.plans.catalog import (
    SCORED, fitted, labelled, logistic_scorers, query, rounded, select_policies, with_policies,
)
from perilscope.session import materialise
from perilscope.sources.tables import policies


def label_sql(column: str, method: str = "quantiles", nbins: int = 10) -> str:
    """Bin label over the ``edges`` row of ``edges_sql``; null for null."""
    places = range(1, nbins) if method == "quantiles" else range(nbins)
    hits = " + ".join(f"(case when {column} >= {column}_e{i} then 1 else 0 end)" for i in places)
    return f"case when {column} is not null then {hits} + 1 end"


def edges_sql(columns, source: str, method: str = "quantiles", nbins: int = 10) -> str:
    if method == "quantiles":
        cells = [
            f"quantile_cont({c}, cast({i} as double) / {nbins}) as {c}_e{i}"
            for c in columns for i in range(1, nbins)
        ]
    else:
        cells = [
            f"min({c}) + {i} * (max({c}) - min({c})) / {nbins} as {c}_e{i}"
            for c in columns for i in range(nbins)
        ]
    return f",\nedges as (select {', '.join(cells)} from {source})"


def one_way_sql(features, targets, source: str, method: str = "quantiles", named: bool = True) -> str:
    means = ", ".join(f"round(avg({t}), 6) as {t}" for t in targets)
    parts = [
        f"select {f'{chr(39)}{c}{chr(39)} as feature, ' if named else ''}{label_sql(c, method)} as var_bins, "
        f"{means}, count(*) as _weight from {source}, edges group by 1{', 2' if named else ''}"
        for c in features
    ]
    return edges_sql(features, source, method) + "\n" + "\nunion all ".join(parts)


BINNED = ["vh_value", "pol_duration", "vh_age"]


def _bin_sql(method):
    labels = ", ".join(f"{label_sql(c, method)} as {c}_bin" for c in BINNED)
    return edges_sql(BINNED, "policies", method) + f"\nselect id_policy, {labels} from policies, edges"


def _bins(spark, sf_dir, method):
    df = policies(spark, sf_dir).select("id_policy", *BINNED)
    for c in BINNED:
        df = with_bins(df, c, 10, method, f"{c}_bin")
    return df.select("id_policy", *[f"{c}_bin" for c in BINNED])


@query("bin_quantile", with_policies(_bin_sql("quantiles")))
def bin_quantile(spark, sf_dir):
    return _bins(spark, sf_dir, "quantiles")


@query("bin_linear", with_policies(_bin_sql("linear")))
def bin_linear(spark, sf_dir):
    return _bins(spark, sf_dir, "linear")


@query("one_way_quantile", with_policies(
    one_way_sql(["vh_value"], ["event"], "labelled", named=False)))
def one_way_quantile(spark, sf_dir):
    return rounded(one_way(labelled(spark, sf_dir), "vh_value", 10, targets="event"), "event")


@query("one_way_linear", with_policies(
    one_way_sql(["drv_age1"], ["event", "claim_amount"], "labelled", "linear", named=False)))
def one_way_linear(spark, sf_dir):
    df = one_way(
        labelled(spark, sf_dir), "drv_age1", 10, targets=["event", "claim_amount"], method="linear"
    )
    return rounded(df, "event", "claim_amount")


@query("one_way_all_features", with_policies(
    one_way_sql(EFFECT_FEATURES, ["event", "claim_amount"], "labelled")))
def one_way_all_features(spark, sf_dir):
    targets = ["event", "claim_amount"]
    return rounded(one_way_features(labelled(spark, sf_dir), EFFECT_FEATURES, 10, targets=targets), *targets)


@query("one_way_all_features_linear", with_policies(
    one_way_sql(EFFECT_FEATURES, ["event", "claim_amount"], "labelled", "linear")))
def one_way_all_features_linear(spark, sf_dir):
    targets = ["event", "claim_amount"]
    df = one_way_features(
        labelled(spark, sf_dir), EFFECT_FEATURES, 10, targets=targets, method="linear"
    )
    return rounded(df, *targets)


_RESCORED = SCORED + """,
rescored as (select c.*, net, gbt from complete c join scored using (id_policy))"""


def _scored_table(spark, sf_dir, features):
    """Scores written once with the features to bin: edges and bins scan them again."""
    df, pipeline = fitted(spark, sf_dir)
    scored = with_scores(drop_incomplete(df), logistic_scorers(pipeline))
    return materialise(scored.select(*features, "event", "net", "gbt"), "scored")


@query("one_way_scored", with_policies(
    _RESCORED + one_way_sql(["vh_value"], ["event", "net", "gbt"], "rescored", named=False)))
def one_way_scored(spark, sf_dir):
    scored = _scored_table(spark, sf_dir, ["vh_value"])
    return rounded(one_way(scored, "vh_value", 10, targets=["event", "net", "gbt"]), "event", "net", "gbt")


@query("one_way_scored_all", with_policies(
    _RESCORED + one_way_sql(EFFECT_FEATURES, ["event", "net", "gbt"], "rescored")))
def one_way_scored_all(spark, sf_dir):
    scored = _scored_table(spark, sf_dir, EFFECT_FEATURES)
    targets = ["event", "net", "gbt"]
    return rounded(one_way_features(scored, EFFECT_FEATURES, 10, targets=targets), *targets)


# --- distributions ------------------------------------------------------------------

def histogram_sql(column: str, source: str, bins: int = 20) -> str:
    return f"""
select bin, round(lo + bin * width, 6) as lower, n from (
  select least(cast(floor(({column} - lo) / width) as bigint), {bins - 1}) as bin, lo, width, count(*) as n
  from {source}, (select min({column}) as lo, (max({column}) - min({column})) / {bins} as width from {source}) p
  where {column} is not null group by 1, 2, 3) t"""


def kernel_sql(column: str, source: str, points: int = 21) -> str:
    return f""",
params as (select min({column}) as lo, max({column}) as hi,
  0.9 * least(stddev_samp({column}), (quantile_cont({column}, 0.75) - quantile_cont({column}, 0.25)) / 1.34)
  * power(cast(count({column}) as double), -0.2) as h from {source}),
grid as (select lo + i * (hi - lo) / {points - 1} as x, h from params, range({points}) t(i))
select round(x, 6) as x,
  round(avg(exp(-0.5 * power(({column} - x) / h, 2))) / (h * sqrt(2 * pi())), 6) as density
from {source}, grid group by x, h"""


@query("histogram", with_policies(histogram_sql("vh_age", "policies")))
def histogram_vh_age(spark, sf_dir):
    return rounded(histogram(policies(spark, sf_dir), "vh_age", 20), "lower")


@query("histogram_value", with_policies(histogram_sql("vh_value", "policies")))
def histogram_vh_value(spark, sf_dir):
    return rounded(histogram(policies(spark, sf_dir), "vh_value", 20), "lower")


@query("kernel_profile", with_policies(kernel_sql("drv_age1", "policies")))
def kernel_drv_age1(spark, sf_dir):
    return rounded(kernel_profile(policies(spark, sf_dir), "drv_age1", 21), "x", "density")
