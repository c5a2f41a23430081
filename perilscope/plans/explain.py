"""Queries over Shapley effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from perilscope.operators import explain as E
from perilscope.operators.selection import drop_incomplete
from perilscope.operators.sampling import sample_rows
from perilscope.plans.catalog import (
    GBT_LOGIT, NET_LOGIT, STATISTICS, derived_select, fitted, logistic_scorers, prepared_select,
    query, rounded, sigmoid_sql, with_policies,
)

# every raw column a model reads, and one it does not (pol_pay_freq)
FEATURES = [*E.IMPORTANCE_FEATURES, "vh_speed"]
ROWS, DRAWS = 30, 30


def shap_sql(features, rows: int = ROWS, draws: int = DRAWS) -> str:
    """``shap(model, row_id, feature_name, feature_value, shap_effect)`` as SQL."""
    own = ", ".join(f"e.{f} as own_{f}" for f in features)
    ref = ", ".join(f"r.{f} as ref_{f}" for f in features)
    tickets = ", ".join(
        f"md5('123:' || cast(id_policy as varchar) || ':' || cast(draw as varchar) || ':{f}') as t_{f}"
        for f in features
    )
    ranks = ", ".join(
        "(" + " + ".join(f"(case when t_{g} < t_{f} then 1 else 0 end)" for g in features if g != f)
        + f") as rank_{f}"
        for f in features
    )
    mixed = ", ".join(f"case when rank_{f} < step then own_{f} else ref_{f} end as {f}" for f in features)
    keep = ", ".join(["id_policy", "step", *[f"rank_{f}" for f in features], *[f"own_{f}" for f in features]])
    change = "case when step = rank_{f} + 1 then {m} when step = rank_{f} then -{m} end"
    parts = "\nunion all ".join(
        f"select '{m}' as model, id_policy as row_id, '{f}' as feature_name, "
        f"any_value(own_{f}) as own, sum({change.format(f=f, m=m)}) / {draws} as shap_effect "
        f"from scored group by id_policy"
        for m in ("net", "gbt") for f in features
    ).replace("any_value(own_", "any_value(text_")
    texts = ", ".join(f"cast(own_{f} as varchar) as text_{f}" for f in features)
    return STATISTICS + f""",
explained as (select * from complete order by md5('123:' || cast(id_policy as varchar)) limit {rows}),
reference as (select *, row_number() over (order by md5('reference:123:' || cast(id_policy as varchar))) - 1 as idx,
  count(*) over () as size from complete),
drawn as (select e.id_policy, d.draw, {own}, {ref}
  from explained e cross join (select unnest(range({draws})) as draw) d
  join reference r on r.idx = cast('0x' || substr(md5('123:' || cast(e.id_policy as varchar) || ':'
    || cast(d.draw as varchar)), 1, 13) as bigint) % r.size),
tickets as (select *, {tickets} from drawn),
ranked as (select *, {ranks} from tickets),
hybrids as (select {keep}, {mixed} from ranked cross join (select unnest(range({len(features) + 1})) as step) s),
hybrid_derived as ({derived_select(keep, "hybrids")}),
hybrid_ready as ({prepared_select(keep, "hybrid_derived")}),
scored as (select {keep}, {texts}, {sigmoid_sql(NET_LOGIT)} as net, {sigmoid_sql(GBT_LOGIT)} as gbt from hybrid_ready),
shap as (select model, row_id, feature_name, own as feature_value, shap_effect from ({parts}) t)"""


SHAP = shap_sql(FEATURES)
# single rows: the first of the sampled ones
SHAP_ONE = shap_sql(FEATURES, rows=1)


def _shap(spark, sf_dir, rows=ROWS, targets=None):
    df, pipeline = fitted(spark, sf_dir)
    whole = drop_incomplete(df)
    return E.shap_by_model(
        sample_rows(whole, "id_policy", rows),
        "id_policy",
        logistic_scorers(pipeline),
        features=FEATURES,
        targets=targets,
        reference=whole,
        draws=DRAWS,
    )


def _net(shap):
    return shap.where(F.col("model") == "net").drop("model")


@query("shap_long", with_policies(SHAP + """
select row_id, feature_name, feature_value, round(shap_effect, 6) + 0 as shap_effect from shap where model = 'net'"""))
def shap_long(spark, sf_dir):
    df, pipeline = fitted(spark, sf_dir)
    whole = drop_incomplete(df)
    shap = E.shap_effects(
        sample_rows(whole, "id_policy", ROWS), "id_policy", logistic_scorers(pipeline)["net"],
        FEATURES, reference=whole, draws=DRAWS,
    )
    return shap.withColumn("shap_effect", F.round("shap_effect", 6) + 0)


@query("shap_importance", with_policies(SHAP + """
select model, feature_name, round(avg(abs(shap_effect)), 6) as shap_effect from shap group by 1, 2"""))
def shap_importance(spark, sf_dir):
    return rounded(E.shap_importance(_shap(spark, sf_dir), ["model"]), "shap_effect")


_POINTS = SHAP + """,
points as (select model, row_id, cast(feature_value as double) as x, shap_effect as y
  from shap where feature_name = 'vh_value')"""


@query("shap_effect_points", with_policies(_POINTS + """
select model, row_id, round(x, 6) as x, round(y, 6) + 0 as y from points"""))
def shap_effect_points(spark, sf_dir):
    shap = _shap(spark, sf_dir, targets=["vh_value"])
    points = E.shap_effect_points(shap, "vh_value", ["model"])
    return points.withColumns({"x": F.round("x", 6), "y": F.round("y", 6) + 0})


def loess_sql(points: str, by: str | None, grid: int = 10, span: float = 1) -> str:
    """Local quadratic fit with tricube weights over the nearest share ``span`` of a curve's points."""
    key = by or "1"
    near = f"""near as (select g.*, p.y, (p.x - gx) / nullif(greatest(gx - lo, hi - gx), 0) as u
  from grid g join (select {key} as curve, x, y from {points}) p using (curve))"""
    if span < 1:
        near = f"""pairs as (select g.*, p.x, p.y, abs(p.x - gx) as away, count(*) over (partition by curve, g) as n,
  row_number() over (partition by curve, g order by abs(p.x - gx)) as place
  from grid g join (select {key} as curve, x, y from {points} where x is not null and y is not null) p using (curve)),
reached as (select *, max(case when place = greatest(ceil({span} * n), 3) then away end) over (partition by curve, g) as h from pairs),
near as (select curve, gx, y, (x - gx) / h as u from reached where away < h)"""
    return f""",
ranges as (select {key} as curve, min(x) as lo, max(x) as hi from {points} group by 1),
grid as (select curve, g, lo, hi, lo + g * (hi - lo) / {grid - 1} as gx from ranges, range({grid}) t(g)),
{near},
weighted as (select *, power(1 - power(abs(u), 3), 3) as w from near),
moments as (select curve, gx,
  {", ".join(f"sum(w * power(u, {p})) as s{p}" for p in range(5))},
  {", ".join(f"sum(w * power(u, {p}) * y) as t{p}" for p in range(3))} from weighted group by curve, gx),
smooth as (select curve, gx as smooth_x,
  (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2))
  / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)) as smooth_y from moments)"""


@query("shap_effect_curve", with_policies(_POINTS + loess_sql("points", "model") + """
select curve as model, round(smooth_x, 4) as smooth_x, round(smooth_y, 6) + 0 as smooth_y from smooth"""))
def shap_effect_curve(spark, sf_dir):
    shap = _shap(spark, sf_dir, targets=["vh_value"])
    curve = E.loess_curve(E.shap_effect_points(shap, "vh_value", ["model"]), ["model"])
    return curve.withColumns(
        {"smooth_x": F.round("smooth_x", 4), "smooth_y": F.round("smooth_y", 6) + 0}
    )


@query("loess_whole_table", with_policies(""",
points as (select vh_value as x, claim_amount as y from policies)""" + loess_sql("points", None) + """
select round(smooth_x, 4) as smooth_x, round(smooth_y, 4) as smooth_y from smooth"""))
def loess_whole_table(spark, sf_dir):
    from perilscope.sources.tables import policies

    points = policies(spark, sf_dir).select(F.col("vh_value").alias("x"), F.col("claim_amount").alias("y"))
    curve = E.loess_curve(points)
    return curve.withColumns({"smooth_x": F.round("smooth_x", 4), "smooth_y": F.round("smooth_y", 4)})


@query("shap_explain", with_policies(SHAP_ONE + """
select model, row_id, feature_name, feature_value, round(shap_effect, 6) + 0 as shap_effect,
  round(abs(shap_effect), 6) as shap_effect_abs from shap"""))
def shap_explain(spark, sf_dir):
    df = E.shap_explain(_shap(spark, sf_dir, rows=1), ["model"])
    return df.withColumns(
        {"shap_effect": F.round("shap_effect", 6) + 0, "shap_effect_abs": F.round("shap_effect_abs", 6)}
    )


@query("shap_top_drivers", with_policies(SHAP + """
select model, row_id, feature_name, round(shap_effect, 6) as shap_effect, place from (
  select *, cast(row_number() over (partition by model, row_id order by abs(shap_effect) desc, feature_name) as int) as place
  from shap) t where place <= 3"""))
def shap_top_drivers(spark, sf_dir):
    df = E.top_drivers(_shap(spark, sf_dir), 3, ["model"])
    return rounded(df.select("model", "row_id", "feature_name", "shap_effect", "place"), "shap_effect")


@query("shap_waterfall", with_policies(SHAP + """
select row_id, round(max(bar_end), 6) + 0 as top, round(min(bar_end), 6) + 0 as bottom,
  round(sum(shap_effect), 6) + 0 as total from (
  select row_id, shap_effect, sum(shap_effect) over (partition by row_id
    order by abs(shap_effect) desc, feature_name rows unbounded preceding) as bar_end
  from shap where model = 'net') t group by row_id"""))
def shap_waterfall(spark, sf_dir):
    bars = E.shap_waterfall(_net(_shap(spark, sf_dir)))
    return bars.groupBy("row_id").agg(
        (F.round(F.max("bar_end"), 6) + 0).alias("top"),
        (F.round(F.min("bar_end"), 6) + 0).alias("bottom"),
        (F.round(F.sum("shap_effect"), 6) + 0).alias("total"),
    )


@query("loess_local", with_policies(""",
points as (select vh_value as x, claim_amount as y from policies)""" + loess_sql("points", None, span=0.5) + """
select round(smooth_x, 4) as smooth_x, round(smooth_y, 4) as smooth_y from smooth"""))
def loess_local(spark, sf_dir):
    """A curve that follows the nearest half of the points."""
    from perilscope.sources.tables import policies

    points = policies(spark, sf_dir).select(F.col("vh_value").alias("x"), F.col("claim_amount").alias("y"))
    curve = E.loess_curve(points, span=0.5)
    return curve.withColumns({"smooth_x": F.round("smooth_x", 4), "smooth_y": F.round("smooth_y", 4)})
