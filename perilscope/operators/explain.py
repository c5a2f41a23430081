"""Monte-Carlo Shapley effects and the tables drawn from them.

Sampling scheme of Strumbelj and Kononenko (2014): each draw picks a reference
row and a random feature order; walking the order, features switch one by one
from the reference row to the explained row, and the change in score at a
switch belongs to the feature that switched.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perilscope.functions.expressions import hash_number, seeded_hash
from perilscope.operators.quantiles import order_statistics
from perilscope.operators.sampling import hash_index
from perilscope.operators.scoring import Scorer, with_scores
from perilscope.session import materialise

CURVES_AT_ONCE = 16  # curves whose bandwidths are counted in the same scans

# Raw features shown in the importance and effect tables.
IMPORTANCE_FEATURES = [
    "pol_no_claims_discount", "pol_coverage", "pol_duration",
    "pol_sit_duration", "vh_value", "vh_weight", "vh_age", "population",
    "town_surface_area", "drv_sex1", "drv_sex2", "drv_age1", "pol_pay_freq", "drv_age_lic1",
]
EFFECT_FEATURES = [
    "pol_no_claims_discount", "pol_duration", "pol_sit_duration", "vh_value",
    "vh_weight", "vh_age", "population", "town_surface_area", "drv_age1", "drv_age_lic1",
]


def shap_by_model(
    explain: DataFrame,
    key: str,
    scorers: Mapping[str, Scorer],
    features: Sequence[str],
    targets: Sequence[str] | None = None,
    reference: DataFrame | None = None,
    draws: int = 30,
    seed: int = 123,
    with_spread: bool = False,
) -> DataFrame:
    """Effect of every target feature on every model's score of every explained row.

    Models share the draws, so they are scored on the same rows in one job.
    ``features`` are the raw columns that switch; ``targets`` (default: all) the
    ones reported. ``reference`` defaults to ``explain``; draws come from the whole
    of it. ``with_spread`` adds ``shap_sd``, the deviation of the draws.

    Only keys, draws and drawn places meet the reference rows, of which the ones in a
    drawn digest group are numbered. Rows are expanded and scored where they then
    are; only numbers are summed, per task before the shuffle. The explained values
    are joined back by key.
    """
    features = list(features)
    targets = features if targets is None else list(targets)
    unknown = set(targets) - set(features)
    if unknown:
        raise ValueError(f"targets not among features: {sorted(unknown)}")
    pool = (explain if reference is None else reference).select(key, *features)
    index = hash_index(pool, key, f"reference:{seed}")
    if index.size == 0:
        raise ValueError("the reference table has no rows")
    # own and reference values travel as two structs
    draw = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_draw")
    place = hash_number(seeded_hash(seed, F.col(key), F.col("_draw"))) % index.size
    places = explain.select(key, draw).withColumn("_index", place)
    drawn_rows = index.rows(places).select("_index", F.struct(*features).alias("_ref"))
    own = explain.select(key, F.struct(*features).alias("_own"))
    drawn = places.join(drawn_rows, "_index").join(own, key)
    tickets = {
        f"_ticket_{f}": F.expr(
            f"md5(concat_ws(':', '{seed}', cast(`{key}` as string), cast(_draw as string), '{f}'))"
        )
        for f in features
    }
    ordered = drawn.withColumns(tickets).withColumn("_order", F.sort_array(F.array(*tickets)))
    ranked = ordered.withColumns(
        {f"_rank_{f}": F.expr(f"array_position(_order, `_ticket_{f}`) - 1") for f in features}
    )
    mixed = [
        f"case when `_rank_{f}` < _step then _own.`{f}` else _ref.`{f}` end as `{f}`"
        for f in features
    ]
    hybrids = ranked.withColumn("_step", F.explode(_steps(features, targets))).selectExpr(
        f"`{key}`", "_draw", "_step", *[f"`_rank_{f}`" for f in targets], *mixed
    )
    scored = with_scores(hybrids, {f"_score_{m}": scorer for m, scorer in scorers.items()})

    effects = {(m, f): f"_effect_{m}_{f}" for m in scorers for f in targets}
    def switched(model: str, feature: str) -> str:
        return (
            f"sum(case when _step = `_rank_{feature}` + 1 then `_score_{model}` "
            f"when _step = `_rank_{feature}` then -`_score_{model}` end)"
        )

    if with_spread:
        by_draw = scored.groupBy(key, "_draw").agg(*[F.expr(switched(*k)).alias(n) for k, n in effects.items()])
        wide = by_draw.groupBy(key).agg(
            *[F.expr(f"sum(`{n}`) / {draws}").alias(n) for n in effects.values()],
            *[F.stddev_samp(n).alias(f"{n}_sd") for n in effects.values()],
        )
    else:
        wide = scored.groupBy(key).agg(*[F.expr(f"{switched(*k)} / {draws}").alias(n) for k, n in effects.items()])
    sd = ", `{0}_sd` as shap_sd" if with_spread else ""
    cells = [
        f"struct('{m}' as model, '{f}' as feature_name, "
        f"cast(_own.`{f}` as string) as feature_value, `{name}` as shap_effect{sd.format(name)})"
        for (m, f), name in effects.items()
    ]
    return wide.join(own, key).selectExpr(f"`{key}` as row_id", f"inline(array({', '.join(cells)}))")


def shap_effects(
    explain: DataFrame, key: str, scorer: Scorer, features: Sequence[str], **options
) -> DataFrame:
    """``shap_by_model`` for one model, without the ``model`` column."""
    return shap_by_model(explain, key, {"model": scorer}, features, **options).drop("model")


def _steps(features: list[str], targets: list[str]) -> Column:
    """The hybrids to score: the whole walk, or the two around each target."""
    if 2 * len(targets) > len(features):
        return F.expr(f"sequence(0L, {len(features)}L)")
    around = [f"`_rank_{f}` + {i}" for f in targets for i in (0, 1)]
    return F.expr(f"array_distinct(array({', '.join(around)}))")


def shap_importance(shap: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute effect per feature, smallest first."""
    return (
        shap.groupBy(*by, "feature_name")
        .agg(F.avg(F.abs("shap_effect")).alias("shap_effect"))
        .orderBy(*by, "shap_effect", "feature_name")
    )


def shap_effect_points(shap: DataFrame, feature: str, by: Sequence[str] = ()) -> DataFrame:
    """Feature value against effect for one numeric feature.

    A value that is not a number fails the cast.
    """
    return shap.where(F.col("feature_name") == feature).select(
        *by, "row_id", F.col("feature_value").cast("double").alias("x"), F.col("shap_effect").alias("y")
    )


def loess_curve(points: DataFrame, by: Sequence[str] = (), grid: int = 10, span: float = 1.0) -> DataFrame:
    """Local quadratic regression with tricube weights over the nearest share ``span`` of a curve's points,
    evaluated at ``grid`` equally spaced values from minimum to maximum.

    The bandwidth is the distance to the farthest point, so a curve needs two
    aggregates: the range, then the weighted moments of every grid point. Where
    the points do not determine a parabola the fit falls back to a line and then
    to the weighted mean. The points are written once for the two aggregates.

    With a span below 1 the bandwidth is the distance of the nearest point number ``ceil(span * n)`` (the third at least),
    found for every grid point by counting, ``CURVES_AT_ONCE`` curves at a time. Points at or beyond it have no weight; where
    none is nearer, the value is null.
    """
    if grid < 2:
        raise ValueError("a curve needs two grid points at least")
    if not 0 < span <= 1:
        raise ValueError("a span is above 0 and at most 1")
    clean = materialise(points.where(F.col("x").isNotNull() & F.col("y").isNotNull()), "points")
    spans = clean.groupBy(*by).agg(F.min("x").alias("_low"), F.max("x").alias("_high"))
    if by:
        # one row per curve
        if span < 1:
            spans = _bandwidths(clean, spans, by, grid, span)
        ranged = clean.join(spans.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in spans.columns if c not in by]),
                            [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    else:
        if span < 1:
            spans = _bandwidths(clean, spans, by, grid, span)
        ranged = clean.withColumns({c: F.lit(v).cast("double") for c, v in spans.first().asDict().items()})

    places, distances, weights, moments, cells = {}, {}, {}, [], []
    for i in range(grid):
        places[f"_g{i}"] = F.expr(f"_low + {i} * (_high - _low) / {grid - 1}")
        width = f"greatest(_g{i} - _low, _high - _g{i})"
        if span < 1:
            near = f"when abs(x - _g{i}) >= _h{i} then 1D else (x - _g{i}) / _h{i} end"
            distances[f"_u{i}"] = F.expr(f"case when x = _g{i} then 0D {near}")
        else:
            distances[f"_u{i}"] = F.expr(f"coalesce(try_divide(x - _g{i}, {width}), 0D)")
        cube = f"(1 - abs(_u{i} * _u{i} * _u{i}))"
        weights[f"_w{i}"] = F.expr(f"{cube} * {cube} * {cube}")
        for p in range(5):
            term = " * ".join([f"_w{i}", *[f"_u{i}"] * p])
            moments.append(F.expr(f"sum({term})").alias(f"s{p}_{i}"))
            if p < 3:
                moments.append(F.expr(f"sum({term} * y)").alias(f"t{p}_{i}"))
        cells.append(F.struct(F.col(f"_g{i}").alias("smooth_x"), _centre(i).alias("smooth_y")))
    wide = (
        ranged.withColumns(places)
        .withColumns(distances)
        .withColumns(weights)
        .groupBy(*by, *places)
        .agg(*moments)
    )
    return wide.select(*by, F.inline(F.array(*cells)))


def _bandwidths(points: DataFrame, spans: DataFrame, by: Sequence[str], grid: int, span: float) -> DataFrame:
    """The ranges of the curves with ``_h0``, ``_h1``, ...: the bandwidth at every grid point."""
    curves = spans.collect()  # one row per curve
    rows = []
    for at in range(0, len(curves), CURVES_AT_ONCE):
        some = curves[at : at + CURVES_AT_ONCE]
        away = {}
        for k, curve in enumerate(some):
            own = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(curve[c])) for c in by], F.lit(True))
            for i in range(grid):
                low, high = (F.lit(curve[c]).cast("double") for c in ("_low", "_high"))
                away[f"{k}_{i}"] = F.when(own, F.abs(F.col("x") - (low + i * (high - low) / (grid - 1)))).alias(f"{k}_{i}")
        found = order_statistics(
            points.select(*away.values()), list(away), lambda n: [min(n, max(3, math.ceil(span * n))) - 1]
        )
        for k, curve in enumerate(some):
            widths = [found[f"{k}_{i}"][1] for i in range(grid)]
            rows.append((*curve, *[next(iter(w.values())) if w else None for w in widths]))
    schema = T.StructType([*spans.schema.fields, *[T.StructField(f"_h{i}", T.DoubleType()) for i in range(grid)]])
    return points.sparkSession.createDataFrame(rows, schema)


def _centre(i: int) -> Column:
    """Fitted value at grid point ``i``, from the moments s0..s4 and t0..t2."""
    s0, s1, s2, s3, s4 = (f"s{p}_{i}" for p in range(5))
    t0, t1, t2 = (f"t{p}_{i}" for p in range(3))
    minor = f"({s2} * {s4} - {s3} * {s3})"
    square = (
        f"({s0} * {minor} - {s1} * ({s1} * {s4} - {s2} * {s3}) + {s2} * ({s1} * {s3} - {s2} * {s2}))"
    )
    parabola = (
        f"({t0} * {minor} - {s1} * ({t1} * {s4} - {s3} * {t2}) + {s2} * ({t1} * {s3} - {s2} * {t2}))"
    )
    line = f"({s0} * {s2} - {s1} * {s1})"
    return F.expr(
        f"case when {square} > 1e-10D * {s0} * {s0} * {s0} then try_divide({parabola}, {square}) "
        f"when {line} > 1e-10D * {s0} * {s0} then try_divide({t0} * {s2} - {s1} * {t1}, {line}) "
        f"else try_divide({t0}, {s0}) end"
    )


def shap_explain(shap: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Effects with their size, largest first within each explained row."""
    return shap.withColumn("shap_effect_abs", F.abs("shap_effect")).orderBy(
        *by, "row_id", F.desc("shap_effect_abs"), "feature_name"
    )


def _largest_first(by: Sequence[str]):
    # a window holds one explained row's features, never more
    return Window.partitionBy(*by, "row_id").orderBy(F.desc(F.abs("shap_effect")), "feature_name")


def top_drivers(shap: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` features with the largest effect on each explained row."""
    place = F.row_number().over(_largest_first(by))
    return shap.withColumn("place", place).where(F.col("place") <= k)


def shap_waterfall(shap: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Start and end of every bar of a waterfall: running totals of the effects."""
    window = _largest_first(by)
    running = F.sum("shap_effect").over(window.rowsBetween(Window.unboundedPreceding, 0))
    return shap.withColumns(
        {"place": F.row_number().over(window), "bar_end": running}
    ).withColumn("bar_start", F.col("bar_end") - F.col("shap_effect"))
