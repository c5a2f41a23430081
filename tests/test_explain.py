import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilscope.operators import explain as E
from perilscope.operators.sampling import sample_rows
from perilscope.operators.selection import drop_incomplete
from perilscope.plans.catalog import logistic_scorers
from perilscope.plans.explain import FEATURES

WEIGHTS = {"a": 2.0, "b": -1.0, "c": 0.5}


def linear(df, output):
    return df.withColumn(output, F.expr(" + ".join(f"{w} * {c}" for c, w in WEIGHTS.items())))


def product(df, output):
    return df.withColumn(output, F.col("a") * F.col("b") + F.col("c"))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    return [(i, *map(float, rng.normal(size=3).round(3)), float(rng.integers(9))) for i in range(40)]


@pytest.fixture(scope="module")
def data(spark, rows):
    return spark.createDataFrame(rows, "k long, a double, b double, c double, unused double")


def digest(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def brute_force(rows, explained, features, score, draws, seed):
    """The same draws, walked one feature at a time."""
    names = ["k", "a", "b", "c", "unused"]
    reference = sorted(rows, key=lambda r: digest(f"reference:{seed}", r[0]))
    effects = {}
    for own in explained:
        total = dict.fromkeys(features, 0.0)
        for draw in range(draws):
            other = reference[int(digest(seed, own[0], draw)[:13], 16) % len(reference)]
            order = sorted(features, key=lambda f: digest(seed, own[0], draw, f))
            mixed = dict(zip(names, other))
            before = score(mixed)
            for f in order:
                mixed[f] = own[names.index(f)]
                after = score(mixed)
                total[f] += after - before
                before = after
        effects.update({(own[0], f): t / draws for f, t in total.items()})
    return effects


@pytest.mark.parametrize("targets", [None, ["b"]], ids=["all", "one target"])
def test_matches_brute_force(data, rows, targets):
    features = ["a", "b", "c", "unused"]
    explained = data.where("k < 5")
    got = E.shap_effects(explained, "k", product, features, targets=targets, reference=data, draws=7, seed=11)
    want = brute_force(rows, rows[:5], features, lambda r: r["a"] * r["b"] + r["c"], 7, 11)
    want = {k: v for k, v in want.items() if targets is None or k[1] in targets}
    got = {(r["row_id"], r["feature_name"]): r["shap_effect"] for r in got.collect()}
    assert got.keys() == want.keys()
    assert [got[k] for k in want] == pytest.approx(list(want.values()), abs=1e-12)


def test_unused_feature_has_no_effect(data):
    shap = E.shap_effects(data, "k", linear, [*WEIGHTS, "unused"], draws=10)
    worst = shap.where("feature_name = 'unused'").agg(F.max(F.abs("shap_effect"))).first()[0]
    assert worst == pytest.approx(0.0, abs=1e-12)


def test_effects_add_up_for_fitted_scorers(fitted_policies):
    df, pipeline = fitted_policies
    whole = drop_incomplete(df)
    explained = sample_rows(whole, "id_policy", 10)
    scorer = logistic_scorers(pipeline)["net"]
    shap = E.shap_effects(explained, "id_policy", scorer, FEATURES, draws=200, reference=whole)
    totals = {r[0]: r[1] for r in shap.groupBy("row_id").agg(F.sum("shap_effect")).collect()}
    own = {r[0]: r[1] for r in scorer(explained, "score").select("id_policy", "score").collect()}
    mean = scorer(whole, "score").agg(F.avg("score")).first()[0]
    # sum of effects = own score minus mean score of the drawn rows
    for key, total in totals.items():
        assert total == pytest.approx(own[key] - mean, abs=0.1)


def test_spread_of_the_draws(data, rows):
    features = ["a", "b", "c"]
    plain = E.shap_effects(data.where("k < 4"), "k", product, features, reference=data, draws=9, seed=11)
    spread = E.shap_effects(
        data.where("k < 4"), "k", product, features, reference=data, draws=9, seed=11, with_spread=True
    )
    both = spread.join(plain.withColumnRenamed("shap_effect", "plain"), ["row_id", "feature_name"]).collect()
    assert len(both) == 12 and all(r["plain"] == pytest.approx(r["shap_effect"], abs=1e-12) for r in both)
    assert all(r["shap_sd"] >= 0 for r in both) and any(r["shap_sd"] > 0 for r in both)
    one = E.shap_effects(data, "k", linear, list(WEIGHTS), reference=data.where("k = 3"), draws=3, with_spread=True)
    assert one.where("shap_sd > 1e-9").count() == 0


def test_one_reference_row_is_the_closed_form(data, rows):
    only = data.where("k = 3")
    shap = E.shap_effects(data, "k", linear, list(WEIGHTS), reference=only, draws=3)
    for r in shap.collect():
        place = "kabc".index(r["feature_name"])
        want = WEIGHTS[r["feature_name"]] * (rows[r["row_id"]][place] - rows[3][place])
        assert r["shap_effect"] == pytest.approx(want, abs=1e-12)


def test_wrong_arguments(data):
    with pytest.raises(ValueError):
        E.shap_effects(data, "k", linear, ["a"], targets=["z"])
    with pytest.raises(ValueError):
        E.shap_effects(data, "k", linear, list(WEIGHTS), reference=data.where("k < 0"))


def curve(spark, points):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double")
    return {r["smooth_x"]: r["smooth_y"] for r in E.loess_curve(df).collect()}


def test_loess_reproduces_a_parabola(spark):
    got = curve(spark, [(x / 7, (x / 7) ** 2 - x) for x in range(60)])
    assert len(got) == 10
    for x, y in got.items():
        assert y == pytest.approx(x * x - 7 * x, abs=1e-8)


def test_loess_falls_back_on_few_points(spark):
    line = curve(spark, [(0, 1), (10, 3)])
    assert line[0.0] == pytest.approx(1.0) and line[10.0] == pytest.approx(3.0)
    assert set(curve(spark, [(4, 1), (4, 3)]).values()) == {2.0}


def test_loess_curves_by_group_equal_single_curves(spark):
    points = [(m, float(x), float((x * 7) % 5 + m)) for m in (0, 1) for x in range(20 + m)]
    df = spark.createDataFrame(points, "m int, x double, y double")
    grouped = E.loess_curve(df, ["m"]).collect()
    for m in (0, 1):
        alone = E.loess_curve(df.where(F.col("m") == m).drop("m")).collect()
        both = [(r["smooth_x"], r["smooth_y"]) for r in grouped if r["m"] == m]
        assert both == [pytest.approx(tuple(r)) for r in alone]


def test_explain_tables(spark):
    shap = spark.createDataFrame(
        [(1, "a", "x", 0.5), (1, "b", "x", -2.0), (1, "c", "x", 1.0)],
        "row_id long, feature_name string, feature_value string, shap_effect double",
    )
    assert [r["feature_name"] for r in E.shap_explain(shap).collect()] == ["b", "c", "a"]
    assert [r["feature_name"] for r in E.top_drivers(shap, 2).orderBy("place").collect()] == ["b", "c"]
    bars = E.shap_waterfall(shap).orderBy("place").collect()
    assert [(r["bar_start"], r["bar_end"]) for r in bars] == [(0.0, -2.0), (-2.0, -1.0), (-1.0, -0.5)]
    assert [r["feature_name"] for r in E.shap_importance(shap).collect()] == ["a", "c", "b"]


def test_effect_of_a_text_feature_is_refused(spark):
    shap = spark.createDataFrame(
        [(1, "a", "Max", 0.5)],
        "row_id long, feature_name string, feature_value string, shap_effect double",
    )
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        E.shap_effect_points(shap, "a").collect()


def local_fit(points, at, span):
    """Weighted least squares of a parabola through the nearest share of the points."""
    x, y = np.array(points, float).T
    away = np.abs(x - at)
    width = np.sort(away)[min(len(x), max(3, math.ceil(span * len(x)))) - 1]
    u = np.minimum(away / width, 1)
    w = np.sqrt((1 - u**3) ** 3)
    basis = np.stack([np.ones(len(x)), x - at, (x - at) ** 2], 1)
    return np.linalg.lstsq(basis * w[:, None], y * w, rcond=None)[0][0]


@pytest.mark.parametrize("span", [0.2, 0.5, 0.99])
def test_local_loess_equals_least_squares_of_every_curve(spark, span):
    r = np.random.default_rng(7)
    points = [(m, float(x), float(np.sin(x) * (m + 1) + e)) for m in (0, 1) for x, e in zip(r.uniform(0, 9, 120 + m), r.normal(0, 0.1, 200))]
    df = spark.createDataFrame([*points, (0, None, 1.0), (1, 2.0, None)], "m int, x double, y double")
    got = E.loess_curve(df, ["m"], span=span).collect()
    assert len(got) == 20
    for row in got:
        own = [(x, y) for m, x, y in points if m == row["m"]]
        assert row["smooth_y"] == pytest.approx(local_fit(own, row["smooth_x"], span), rel=1e-7, abs=1e-9)


def test_local_loess_of_many_curves_ties_and_no_points(spark, monkeypatch):
    monkeypatch.setattr(E, "CURVES_AT_ONCE", 2)
    df = spark.createDataFrame([(m, float(x), float(x * x + m)) for m in range(5) for x in range(12)], "m int, x double, y double")
    for row in E.loess_curve(df, ["m"], grid=4, span=0.6).collect():
        assert row["smooth_y"] == pytest.approx(row["smooth_x"] ** 2 + row["m"])
    # all points stand on one place: no point is nearer than the bandwidth but those at distance 0
    tied = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0), (2.0, 5.0), (2.0, 7.0)], "x double, y double")
    assert {r["smooth_y"] for r in E.loess_curve(tied, span=0.5).collect()} == {4.0}
    assert E.loess_curve(tied.limit(0), span=0.5).count() == 0
    with pytest.raises(ValueError):
        E.loess_curve(tied, span=0.0)
