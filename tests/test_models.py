import math
import threading

import pytest
from pyspark.sql import functions as F

from perilscope.operators import models as M
from perilscope.operators.explain import shap_by_model
from perilscope.operators.sampling import sample_rows
from perilscope.operators.selection import drop_incomplete
from perilscope.operators.scoring import with_scores
from perilscope.plans.catalog import labelled
from perilscope.plans.explain import FEATURES
from perilscope.session import job_folder
from perilscope.sources import files


@pytest.fixture(scope="module")
def training(fitted_policies):
    df, pipeline = fitted_policies
    return df, pipeline, M.training_table(df, pipeline, "event", "is_train")


def base_loss(table):
    p = table.where("not is_eval").agg(F.avg("label")).first()[0]
    y = table.where("is_eval").agg(F.avg("label")).first()[0]
    return -(y * math.log(p) + (1 - y) * math.log(1 - p))


def test_sweeps_have_one_row_per_setting_and_beat_the_base_rate(spark, training):
    _, pipeline, table = training
    trees = M.sweep_gbt(table, pipeline, depths=[2, 3], rounds=5)
    nets = M.sweep_mlp(table, pipeline, widths=[8, 16], rounds=15, parallelism=1)
    assert [r["max_depth"] for r in trees.results(spark).orderBy("max_depth").collect()] == [2, 3]
    assert [r["h1"] for r in nets.results(spark).orderBy("h1").collect()] == [8, 16]
    base = base_loss(table)
    assert max(trees.metrics) < base and min(nets.metrics) < base
    setting, _ = trees.best()
    assert trees.metrics[trees.settings.index(setting)] == min(trees.metrics)


def test_same_seed_same_metric(training):
    _, pipeline, table = training
    runs = [M.table_log_loss(M.fit_gbt(table, pipeline, 2, 3), table) for _ in range(2)]
    assert runs[0] == pytest.approx(runs[1], abs=1e-12)


def test_saved_model_scores_the_same_and_unused_feature_has_no_effect(spark, training):
    df, pipeline, table = training
    scorer = M.fit_gbt(table, pipeline, 3, 3)
    path = job_folder(spark, "scorer")
    files.save_scorer(scorer, spark, path)
    both = with_scores(df, {"a": scorer, "b": files.load_scorer(spark, path)})
    assert both.where("abs(a - b) > 1e-12 or a is null").count() == 0
    assert both.where("a < 0 or a > 1").count() == 0
    assert set(df.columns) < set(both.columns)

    whole = drop_incomplete(df)
    shap = shap_by_model(
        sample_rows(whole, "id_policy", 3), "id_policy", {"gbt": scorer}, FEATURES,
        draws=5, reference=whole,
    )
    unused = shap.where("feature_name = 'pol_pay_freq'").agg(F.max(F.abs("shap_effect"))).first()[0]
    assert unused == pytest.approx(0.0, abs=1e-12)


def test_frequency_severity_is_calibrated(spark, sf_dir):
    df = labelled(spark, sf_dir)
    fitted = M.fit_frequency_severity(df)
    out = fitted.premium(df, loading=0.5)
    assert out.count() == df.count()
    row = out.agg(F.avg("frequency"), F.avg("expected_claim"), F.min("expected_claim"),
                  F.max(F.abs(F.col("premium") - 1.5 * F.col("expected_claim")))).first()
    rate, claim = df.agg(F.avg("event"), F.avg("claim_amount")).first()
    assert row[0] == pytest.approx(rate, rel=0.1)
    assert row[1] == pytest.approx(claim, rel=0.25)
    assert row[2] > 0 and row[3] == pytest.approx(0.0, abs=1e-6)
    assert len(fitted.frequency.models) == len(fitted.severity.models) == 5

    path = job_folder(spark, "freq-sev")
    fitted.save(spark, path)
    again = M.FrequencySeverity.load(spark, path).premium(df, loading=0.5)
    both = out.join(again.withColumnRenamed("premium", "other").select("id_policy", "other"), "id_policy")
    assert both.where("abs(premium - other) < 1e-6").count() == df.count()


def test_a_fit_does_not_depend_on_the_layout(spark, fitted_policies):
    df, pipeline = fitted_policies
    losses = []
    for n in (1, 3, 7):
        table = M.training_table(df.repartition(n, F.rand(n)), pipeline, "event", "is_train")
        losses.append(M.table_log_loss(M.fit_gbt(table, pipeline, max_depth=3, rounds=4), table))
    assert losses[0] == pytest.approx(losses[1], abs=1e-12) and losses[0] == pytest.approx(losses[2], abs=1e-12)


def test_pure_premium_is_saved_whole(spark, fitted_policies):
    df, _ = fitted_policies
    model = M.fit_pure_premium(df)
    path = job_folder(spark, "pure")
    model.save(spark, path)
    again = M.PurePremium.load(spark, path).expected_claim(df).withColumnRenamed("expected_claim", "again")
    both = model.expected_claim(df).join(again, "id_policy")
    assert both.count() == df.count() and both.where("abs(expected_claim - again) > 1e-9").count() == 0


def test_design_rows_are_compiled_in_small_methods(spark):
    """A whole-stage method of 61 columns is too long for the JVM's compiler; the levels are those of plain comparisons."""
    from perilscope.operators import design
    from perilscope.sources.tables import POLICY_SCHEMA

    names = POLICY_SCHEMA.names
    rows = [tuple(m if n == "vh_make_model" else k if n == "id_policy" else None for n in names) for k, m in enumerate(["a", "b", "z", None, "OTHER"])]
    matrix = design.DesignMatrix({c: 0.0 for c in design.NUMERIC_COLUMNS}, ["b", "a"])
    out = matrix.vectors_ready(spark.createDataFrame(rows, POLICY_SCHEMA), ["id_policy"])
    found = {r[0]: tuple(r)[1:] for r in out.select("id_policy", *[f"vh_make_model_{v}" for v in ("b", "a", "OTHER")]).collect()}
    assert found == {0: (0, 1, 0), 1: (1, 0, 0), 2: (0, 0, 1), 3: (0, 0, 1), 4: (0, 0, 1)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.lstrip().startswith("Project")


def test_fits_wait_for_each_other(spark):
    both = threading.Barrier(2, timeout=30)
    assert M.at_the_same_time(lambda: (both.wait(), 1)[1], lambda: (both.wait(), 2)[1]) == [1, 2]
