"""The physical plans: no Python, no data through one task, pruned scans."""

import re

import pytest

from perilscope.operators import aggregates as A
from perilscope.operators import sampling as S
from perilscope.operators.oneway import one_way
from perilscope.operators.selection import drop_incomplete
from perilscope.operators.whatif import whatif_spread
from perilscope.plans.catalog import labelled, logistic_scorers
from perilscope.plans.registry import QUERIES
from perilscope.sources.tables import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return [line for line in text.splitlines() if re.search(r"\bExchange ", line)]


@pytest.fixture(scope="module")
def whole(fitted_policies):
    return drop_incomplete(fitted_policies[0])


def test_preprocessing_and_scoring_only_project(fitted_policies):
    df, pipeline = fitted_policies
    scored = logistic_scorers(pipeline)["net"](df, "score").select("id_policy", "score")
    text = plan(scored)
    assert "Python" not in text
    # the fixture's own joins, and nothing else
    assert len(exchanges(text)) == len(exchanges(plan(df.select("id_policy", "vh_value"))))


def test_whatif_does_not_shuffle(fitted_policies):
    df, pipeline = fitted_policies
    spread = whatif_spread(df, "drv_age1", 40, 60, logistic_scorers(pipeline)["net"])
    assert len(exchanges(plan(spread.select("spread")))) == len(exchanges(plan(df)))


def test_split_is_a_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    train, rest = S.split(orders, "o_orderkey")
    for part in (train, rest):
        text = plan(part)
        assert not exchanges(text) and "Window" not in text
        assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_one_way_combines_before_the_shuffle(spark, sf_dir):
    text = plan(one_way(labelled(spark, sf_dir), "vh_value", targets="event"))
    assert "partial_avg" in text and "Python" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "SinglePartition" not in text


def test_the_registered_shapley_query_sums_numbers(spark, sf_dir):
    text = plan(QUERIES["shap_importance"](spark, sf_dir))
    assert "Python" not in text and "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text and "SortAggregate" not in text
    assert "partial_sum" in text
    # the one window numbers reference rows of drawn digest groups
    window = text[text.index("Window"):]
    assert text.count("Window [") == 1 and "LeftSemi" in window


def test_group_statistics_use_no_window(spark, sf_dir):
    from pyspark.sql import functions as F

    lines = table(spark, sf_dir, "lineitem")
    text = plan(A.with_group_statistics(lines, "l_returnflag", mean=F.avg("l_tax")))
    assert "Window" not in text and "partial_avg" in text


def test_filters_reach_the_scan(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey")
    text = plan(lines)
    assert "GreaterThan(l_quantity,45.0)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
