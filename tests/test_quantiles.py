import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilscope.operators import quantiles as Q
from perilscope.operators.design import column_medians
from perilscope.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.77, 0.9, 1.0]


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


def samples():
    rng = np.random.default_rng(1)
    return {
        "uniform": rng.random(5000),
        "heavy tail": np.exp(rng.normal(0, 6, 4001)),
        "both signs": rng.normal(0, 1, 3000) ** 3,
        "one third equal": np.concatenate([np.full(2000, 7.5), rng.normal(7, 2, 4000)]),
        "few values": rng.integers(0, 5, 999),
        "constant": np.full(50, 3.0),
        "two rows": np.array([1.0, 2.0]),
        "one row": np.array([4.0]),
        "grid": np.arange(10001),
        "neighbouring doubles": np.nextafter(1.0, 2.0) + np.arange(3000) * 2.0**-52,
        "subnormal": np.arange(-500, 500) * 5e-324,
    }


@pytest.mark.parametrize("name", list(samples()))
def test_matches_numpy(spark, name):
    data = samples()[name]
    got = exact_quantiles(frame(spark, data), ["x"], PROBS)["x"]
    assert got == pytest.approx(np.quantile(data, PROBS).tolist(), rel=1e-12, abs=1e-323)


@pytest.mark.parametrize(
    "data,median",
    [
        ([1, 2, 3, 4, math.inf], 3.0),
        ([-math.inf, -math.inf, 5, 6, 7], 5.0),
        ([1, 2, 3, 4, math.nan], 3.0),
        ([1, math.nan, math.nan], math.nan),
        ([-1.7e308, 1, 2, 3, 1.7e308], 2.0),
        ([-1.7e308, 1.7e308], 0.0),
        ([0.0, -0.0, 0.0], 0.0),
        ([math.inf, math.inf], math.inf),
        ([-math.inf, math.inf], math.nan),
    ],
)
def test_special_values(spark, data, median):
    got = exact_quantiles(frame(spark, data), ["x"], [0.5])["x"][0]
    assert got == median or (math.isnan(got) and math.isnan(median))


def test_rounds_are_bounded(spark, monkeypatch):
    rounds = []
    counted = Q._counted
    monkeypatch.setattr(Q, "_counted", lambda *a: rounds.append(1) or counted(*a))
    rng = np.random.default_rng(3)
    spread = np.concatenate([rng.random(3000), np.exp(rng.normal(0, 200, 2000)), [math.inf, math.nan]])
    exact_quantiles(frame(spark, spread), ["x"], PROBS)
    assert len(rounds) <= 10


def test_columns_are_searched_together(spark):
    data = samples()["uniform"]
    df = frame(spark, data).withColumn("y", F.col("x") * 100 - 3)
    both = exact_quantiles(df, ["x", "y"], PROBS)
    assert both["x"] == exact_quantiles(df, ["x"], PROBS)["x"]
    assert both["y"] == exact_quantiles(df, ["y"], PROBS)["y"]


def test_nulls_are_skipped_and_empty_columns_reported(spark):
    df = frame(spark, [None, 1.0, 3.0]).withColumn("none", F.lit(None).cast("double"))
    assert exact_quantiles(df, ["x", "none"], [0.5]) == {"x": [2.0], "none": None}
    assert exact_quantiles(df, ["x"], []) == {"x": []} and exact_quantiles(df, [], [0.5]) == {}
    assert exact_quantiles(df.limit(0), ["x"], [0.5]) == {"x": None}
    assert column_medians(df, ["x", "none"]) == {"x": 2.0, "none": None}


def test_no_task_gets_value_counts(spark, monkeypatch):
    """Every grouped count is dealt by (column, cell)."""
    plans = []
    counted = Q._counted
    materialise = Q.materialise

    def spied(values, cells):
        parts = [F.struct(F.lit(i).alias("i"), c.cast("long").alias("cell"), F.col(f"x{i}").alias("x")) for i, c in cells.items()]
        grouped = values.select(F.inline(F.array(*parts))).groupBy("i", "cell").count()
        plans.append(grouped._jdf.queryExecution().executedPlan().toString())
        return counted(values, cells)

    monkeypatch.setattr(Q, "_counted", spied)
    exact_quantiles(frame(spark, range(5000)), ["x"], PROBS)
    assert materialise is Q.materialise and plans
    assert all("SinglePartition" not in p and "percentile" not in p and "partial_count" in p for p in plans)


def test_a_round_hands_on_counts_only(spark, monkeypatch):
    """However many columns, the rows that a round shuffles are those of cells, not one per value and column."""
    data = np.random.default_rng(8).integers(0, 5, 4000)
    df = frame(spark, data.astype(float)).repartition(2).select(*[(F.col("x") * k).alias(f"c{k}") for k in range(1, 9)])
    plans, counted = [], Q._counted
    monkeypatch.setattr(Q, "_counted", lambda values, cells: plans.append(values) or counted(values, cells))
    assert exact_quantiles(df, df.columns, [0.5]) == {f"c{k}": [float(np.median(data) * k)] for k in range(1, 9)}
    rows = Q._counted(plans[0], {i: Q._Cells(f"x{i}") for i in range(8)})
    assert sum(len(r) for r in rows.values()) <= 8 * 4 and sum(c["n"] for c in rows[0]) == 4000


def test_classes_ascend_with_their_values():
    x = np.array([-np.inf, -1e308, -2.0, -1.5, -1e-310, 0.0, 5e-324, 1.0, 1.9999, 2.0, 8.0, 1e308, np.inf, np.nan])
    found = Q._class(x)
    assert (np.diff(found) >= 0).all() and found[7] == found[8] < found[9] < found[10] and found[5] == Q.NOT_A_NUMBER
