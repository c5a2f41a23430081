"""Aggregates written in Python: any split of the rows gives the same result, and no group enters a task whole."""

import pytest
from pyspark.sql import functions as F

from perilscope.operators import aggregates as A

def spread():
    """Count, mean and sum of squared differences, joined pairwise; local functions, which travel to tasks by value."""
    def join(a, b):
        n = a[0] + b[0]
        if not n:
            return a
        step = b[1] - a[1]
        return n, a[1] + step * b[0] / n, a[2] + b[2] + step * step * a[0] * b[0] / n

    def add(state, rows):
        mean = float(rows["x"].mean())
        return join(state, (len(rows), mean, float(((rows["x"] - mean) ** 2).sum())))

    def finish(state):
        return (state[2] / (state[0] - 1)) ** 0.5 if state[0] > 1 else None

    return {"zero": lambda: (0, 0.0, 0.0), "add": add, "merge": join, "finish": finish}


SPREAD = spread()


def table(spark, parts):
    rows = [("hot" if k % 2 else f"g{k % 7}" if k % 14 else None, k % 3 if k % 5 else None, float(k * k % 101)) for k in range(700)]
    rows.append(("alone", 2**60 + 1, 4.0))
    return spark.createDataFrame(rows, "g string, h long, x double").repartition(parts, F.rand(parts))


@pytest.mark.parametrize("parts,held", [(1, 100_000), (7, 100_000), (5, 2)])
def test_equal_to_the_built_in_one(spark, parts, held, monkeypatch):
    monkeypatch.setattr(A, "STATES_HELD", held)
    df = table(spark, parts)
    out = A.python_aggregate(df, ["g", "h"], ["x"], **SPREAD, output="spread")
    assert out.columns == ["g", "h", "spread"]
    got = {(r["g"], r["h"]): r["spread"] for r in out.collect()}
    want = {(r["g"], r["h"]): r["s"] for r in df.groupBy("g", "h").agg(F.stddev_samp("x").alias("s")).collect()}
    assert set(got) == set(want) and ("alone", 2**60 + 1) in got and (None, None) in got
    for key, value in want.items():
        assert got[key] is None if value is None else got[key] == pytest.approx(value, rel=1e-9)


def test_only_states_are_shuffled(spark):
    df = table(spark, 6)
    plan = A.python_aggregate(df, ["g"], ["x"], **SPREAD)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning(_group" in line]
    assert len(dealt) == 1 and plan.count("MapInPandas") == 2
    above = plan[: plan.index("hashpartitioning(_group")]
    assert above.count("MapInPandas") == 1  # the other one, which adds rows up, is below the shuffle


def test_no_rows_and_no_keys(spark):
    assert A.python_aggregate(table(spark, 2).limit(0), ["g"], ["x"], **SPREAD).count() == 0
    with pytest.raises(ValueError):
        A.python_aggregate(table(spark, 2), [], ["x"], **SPREAD)
