"""Quantile sketches: rank error on ties and tails, merging of stored sketches, groups without values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilscope.operators import sketches as K
from perilscope.session import materialise

PROBS = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]


def off(values, value, prob):
    """Distance of the wanted rank from the ranks that the value stands at, as a share."""
    x = np.sort(values)
    low, high = np.searchsorted(x, value, "left") / len(x), np.searchsorted(x, value, "right") / len(x)
    return max(low - prob, prob - high, 0)


@pytest.mark.parametrize("accuracy", [64, 1024])
def test_rank_error_on_ties_and_tails_of_parts_and_whole(spark, accuracy):
    r = np.random.default_rng(2)
    tails = np.exp(r.normal(0, 20, 60_000))
    ties = np.where(r.random(60_000) < 0.4, 7.0, np.round(r.normal(0, 30, 60_000)))
    df = spark.createDataFrame([(k % 5, float(a), float(b)) for k, (a, b) in enumerate(zip(tails, ties))], "g int, a double, b double").repartition(11)
    parts = materialise(K.quantile_sketches(df, ["a", "b"], ["g"], accuracy), "sketches")
    assert parts.count() == 10
    whole = K.sketch_quantiles(K.merge_sketches(parts), PROBS).collect()
    assert len(whole) == 14 and {x["n"] for x in whole} == {60_000}
    for row in whole:
        assert off({"a": tails, "b": ties}[row["feature"]], row["value"], row["prob"]) <= 3 * K.rank_error(accuracy)
    for row in K.sketch_quantiles(parts, PROBS).collect():
        own = {"a": tails, "b": ties}[row["feature"]][row["g"]::5]
        assert off(own, row["value"], row["prob"]) <= 3 * K.rank_error(accuracy)
    size = parts.agg(F.max(F.octet_length("sketch"))).first()[0]
    assert size < 40 * accuracy


def test_few_values_are_exact_and_odd_values_have_their_place(spark):
    rows = [(1, 3.0), (1, 1.0), (1, 2.0), (2, None), (3, math.nan), (3, math.inf), (3, -math.inf), (None, 5.0), (None, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {(r["g"], r["prob"]): (r["n"], r["nans"], r["value"]) for r in K.sketch_quantiles(K.quantile_sketches(df, ["x"], ["g"]), [0.0, 0.5, 1.0]).collect()}
    assert [got[1, p] for p in (0.0, 0.5, 1.0)] == [(3, 0, 1.0), (3, 0, 2.0), (3, 0, 3.0)]
    assert got[2, 0.5] == (0, 0, None) and got[None, 0.5] == (1, 0, 5.0)
    assert got[3, 0.0] == (2, 1, -math.inf) and got[3, 1.0] == (2, 1, math.inf)
    assert K.sketch_quantiles(K.merge_sketches(K.quantile_sketches(df.limit(0), ["x"])), [0.5]).count() == 0
