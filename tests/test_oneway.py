import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilscope.operators.oneway import one_way, one_way_features, with_bins
from perilscope.operators.profiles import histogram, kernel_profile


def frame(spark, values):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)],
                                 "k long, x double")


def labels(df, nbins, method="quantiles"):
    return [r["var_bins"] for r in with_bins(df, "x", nbins, method).orderBy("k").collect()]


def test_tied_edges(spark):
    assert labels(frame(spark, [1, 1, 1, 1, 2]), 4) == [4, 4, 4, 4, 4]


@pytest.mark.parametrize("nbins", [0, 1])
def test_one_bin(spark, nbins):
    assert labels(frame(spark, [3, 9, 4]), nbins) == [1, 1, 1]


def test_linear_labels_start_at_two(spark):
    assert labels(frame(spark, range(11)), 10, "linear") == [2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 11]


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        with_bins(frame(spark, [1]), "x", 3, "kmeans")


@pytest.mark.parametrize("n", [10_001, 997, 50])
@pytest.mark.parametrize("nbins", [4, 10])
def test_quantile_labels_match_numpy(spark, n, nbins):
    data = np.random.default_rng(n).integers(0, n // 3, n).astype(float)
    edges = np.quantile(data, np.arange(1, nbins) / nbins)
    assert labels(frame(spark, data), nbins) == (np.searchsorted(edges, data, "right") + 1).tolist()


def test_weights_cover_every_row_and_null_is_its_own_group(spark):
    df = frame(spark, [1, 2, None, 3, 4]).withColumn("y", F.col("k").cast("double"))
    rows = one_way(df, "x", 2, targets="y").collect()
    assert sum(r["_weight"] for r in rows) == 5
    assert rows[0]["var_bins"] is None and rows[0]["y"] == 2.0


def test_several_features_equal_one_by_one(spark):
    df = frame(spark, range(100)).withColumn("z", F.col("k") % 7).withColumn("y", F.col("x") / 2)
    together = one_way_features(df, ["x", "z"], 5, targets=["y"]).collect()
    for feature in ("x", "z"):
        alone = [tuple(r) for r in one_way(df, feature, 5, targets=["y"]).collect()]
        assert [tuple(r)[1:] for r in together if r["feature"] == feature] == alone


def test_empty_input(spark):
    df = frame(spark, []).withColumn("y", F.lit(1.0))
    assert one_way(df, "x", 5, targets="y").count() == 0
    assert histogram(df, "x").count() == 0
    assert kernel_profile(df, "x").count() == 0


def test_histogram_counts_every_value(spark):
    rows = histogram(frame(spark, [0, 1, 2, 3, 10, None]), "x", 5).collect()
    assert [(r["bin"], r["n"]) for r in rows] == [(0, 2), (1, 2), (4, 1)]


def test_kernel_profile_matches_direct_sum(spark):
    data = [1.0, 2.0, 2.5, 7.0]
    for row in kernel_profile(frame(spark, data), "x", 5, bandwidth=0.8).collect():
        direct = sum(math.exp(-0.5 * ((v - row["x"]) / 0.8) ** 2) for v in data)
        assert row["density"] == pytest.approx(direct / (4 * 0.8 * math.sqrt(2 * math.pi)))
