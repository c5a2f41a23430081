"""One-way analysis: bin a feature, then average targets per bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilscope.functions.expressions import edges_at_or_below
from perilscope.operators.aggregates import weighted_group_means
from perilscope.operators.quantiles import exact_quantiles

METHODS = ("quantiles", "linear")


def bin_edges(
    df: DataFrame, features: Sequence[str], nbins: int = 10, method: str = "quantiles"
) -> dict[str, list[float]]:
    """Lower bounds that separate the bins of each feature.

    Quantile edges are the quantiles at 1/n .. (n-1)/n. Linear edges start at the
    minimum, so linear labels run from 2 to n+1 and quantile labels from 1 to n.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    if nbins < 0 or (method == "linear" and nbins == 0):
        raise ValueError("nbins must be positive")
    if method == "quantiles":
        probs = [i / nbins for i in range(1, nbins)]
        return {c: edges or [] for c, edges in exact_quantiles(df, features, probs).items()}
    row = df.agg(
        *[F.min(c).cast("double").alias(f"lo_{c}") for c in features],
        *[F.max(c).cast("double").alias(f"hi_{c}") for c in features],
    ).first()
    return {
        c: []
        if row[f"lo_{c}"] is None
        else [
            row[f"lo_{c}"] + i * (row[f"hi_{c}"] - row[f"lo_{c}"]) / nbins for i in range(nbins)
        ]
        for c in features
    }


def bin_label(x: Column, edges: Sequence[float]) -> Column:
    """1 + the number of edges at or below ``x``. Equal edges leave labels unused."""
    return edges_at_or_below(x, edges) + 1


def with_bins(
    df: DataFrame, feature: str, nbins: int = 10, method: str = "quantiles", name: str = "var_bins"
) -> DataFrame:
    edges = bin_edges(df, [feature], nbins, method)[feature]
    return df.withColumn(name, bin_label(F.col(feature), edges))


def one_way(
    df: DataFrame,
    feature: str,
    nbins: int = 10,
    *,
    targets: str | Sequence[str],
    method: str = "quantiles",
) -> DataFrame:
    """Mean of each target and row count per bin of ``feature``, in bin order."""
    targets = [targets] if isinstance(targets, str) else list(targets)
    binned = with_bins(df.select(*dict.fromkeys([feature, *targets])), feature, nbins, method)
    return weighted_group_means(binned, ["var_bins"], targets).orderBy("var_bins")


def one_way_features(
    df: DataFrame,
    features: Sequence[str],
    nbins: int = 10,
    *,
    targets: Sequence[str],
    method: str = "quantiles",
) -> DataFrame:
    """One-way tables of several features from one scan after the edges are known.

    Each row is unpivoted inside its task and combined there, so what is shuffled
    is at most features x bins rows per task.
    """
    edges = bin_edges(df, features, nbins, method)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), bin_label(F.col(c), edges[c]).alias("var_bins"))
            for c in features
        ]
    )
    long = df.select(*targets, F.inline(cells))
    return weighted_group_means(long, ["feature", "var_bins"], targets).orderBy(
        "feature", "var_bins"
    )
