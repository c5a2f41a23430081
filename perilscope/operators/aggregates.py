"""Grouped and whole-table aggregates, each one job with map-side combine."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_means(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(c).alias(c) for c in columns])


def weighted_group_means(
    df: DataFrame, by: Sequence[str], targets: Sequence[str], weight: str = "_weight"
) -> DataFrame:
    """Mean of every target and the number of rows, rows with a null target included."""
    return df.groupBy(*by).agg(
        *[F.avg(c).alias(c) for c in targets], F.count(F.lit(1)).alias(weight)
    )


def group_sums(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.sum(c).alias(c) for c in columns])


def total_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.sum(c).alias(c) for c in columns])


def user_aggregate(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """Any aggregate expression per group; Spark combines it before the shuffle."""
    return df.groupBy(*by).agg(*[agg.alias(name) for name, agg in aggregates.items()])


def with_group_statistics(df: DataFrame, by: str, **statistics: Column) -> DataFrame:
    """Add group statistics to every row.

    Written as aggregate and join, not as a window: a window would sort a whole
    group in one task, and one group may hold a third of the table. The grouped
    side is small for few groups (Spark then broadcasts it by size) and otherwise
    an equi-join that adaptive execution splits where it is skewed.
    """
    grouped = df.groupBy(F.col(by).alias("_group")).agg(
        *[agg.alias(name) for name, agg in statistics.items()]
    )
    return df.join(grouped, F.col(by).eqNullSafe(F.col("_group")), "left").drop("_group")


def extrema(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum and maximum of each column, one row per column."""
    wide = df.agg(
        *[F.min(c).alias(f"min_{c}") for c in columns],
        *[F.max(c).alias(f"max_{c}") for c in columns],
    )
    return _unpivot(wide, columns, ("min", "max"))


def mean_and_std(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"std_{c}") for c in columns],
    )
    return _unpivot(wide, columns, ("mean", "std"))


def _unpivot(wide: DataFrame, columns: Sequence[str], measures: Sequence[str]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            *[F.col(f"{m}_{c}").cast("double").alias(m) for m in measures],
        )
        for c in columns
    ]
    return wide.select(F.inline(F.array(*rows)))


def best_setting(results: DataFrame, setting: str, metric: str) -> DataFrame:
    """The setting with the lowest metric; the smaller setting wins a tie."""
    rank = F.struct(F.col(metric), F.col(setting))
    return results.agg(
        F.min_by(setting, rank).alias(setting), F.min(metric).alias(metric)
    )


# --- aggregates written in Python --------------------------------------------------

STATES_HELD = 100_000  # groups a task holds before it passes their states on

def python_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    zero: Callable[[], Any],
    add: Callable[[Any, pd.DataFrame], Any],
    merge: Callable[[Any, Any], Any],
    finish: Callable[[Any], float | None],
    output: str = "value",
) -> DataFrame:
    """An aggregate written in Python: one row per group with its keys and ``output``, a double.

    ``add`` takes a state and some of a group's rows (``columns``), in any number of calls; ``merge`` joins
    two states, ``finish`` turns one into a number. Every task adds up its own rows first and passes on one state per
    group and ``STATES_HELD`` groups at most, so that a group of any size is added up where its rows are, and
    only states are shuffled; those of a group follow one another and are merged one by one. Nulls are keys of their own.
    """
    if not keys:
        raise ValueError("a group needs a key")
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = df.select(group.alias("_group"), *columns)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[str, Any] = {}
        for frame in frames:
            for name, part in frame.groupby("_group", sort=False):
                states[name] = add(states[name] if name in states else zero(), part[list(columns)])
            if len(states) >= STATES_HELD:
                yield _states(states)
                states = {}
        if states:
            yield _states(states)

    def merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state, done = None, None, []
        for frame in frames:
            for other, raw in zip(frame["_group"], frame["_state"]):
                if other == name:
                    state = merge(state, pickle.loads(raw))
                    continue
                if name is not None:
                    done.append((name, finish(state)))
                name, state = other, pickle.loads(raw)
            if done:
                yield pd.DataFrame(done, columns=["_group", "_value"])
            done = []
        if name is not None:
            yield pd.DataFrame([(name, finish(state))], columns=["_group", "_value"])

    states = rows.mapInPandas(partial, "_group string, _state binary")
    values = states.repartition("_group").sortWithinPartitions("_group").mapInPandas(merged, "_group string, _value double")
    found = F.from_json("_group", df.select(*keys).schema)
    return values.select(found.alias("_keys"), F.col("_value").alias("_value")).select(
        *[F.col("_keys")[k].alias(k) for k in keys], F.col("_value").alias(output)
    )


def _states(states: dict[str, Any]) -> pd.DataFrame:
    return pd.DataFrame({"_group": list(states), "_state": [pickle.dumps(s) for s in states.values()]})
