"""Exact quantiles (linear interpolation between order statistics).

A column is narrowed down by counting. The first round counts classes of values in
order: minus infinity, negative powers of two, zero, positive powers of two,
infinity, NaN. Every later round cuts the ranges that hold a wanted rank into equal
buckets and counts those. A class spans one doubling at most, so no width overflows
and six or seven rounds reach neighbouring doubles; a tie, however large, ends the
search at once. A round is one scan of the columns written once: every task counts the cells of its rows in Arrow
batches, column by column, and only counts are shuffled; they are a few thousand rows whatever the size of the input.

NaN sorts after every number, as in Spark's own ordering.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from perilscope.session import materialise

BUCKETS = 4096
# class of zero and of the values that are no finite number; a finite x > 0 has
# the exponent of its power of two + EXPONENTS, a negative one the same with its sign
EXPONENTS = 1100
INFINITE, NOT_A_NUMBER = 4000, 4001


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float]
) -> dict[str, list[float] | None]:
    """Quantiles of every column at ``probs``; None for a column without values."""
    if not probs:
        return {c: [] for c in columns}

    def places(n: int) -> list[float]:
        return [(n - 1) * p for p in probs]

    def ranks(n: int) -> list[int]:
        return sorted({r for h in places(n) for r in (math.floor(h), math.ceil(h))})

    found = order_statistics(df, columns, ranks)
    return {
        c: values and [_between(values, h) for h in places(n)] for c, (n, values) in found.items()
    }


def order_statistics(
    df: DataFrame, columns: Sequence[str], ranks: Callable[[int], Sequence[int]]
) -> dict[str, tuple[int, dict[int, float] | None]]:
    """For every column the number n of its values and the values at ``ranks(n)``, counted from 0 in
    ascending order; None instead for a column without values."""
    if not columns:
        return {}
    values = materialise(
        df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]), "quantiles"
    )
    classes = _counted(values, {i: _Cells(f"x{i}") for i in range(len(columns))})
    result: dict[str, tuple[int, dict[int, float] | None]] = {c: (0, None) for c in columns}
    search: dict[int, _Search] = {}
    for i, rows in classes.items():
        n = sum(row["n"] for row in rows)
        search[i] = _Search({}, [])
        result[columns[i]] = (n, search[i].found)
        search[i].narrow([_Interval(math.nan, math.nan, 0, list(ranks(n)))], [rows])
    while any(s.open for s in search.values()):
        cells, pieces = {}, {}
        for i, s in search.items():
            if s.open:
                pieces[i] = max(64, BUCKETS // len(s.open))
                cells[i] = _Cells(f"x{i}", s.open, pieces[i])
        counts = _counted(values, cells)
        for i, n in pieces.items():
            intervals = search[i].open
            split = [[r for r in counts[i] if r["cell"] // n == k] for k in range(len(intervals))]
            search[i].narrow(intervals, split)
    return result


def _between(values: dict[int, float], position: float) -> float:
    below, above = math.floor(position), math.ceil(position)
    low, high = values[below], values[above]
    if low == high or below == above:
        return low
    if math.isnan(low) or math.isnan(high):
        return math.nan
    return (above - position) * low + (position - below) * high


@dataclass
class _Interval:
    """A closed value range holding the ranks still looked for."""

    low: float
    high: float
    rows_before: int
    ranks: list[int]


@dataclass
class _Search:
    """The ranks of one column found so far, and the ranges still open."""

    found: dict[int, float]
    open: list[_Interval]

    def narrow(self, intervals: list[_Interval], counts: list[list[Row]]) -> None:
        """Replace each interval by those of its cells that hold a wanted rank."""
        remaining = []
        for interval, rows in zip(intervals, counts):
            before = interval.rows_before
            for row in rows:
                last = before + row["n"] - 1
                inside = []
                for rank in (r for r in interval.ranks if before <= r <= last):
                    if row["low"] == row["high"] or row["cell"] == NOT_A_NUMBER or rank == before:
                        self.found[rank] = row["low"]
                    elif rank == last:
                        self.found[rank] = row["high"]
                    else:
                        inside.append(rank)
                if inside:
                    remaining.append(_Interval(row["low"], row["high"], before, inside))
                before = last + 1
        self.open = remaining


@dataclass
class _Cells:
    """What the rows of a column are counted by: equal pieces of ranges, or classes (no ranges)."""

    name: str
    ranges: list[_Interval] | None = None
    pieces: int = 1

    @property
    def size(self) -> int:
        return 2 * NOT_A_NUMBER + 1 if self.ranges is None else len(self.ranges) * self.pieces

    @property
    def first(self) -> int:
        return -NOT_A_NUMBER if self.ranges is None else 0

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values that are in a cell, and their cells, counted from ``first``."""
        return (x, _class(x)) if self.ranges is None else _cell(x, self.ranges, self.pieces)

    def cast(self, kind: str) -> Column:
        """The cell as a column, to look at plans with."""
        return F.udf(lambda v: next(iter((self.of(np.array([v]))[1] + self.first).tolist()), None), "long")(self.name).cast(kind)


def _counted(values: DataFrame, cells: dict[int, _Cells]) -> dict[int, list[Row]]:
    """Rows, smallest and largest value of every cell of every column, cells in order."""
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {i: (np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, -np.inf)) for i, n in ((i, by.size) for i, by in cells.items())}
        for batch in stream:
            for column, (i, by) in zip(batch.columns, cells.items()):
                x = column.drop_null().to_numpy(zero_copy_only=False)
                x, cell = by.of(x)
                n, low, high = totals[i]
                n += np.bincount(cell, minlength=len(n))
                np.minimum.at(low, cell, x)
                np.maximum.at(high, cell, x)
        for i, (n, low, high) in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), i, np.int32)), pa.array(at + cells[i].first), pa.array(n[at]), pa.array(low[at]), pa.array(high[at])],
                names=["i", "cell", "n", "low", "high"],
            )

    rows = (
        values.select(*[f"x{i}" for i in cells])
        .mapInArrow(run, "i int, cell long, n long, low double, high double")
        .groupBy("i", "cell")
        .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        .collect()
    )
    found: dict[int, list[Row]] = {}
    for row in sorted(rows, key=lambda r: (r["i"], r["cell"])):
        found.setdefault(row["i"], []).append(row)
    return found


def _class(x: np.ndarray) -> np.ndarray:
    """The class of every value, counted from 0."""
    out = np.sign(x) * (np.frexp(np.abs(x))[1] + EXPONENTS)
    out = np.where(np.isinf(x), np.copysign(INFINITE, x), out)
    return np.where(np.isnan(x), NOT_A_NUMBER, out).astype(np.int64) + NOT_A_NUMBER


def _cell(x: np.ndarray, intervals: list[_Interval], pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """The values inside the ranges, which ascend and do not meet, and their cells."""
    low, high = (np.array([getattr(v, side) for v in intervals]) for side in ("low", "high"))
    at = np.searchsorted(low, x, side="right") - 1
    inside = (at >= 0) & (x <= high[at])
    x, at = x[inside], at[inside]
    share = (x - low[at]) / (high[at] - low[at])
    return x, at * pieces + np.minimum(np.floor(share * pieces).astype(np.int64), pieces - 1)
