"""Row selection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without any null.

    One condition per column, so each is pushed to the scan where it can be and
    the optimizer never has to carry a condition over every column at once.
    """
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns or df.columns]))


def filter_equal(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == value)
