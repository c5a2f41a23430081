"""Reproducible sampling and splitting by keyed hash.

Rows are ranked by ``md5(seed:key)``. A split of exactly ``floor(p * n)`` rows is
then a comparison with one cut digest, found by counting digest prefixes. The
split itself is a projection: no row is shuffled, sorted or counted twice.
``key`` must identify a row; a cut that falls among rows of one key is an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perilscope.functions.expressions import seeded_hash
from perilscope.operators.quantiles import order_statistics
from perilscope.session import materialise

DIGITS = 3  # hex digits counted per round: 4096 groups
WHOLE = 32  # hex digits of a digest
LISTED = 1 << 14  # rows of a group whose digests are counted one by one
INDEX_DIGITS = 4  # hex digits of the groups that are numbered one by one: 65,536 groups


def sample_rows(df: DataFrame, key: str, k: int, seed: int = 123) -> DataFrame:
    """Exactly ``k`` rows without replacement, in key order.

    The cut digest is found by counting, so only the ``k`` rows are sorted.
    """
    return large_sample(df, key, k, seed).orderBy(key)


def one_row(df: DataFrame, key: str, seed: int = 123) -> DataFrame:
    return sample_rows(df, key, 1, seed)


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest keys, in key order.

    For a numeric key the ``n``-th smallest is found by counting, and only the rows
    up to it are sorted. Other keys keep the best ``n`` of every task.
    """
    if n > 0 and isinstance(df.schema[key].dataType, T.NumericType):
        total, nulls = df.agg(F.count(key), F.count(F.lit(1)) - F.count(key)).first()
        if nulls < n <= total + nulls:  # nulls come first
            rank = n - nulls - 1
            _, found = order_statistics(df.select(key), [key], lambda _: [rank])[key]
            # keys that are equal as doubles stay together; the sort below tells them apart
            df = df.where(F.col(key).isNull() | (F.col(key).cast("double") <= F.lit(found[rank])))
    return df.orderBy(key).limit(n)


def cut_digests(
    df: DataFrame, key: str, wanted: Callable[[int], int], seeds: Sequence[int | str]
) -> list[str]:
    """For each seed the digest of the ``wanted(n)``-th smallest of the n rows;
    an empty string, below every digest, where that is no row at all.

    The keys are written once; every round counts the groups of one more piece of the
    digest inside the group that holds the wanted row, and the digests of a small group.
    """
    keys = materialise(df.select(F.col(key).alias("key")), "keys")
    digests = keys.select(
        F.posexplode(F.array(*[seeded_hash(s, F.col("key")) for s in seeds])).alias("seed", "digest")
    )
    prefixes = {i: "" for i in range(len(seeds))}
    missing: dict[int, int] = {}
    cuts: dict[int, str] = {}
    held = None  # rows of the largest group
    while prefixes:
        length = max(map(len, prefixes.values()))
        inside = digests
        if length:
            inside = digests.where(_starts_with(prefixes, length))
        width = WHOLE if held is not None and held <= LISTED else min(length + DIGITS, WHOLE)
        counts = inside.groupBy("seed", F.substring("digest", 1, width).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).collect()
        held = 0
        for i in list(prefixes):
            mine = sorted((row for row in counts if row["seed"] == i), key=lambda row: row["prefix"])
            if not length:
                missing[i] = wanted(sum(row["n"] for row in mine))
            if missing[i] == 0:
                cuts[i] = ""
                prefixes.pop(i)
                continue
            for row in mine:
                if missing[i] <= row["n"]:
                    break
                missing[i] -= row["n"]
            prefixes[i] = row["prefix"]
            if width == WHOLE:
                if missing[i] < row["n"]:
                    raise ValueError(f"{key} does not identify a row: {row['n']} rows share the key at the cut")
                cuts[i] = row["prefix"]
                prefixes.pop(i)
            else:
                held = max(held, row["n"])
    return [cuts[i] for i in range(len(seeds))]


def _starts_with(prefixes: dict[int, str], length: int) -> Column:
    tagged = F.concat_ws(":", F.col("seed").cast("string"), F.substring("digest", 1, length))
    return tagged.isin([f"{i}:{prefix}" for i, prefix in prefixes.items()])


def with_split_flag(
    df: DataFrame, key: str, fraction: float = 0.9, seed: int = 123, name: str = "is_train"
) -> DataFrame:
    """Mark exactly ``floor(fraction * n)`` rows as training rows."""
    return with_bag_flags(df, key, fraction, {name: seed})


def with_bag_flags(df: DataFrame, key: str, fraction: float, seeds: dict[str, int]) -> DataFrame:
    """Several independent splits as boolean columns, one per ``name: seed``."""
    cuts = cut_digests(df, key, lambda n: math.floor(fraction * n), list(seeds.values()))
    return df.withColumns(
        {
            name: seeded_hash(seed, F.col(key)) <= F.lit(cut)
            for (name, seed), cut in zip(seeds.items(), cuts)
        }
    )


def large_sample(df: DataFrame, key: str, k: int, seed: int | str = 123) -> DataFrame:
    """The rows of ``sample_rows``, unordered, found by a cut digest: for any ``k``."""
    (cut,) = cut_digests(df, key, lambda n: min(k, n), [seed])
    return df.where(seeded_hash(seed, F.col(key)) <= F.lit(cut))


def split(
    df: DataFrame, key: str, fraction: float = 0.9, seed: int = 123
) -> tuple[DataFrame, DataFrame]:
    """Training rows and the rest."""
    flagged = with_split_flag(df, key, fraction, seed, "_is_train")
    return (
        flagged.where(F.col("_is_train")).drop("_is_train"),
        flagged.where(~F.col("_is_train")).drop("_is_train"),
    )


def hash_index(df: DataFrame, key: str, seed: int | str) -> HashIndex:
    """Numbers the rows 0..n-1 in digest order, group of equal digest prefixes by group."""
    digest = seeded_hash(seed, F.col(key))
    prefix = F.substring(digest, 1, INDEX_DIGITS).alias("_prefix")
    counts = df.groupBy(prefix).count().orderBy("_prefix").collect()  # at most 65,536 rows
    offsets, total = [], 0
    for row in counts:
        offsets.append((row["_prefix"], total, total + row["count"]))
        total += row["count"]
    starts = df.sparkSession.createDataFrame(offsets, "_prefix string, _start long, _end long")
    return HashIndex(df, key, digest, starts, total)


@dataclass
class HashIndex:
    """A table whose rows have places in digest order; only asked-for rows are numbered."""

    df: DataFrame
    key: str
    digest: Column
    starts: DataFrame
    size: int

    def rows(self, places: DataFrame) -> DataFrame:
        """The rows (column ``_index``) at the distinct ``_index`` values of ``places``.

        Only rows whose digest prefix holds a wanted place are sorted.
        """
        wanted = places.select("_index").distinct()
        # ranges of places are met through cells of the mean group's width, by an equal join
        width = -(-self.size // 16**INDEX_DIGITS) or 1
        cells = F.sequence(F.expr(f"_start div {width}"), F.expr(f"(_end - 1) div {width}"))
        starts = F.broadcast(self.starts.withColumn("_cell", F.explode(cells)))  # at most 131,072 rows
        inside = (F.col("_index") >= F.col("_start")) & (F.col("_index") < F.col("_end"))
        prefixes = (
            wanted.withColumn("_cell", F.expr(f"_index div {width}")).join(starts, "_cell").where(inside)
            .select("_prefix").distinct()
        )
        numbered = self._numbered(self._keyed().join(prefixes, "_prefix", "left_semi"))
        return numbered.join(wanted, "_index", "left_semi")

    def all_rows(self) -> DataFrame:
        return self._numbered(self._keyed())

    def _keyed(self) -> DataFrame:
        return self.df.withColumn("_digest", self.digest).withColumn(
            "_prefix", F.substring("_digest", 1, INDEX_DIGITS)
        )

    def _numbered(self, rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("_prefix").orderBy("_digest", self.key))
        return (
            rows.withColumn("_place", place)
            .join(F.broadcast(self.starts), "_prefix")
            .withColumn("_index", F.col("_start") + F.col("_place") - 1)
            .drop("_digest", "_prefix", "_start", "_end", "_place")
        )
