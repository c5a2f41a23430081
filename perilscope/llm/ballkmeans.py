"""Codes of vectors by product quantisation, with exact ball k-means.

Components become integers, vectors are cut into equal parts, and every part position has a codebook
of its own, improved by rounds of k-means. After the first assignment, which compares all entries, every part has
an entry, its ball, and only needs few comparisons: an entry can only be nearer than the own one (or tie with it)
where its distance to the own entry is at most twice the part's distance to that. So the radius of
a ball, the largest distance among the members a task holds, tells which entries are its
neighbours; parts nearer to their entry than half the way to the nearest neighbour are its stable core and compared
with nothing; all others lie in a ring between half the distances of two neighbours and are compared with
the neighbours up to the inner one. All of this is integer arithmetic, so results are those of the full comparison.

Vectors are written once as integers with their first codes. A round is one pass over
them: a task adds up its own parts per entry, a fixed number of rows whatever it read, and only those
sums are shuffled. The codebooks are what a task needs besides its rows.

Defined results: vectors that are null, empty or hold null or non-finite components are left out, and so are those
of another length than the first kept one. Parts of a length that does not divide evenly are filled up with zeros.
The first entries are those of the smallest ids, ties in the order of the vectors, a null id last; fewer vectors
than entries give fewer entries. Repeated rows count as often as they occur. Components beyond ``limit`` (16,777,215 for
64 components and 64 entries, that is inputs beyond 65,535) are set to it, so that sums of squares fit 64 bits. Other
columns play no part. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perilscope.llm.groups import join_groups
from perilscope.session import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
BATCH = 16_384  # vectors compared at once


def limit(size: int, entries: int) -> int:
    """The largest component: squared distances of whole vectors times ``entries`` stay below 2 ** 62."""
    return math.isqrt((1 << 62) // (4 * max(size, 1) * entries)) - 1


def usable(vector: Column) -> Column:
    """True for a vector of finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def as_integers(values: np.ndarray, scale: float, most: int) -> np.ndarray:
    """floor(scale * x), inside the limit."""
    return np.clip(np.floor(values.astype(np.float64) * scale), -most, most).astype(np.int64)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    diff = a - b
    return np.einsum("ij,ij->i", diff, diff)


def nearest_of_all(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest entry of every row; ties to the lower index."""
    out = np.empty(len(x), dtype=np.int64)
    for k in range(0, len(x), 4096):
        diff = x[k : k + 4096, None, :] - book[None, :, :]
        out[k : k + 4096] = np.einsum("ijk,ijk->ij", diff, diff).argmin(axis=1)
    return out


def nearest_from(x: np.ndarray, book: np.ndarray, ball: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of every row and its squared distance, from the entry each row had before; and the number
    of comparisons beyond that one."""
    own = _squares(x, book[ball])
    apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(apart, axis=1, kind="stable")
    ring = np.zeros(len(x), dtype=np.int64)
    by_ball = np.argsort(ball, kind="stable")
    cuts = np.searchsorted(ball[by_ball], np.arange(len(book) + 1))
    for j in np.flatnonzero(np.diff(cuts)).tolist():
        members = by_ball[cuts[j] : cuts[j + 1]]
        reach = 4 * own[members]
        away = apart[j, order[j]]
        neighbours = away[: np.searchsorted(away, reach.max(), side="right")]  # entries the ball's radius touches
        ring[members] = np.searchsorted(neighbours, reach, side="right")
    entry, distance = ball.copy(), own.copy()
    moving = np.flatnonzero(ring > 1)  # the others are in the stable core of their ball
    if not len(moving):
        return entry, distance, 0
    wide = ring[moving]
    rows = np.repeat(moving, wide)
    steps = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
    candidates = order[ball[rows], steps]
    keys = _squares(x[rows], book[candidates]) * len(book) + candidates
    best = np.minimum.reduceat(keys, np.cumsum(wide) - wide)
    entry[moving], distance[moving] = best % len(book), best // len(book)
    return entry, distance, len(rows)


@dataclass
class Codebooks:
    """``books[part]`` is an array of entries by components."""

    books: np.ndarray  # parts x entries x components
    size: int  # components of a vector

    def digest(self) -> str:
        """sha256 of all components by part, entry and place, as decimals joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()

    def vector(self, code: str, scale: float = SCALE) -> np.ndarray:
        """The vector a code stands for."""
        width = self.books.shape[2]
        parts = [self.books[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(len(self.books))]
        return (np.concatenate(parts)[: self.size] / scale) if width else np.zeros(0)


@dataclass
class Compressed:
    """Written integers with the codes of the first assignment, and the final codebooks (None without vectors)."""

    table: DataFrame
    codebooks: Codebooks | None
    key: str
    label: str

    def codes(self) -> DataFrame:
        """``key, label, code`` (two hex digits per part) and ``error``, the squared distances over all parts."""
        keys = ["key", "label"]
        schema = self.table.select(F.col("key").alias(self.key), F.col("label").alias(self.label)).schema
        schema = T.StructType([*schema, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
        if self.codebooks is None:
            return self.table.sparkSession.createDataFrame([], schema)
        books = self.codebooks.books

        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, x, balls in _parts(stream, books.shape):
                codes, error = np.empty(balls.shape, dtype=np.uint8), np.zeros(len(x), dtype=np.int64)
                for p, book in enumerate(books):
                    entry, distance, _ = nearest_from(x[:, p], book, balls[:, p])
                    codes[:, p] = entry
                    error += distance
                text = [c.tobytes().hex() for c in codes]
                columns = [batch.column(batch.schema.get_field_index(c)) for c in keys]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(text, pa.string()), pa.array(error)], names=schema.names)

        return self.table.mapInArrow(run, schema)


def _parts(stream: Iterator[pa.RecordBatch], shape: tuple[int, int, int]):
    """Slices of the written rows with their parts (rows x parts x components) and first codes."""
    parts, _, width = shape
    for whole in stream:
        for k in range(0, len(whole), BATCH):
            batch = whole.slice(k, BATCH)
            flat = batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False)
            codes = b"".join(batch.column(batch.schema.get_field_index("code")).to_pylist())
            yield (
                batch,
                flat.astype(np.int64).reshape(len(batch), parts, width),
                np.frombuffer(codes, dtype=np.uint8).reshape(len(batch), parts).astype(np.int64),
            )


def _sums(table: DataFrame, books: np.ndarray, first: bool) -> np.ndarray:
    """The codebooks after one round; ``first``: the written codes are those of ``books``."""
    parts, entries, width = books.shape

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width), dtype=np.int64)
        count = np.zeros((parts, entries), dtype=np.int64)
        for _, x, balls in _parts(stream, books.shape):
            for p in range(parts):
                entry = balls[:, p] if first else nearest_from(x[:, p], books[p], balls[:, p])[0]
                np.add.at(total[p], entry, x[:, p])
                count[p] += np.bincount(entry, minlength=entries)
        part, entry = np.nonzero(count)
        rows = total[part, entry]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(rows.reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), lists],
            names=["part", "entry", "n", "total"],
        )

    partial = table.mapInArrow(run, "part int, entry int, n long, total array<long>")
    totals = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]
    out = books.copy()
    for row in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():  # parts x entries rows
        out[row["part"], row["entry"]] = [row[f"t{i}"] // row["n"] for i in range(width)]
    return out


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE,
) -> Compressed:
    """Fit the codebooks on all usable vectors."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte per part")
    kept = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("v")).where(usable(F.col("v")))
    start = kept.select("key", "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).collect()
    size = len(start[0]["v"]) if start else 0
    if any(len(row["v"]) != size for row in start):
        kept = kept.where(F.size("v") == size)
        start = kept.select("key", "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).collect()
    kept = kept.where(F.size("v") == size)
    width = -(-size // parts)
    most = limit(parts * width, entries)

    def cut(flat: np.ndarray) -> np.ndarray:
        x = np.zeros((len(flat) // max(size, 1), parts * width), dtype=np.int64)
        x[:, :size] = as_integers(flat, scale, most).reshape(len(x), size)
        return x.reshape(len(x), parts, width)

    books = cut(np.array([v for row in start for v in row["v"]], dtype=np.float64)).transpose(1, 0, 2).copy()

    def encode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for k in range(0, len(whole), BATCH):
                batch = whole.slice(k, BATCH)
                x = cut(batch.column(2).flatten().to_numpy(zero_copy_only=False))
                codes = np.stack([nearest_of_all(x[:, p], books[p]) for p in range(parts)], axis=1).astype(np.uint8)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1) * parts * width, pa.int32()), pa.array(x.reshape(-1).astype(np.int32))
                )
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, packed], names=["key", "label", "x", "code"])

    written = [T.StructField("x", T.ArrayType(T.IntegerType())), T.StructField("code", T.BinaryType())]
    schema = T.StructType([*kept.select("key", "label").schema, *written])
    if not start:
        return Compressed(vectors.sparkSession.createDataFrame([], schema), None, key, label)
    table = materialise(kept.mapInArrow(encode, schema), "integers")
    for k in range(rounds):
        books = _sums(table, books, first=k == 0)
    return Compressed(table, Codebooks(books, size), key, label)


def with_label_error(codes: DataFrame, label: str) -> DataFrame:
    """``codes`` with ``label_error``: the error summed over the rows of the label, nulls together."""
    codes = materialise(codes, "codes")
    sums = codes.groupBy(label).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows"))
    return join_groups(codes, materialise(sums, "labels"), label, "_rows")
