"""Counts of all words of a corpus, by group, in hash-partitioned tables.

A task counts its own words first and passes sorted hashes and counts on, one row per bucket.
The words of a group are spread over ``n_buckets`` buckets, so no task holds them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilscope.llm import words as W
from perilscope.session import materialise

FLUSH = 1_000_000  # word hashes a task holds before it passes them on

COUNTS = "bucket int, hashes binary, counts binary"


def u64(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def value(batch: pa.RecordBatch, name: str, k: int):
    return batch.column(batch.schema.get_field_index(name))[k].as_py()


def by_bucket(hashes: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the hashes by bucket. Buckets follow the high bits, so sorted hashes are sorted by bucket."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        yield b, order[bounds[b] : bounds[b + 1]]


def sum_by_key(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    flat, number = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(flat)
    flat, number = flat[order], number[order]
    at = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
    return flat[at], np.add.reduceat(number, at) if len(at) else number


def count_words(docs: DataFrame, text: str, group: str, n_buckets: int, table: np.ndarray) -> DataFrame:
    """Counts of the words (see ``words``) of each group's rows; rows with a null group are left out.
    Group g has the buckets from ``g * n_buckets`` on."""

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.let_go()
        keys: dict[int, list[np.ndarray]] = {}
        counts: dict[int, list[np.ndarray]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for g in keys:
                k, c = sum_by_key(keys[g], counts[g])
                for bucket, at in by_bucket(k, n_buckets):
                    yield counts_row(g * n_buckets + bucket, k[at], c[at])

        for batch, data, offsets in W.batches(stream, text):
            data = W.lowered(data)
            starts, ends, first = W.spans(data, offsets, table)
            groups = batch.column(batch.schema.get_field_index(group)).fill_null(-1).to_numpy(zero_copy_only=False)
            of_word = np.repeat(groups, np.diff(first))
            hashes = W.hashes(data, starts, ends)
            for g in np.unique(groups[groups >= 0]).tolist():
                k, c = np.unique(hashes[of_word == g], return_counts=True)
                keys.setdefault(g, []).append(k)
                counts.setdefault(g, []).append(c)
                held += len(k)
            if held >= FLUSH:
                yield from flush()
                keys, counts, held = {}, {}, 0
        if held:
            yield from flush()

    def merge(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[int, list[np.ndarray]] = {}
        counts: dict[int, list[np.ndarray]] = {}
        held: dict[int, int] = {}
        for batch in stream:
            for k in range(len(batch)):
                b = value(batch, "bucket", k)
                keys.setdefault(b, []).append(u64(value(batch, "hashes", k)))
                counts.setdefault(b, []).append(np.frombuffer(value(batch, "counts", k), np.int64))
                held[b] = held.get(b, 0) + len(keys[b][-1])
                if len(keys[b]) > 1 and held[b] > 2 * len(keys[b][0]) + FLUSH // 8:
                    merged = sum_by_key(keys[b], counts[b])
                    keys[b], counts[b], held[b] = [merged[0]], [merged[1]], len(merged[0])
        for b in keys:
            yield counts_row(b, *sum_by_key(keys[b], counts[b]))
        del keys, counts
        W.release()

    counted = docs.select(text, group).mapInArrow(count, COUNTS)
    n_partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(counted.repartition(n_partitions, "bucket").mapInArrow(merge, COUNTS), "words")


def counts_row(bucket: int, hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([bucket], pa.int32()),
            pa.array([hashes.tobytes()], pa.binary()),
            pa.array([counts.astype(np.int64).tobytes()], pa.binary()),
        ],
        names=["bucket", "hashes", "counts"],
    )


def frequent(words: DataFrame, group: int, n_buckets: int, limit: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """A group's most frequent words (sorted hashes, counts; at most ``limit``), and its tokens and distinct words.

    Counts are put in bins of 1/32 of a doubling; the lowest bin that keeps the
    words from there on within ``limit`` is the border.
    """

    def bins(counts: np.ndarray) -> np.ndarray:
        return np.floor(np.log2(counts) * 32).astype(np.int64)

    def summary(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for k in range(len(batch)):
                counts = np.frombuffer(value(batch, "counts", k), np.int64)
                bin_, n = np.unique(bins(counts), return_counts=True)
                total = np.bincount(np.searchsorted(bin_, bins(counts)), counts, minlength=len(bin_))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bin_), pa.array(n), pa.array(total.astype(np.int64))], names=["bin", "n", "total"]
                )

    mine = words.where(F.col("bucket").between(group * n_buckets, (group + 1) * n_buckets - 1))
    rows = mine.mapInArrow(summary, "bin long, n long, total long").groupBy("bin").agg(F.sum("n"), F.sum("total")).collect()
    border, held = 0, 0
    for bin_, n, _ in sorted(rows, reverse=True):
        if held + n > limit:
            border = bin_ + 1
            break
        held += n

    def pick(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for k in range(len(batch)):
                hashes, counts = u64(value(batch, "hashes", k)), np.frombuffer(value(batch, "counts", k), np.int64)
                at = bins(counts) >= border
                yield counts_row(0, hashes[at], counts[at])

    parts = mine.mapInArrow(pick, COUNTS).collect()  # at most ``limit`` words in all
    hashes = np.concatenate([u64(r["hashes"]) for r in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order], sum(r[2] for r in rows), sum(r[1] for r in rows)
