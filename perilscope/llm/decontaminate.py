"""Benchmark decontamination with suffix arrays of the training text.

Every slice of training rows in a task is a shard. Its suffix array orders the
places from which enough benchmark words follow one another; suffixes that no
benchmark text can match are left out before sorting. Every benchmark suffix is
then looked up by binary search, one word deeper at a time, which gives its
longest verbatim match and all its places. Words are compared as 64-bit hashes.

The benchmark is sent to the tasks in blocks of at most ``BLOCK_BYTES`` of
text. With several blocks the documents pass through one search per block.

Defined results: a null or wordless text has no hits; a null item id counts as
the id ``null``; repeated documents are judged one by one, repeated items count
once; an empty benchmark leaves everything clean; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perilscope.llm import words as W

WINDOW = 10
BLOCK_BYTES = 16 << 20
SLICE_BYTES = 2 << 20  # of texts that share a suffix array

HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ITEMS = pa.list_(pa.string())


@dataclass
class Block:
    """Benchmark items as numbered words. ``text`` holds the items one after the
    other; number 0 is kept for the end of a run."""

    names: list[str]
    vocabulary: np.ndarray
    check: np.ndarray
    text: np.ndarray
    suffix: np.ndarray  # place in text
    item: np.ndarray  # its item
    place: np.ndarray  # its first word within the item
    left: np.ndarray  # words to the item's end
    window: np.ndarray  # words of the window that starts there, 0 for none

    @property
    def least(self) -> int:
        return int(self.window[self.window > 0].min())


def build_block(items: list[tuple[str, str]], window: int = WINDOW) -> Block | None:
    """None if no item has a word."""
    names, texts = [n for n, _ in items], pa.array([t for _, t in items], pa.large_string())
    data, offsets = W.buffer(texts)
    data = W.lowered(data)
    starts, ends, first = W.spans(data, offsets, W.ALNUM)
    if not len(starts):
        return None
    vocabulary, at, numbers = np.unique(W.hashes(data, starts, ends), return_index=True, return_inverse=True)
    check = W.hashes(data, starts[at], ends[at], seed=7)
    length = np.diff(first)
    item = np.repeat(np.arange(len(items)), length)
    place = np.arange(len(starts)) - first[item]
    left = length[item] - place
    size = np.where(length[item] < window, np.where(place == 0, length[item], 0), np.where(left >= window, window, 0))
    return Block(names, vocabulary, check, np.append(numbers + 1, 0), np.arange(len(starts)), item, place, left, size)


def blocks_of(items: Iterable[tuple[str, str | None]], window: int, size: int) -> Iterator[Block]:
    pending: list[tuple[str, str]] = []
    held = 0

    def built() -> Iterator[Block]:
        block = build_block(pending, window)
        if block:
            yield block

    for name, text in items:
        if text is None:
            continue
        pending.append((name, text))
        held += len(text)
        if held >= size:
            yield from built()
            pending, held = [], 0
    if pending:
        yield from built()


def suffix_array(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of the text that follows them, compared over ``depth`` words.

    Prefix doubling: ranks over k words become ranks over 2k words.
    """
    rank = text.astype(np.int64)
    k = 1
    while k < depth:
        following = np.zeros_like(rank)
        following[:-k] = rank[k:]
        _, rank = np.unique(rank * (rank.max() + 1) + following, return_inverse=True)
        if rank.max() + 1 == len(rank):
            break
        k *= 2
    return places[np.argsort(rank[places], kind="stable")]


@dataclass
class Shard:
    """Numbered words of some rows, reduced to the runs that can match, and their suffix array."""

    text: np.ndarray
    origin: np.ndarray  # word of the rows for each word of text
    order: np.ndarray

    @classmethod
    def of(cls, numbers: np.ndarray, row_end: np.ndarray, least: int, depth: int) -> Shard:
        """``numbers``: 0 for a word outside the vocabulary; ``row_end``: the end of each word's row."""
        n = len(numbers)
        at = np.arange(n)
        stop = np.where(numbers == 0, at, n)
        stop = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], row_end)
        follow = stop - at
        start = follow >= least
        opens = np.flatnonzero(start & np.append(True, ~start[:-1] | (stop[1:] != stop[:-1])))
        length = stop[opens] - opens
        origin = W.ragged(length + 1, opens)
        text = np.zeros(len(origin) + depth + 1, dtype=np.int64)
        inside = np.ones(len(origin), dtype=bool)
        inside[np.cumsum(length + 1) - 1] = False
        text[: len(origin)][inside] = numbers[origin[inside]]
        places = np.flatnonzero(inside)
        places = places[start[origin[places]]]
        return cls(text, origin, suffix_array(text, places, depth))

    def search(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each benchmark suffix: longest match, one place of it, and the
        range of ``order`` that holds its window (empty if it does not occur)."""
        n = len(block.suffix)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.order))
        longest = np.zeros(n, np.int64)
        first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
        active = np.arange(n) if len(self.order) else np.zeros(0, np.int64)
        d = 0
        while len(active):
            word = block.text[block.suffix[active] + d]
            begin = self._bound(low[active], high[active], word, d)
            end = self._bound(begin, high[active], word + 1, d)
            found = end > begin
            active, begin, end = active[found], begin[found], end[found]
            low[active], high[active], longest[active] = begin, end, d + 1
            d += 1
            whole = block.window[active] == d
            first[active[whole]], last[active[whole]] = begin[whole], end[whole]
            active = active[block.left[active] > d]
        place = self.origin[self.order[low]] if len(self.order) else low
        return longest, place, first, last, last > first

    def _bound(self, low: np.ndarray, high: np.ndarray, word: np.ndarray, d: int) -> np.ndarray:
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = self.text[self.order[middle] + d] < word[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        return low


def _shard(data: np.ndarray, offsets: np.ndarray, block: Block) -> tuple[Shard | None, np.ndarray, np.ndarray]:
    data = W.lowered(data)
    starts, ends, first = W.spans(data, offsets, W.ALNUM)
    if not len(starts):
        return None, first, starts
    numbers = W.known(block.vocabulary, W.hashes(data, starts, ends)) + 1
    some = np.flatnonzero(numbers)  # a word of the benchmark by one hash must be it by another
    numbers[some[W.hashes(data, starts[some], ends[some], seed=7) != block.check[numbers[some] - 1]]] = 0
    row_end = np.repeat(first[1:], np.diff(first))
    return Shard.of(numbers, row_end, block.least, int(block.left.max())), first, starts


def _hits(data: np.ndarray, offsets: np.ndarray, block: Block) -> tuple[np.ndarray, list, list]:
    """Words, hit ranges and items of each row."""
    shard, first, starts = _shard(data, offsets, block)
    rows = len(offsets) - 1
    hits: list = [[] for _ in range(rows)]
    items: list = [[] for _ in range(rows)]
    if shard is not None:
        _, _, low, high, found = shard.search(block)
        if found.any():
            n = len(starts)
            where = np.flatnonzero(found)
            kinds = np.unique(np.stack([low[where], high[where], block.window[where]], 1), axis=0)
            spots = shard.origin[shard.order[W.ragged(kinds[:, 1] - kinds[:, 0], kinds[:, 0])]]
            size = np.repeat(kinds[:, 2], kinds[:, 1] - kinds[:, 0])
            depth = np.bincount(spots, minlength=n + 1) - np.bincount(spots + size, minlength=n + 1)
            inside = np.concatenate([[False], np.cumsum(depth)[:n] > 0, [False]])
            row_of = np.repeat(np.arange(rows), np.diff(first))
            edge = inside[1:] != inside[:-1]
            begin = np.flatnonzero(edge & inside[1:])
            stop = np.flatnonzero(edge & ~inside[1:])
            for a, b in zip(begin.tolist(), stop.tolist()):
                while a < b:  # neighbouring rows can both be hit up to their common end
                    row = row_of[a]
                    c = min(b, int(first[row + 1]))
                    hits[row].append({"start": a - int(first[row]), "end": c - int(first[row])})
                    a = c
            pairs = []
            for k in where.tolist():
                rows_hit = np.unique(row_of[shard.origin[shard.order[low[k] : high[k]]]])
                pairs.append(rows_hit * len(block.names) + block.item[k])
            for pair in np.unique(np.concatenate(pairs)).tolist():
                row, item = divmod(pair, len(block.names))
                items[row].append(block.names[item])
    return np.diff(first), hits, items


def _union(a: list, b: list) -> list:
    out: list = []
    for span in sorted([*a, *b], key=lambda s: s["start"]):
        if out and span["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], span["end"])
        else:
            out.append(dict(span))
    return out


def _broadcast_blocks(benchmark: DataFrame, item: str, item_text: str, window: int, size: int) -> list:
    pairs = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")), F.col(item_text).cast("string"))
    blocks = blocks_of(((r[0], r[1]) for r in pairs.toLocalIterator()), window, size)
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(block) for block in blocks]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep_text: bool = True,
    only_clean: bool = False,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (word ranges, end exclusive) and ``hit_items``.

    The three columns replace columns of these names. ``keep_text=False`` drops
    the text after the last search; ``only_clean`` drops documents with a hit and
    the three columns.
    """
    added = {"n_words": pa.int64(), "hits": HITS, "hit_items": ITEMS}
    if only_clean:
        blocks = _broadcast_blocks(benchmark, item, item_text, window, block_bytes)
        frame = docs
        for block in blocks:
            frame = frame.mapInArrow(_clean_rows(block, text), docs.schema)
        return frame
    frame = docs.drop(*added)
    blocks = _broadcast_blocks(benchmark, item, item_text, window, block_bytes)
    kept = frame.schema.fields
    result = [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
    for k, block in enumerate(blocks or [None]):
        last = k == max(len(blocks), 1) - 1
        names = [f for f in kept if keep_text or not last or f.name != text]
        frame = frame.mapInArrow(_search(block, text, [f.name for f in names], first=k == 0), T.StructType([*names, *result]))
    return frame


def _search(block, text: str, names: list[str], first: bool):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in W.batches(stream, text, SLICE_BYTES):
            if block is None:
                _, _, bounds = W.spans(W.lowered(data), offsets, W.ALNUM)
                n_words, hits, items = np.diff(bounds), [[]] * len(batch), [[]] * len(batch)
            else:
                n_words, hits, items = _hits(data, offsets, block.value)
            if not first:
                old = batch.column(batch.schema.get_field_index("hits")).to_pylist()
                hits = [_union(a, b) if a else b for a, b in zip(old, hits)]
                old = batch.column(batch.schema.get_field_index("hit_items")).to_pylist()
                items = [a + b for a, b in zip(old, items)]
            items = [sorted(set(x)) for x in items]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(n_words, pa.int64()), pa.array(hits, HITS), pa.array(items, ITEMS)],
                names=[*names, "n_words", "hits", "hit_items"],
            )

    return run


def _clean_rows(block, text: str):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in W.batches(stream, text, SLICE_BYTES):
            _, hits, _ = _hits(data, offsets, block.value)
            yield batch.filter(pa.array([not h for h in hits], pa.bool_()))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a benchmark window, with their own columns."""
    return find_contamination(docs, benchmark, only_clean=True, **options)


def longest_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For every benchmark suffix of which a window's length matches anywhere: item, first word, words
    matched at most, and the document and word of one such match (the smallest)."""
    schema = "item string, item_word long, matched long, doc string, doc_word long"

    def search(block):
        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, data, offsets in W.batches(stream, text, SLICE_BYTES):
                index = block.value
                shard, first, _ = _shard(data, offsets, index)
                if shard is None:
                    continue
                longest, place, *_ = shard.search(index)
                k = np.flatnonzero(longest >= np.minimum(index.least, window))
                row = np.searchsorted(first, place[k], side="right") - 1
                keys = batch.column(batch.schema.get_field_index(key)).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([index.names[i] for i in index.item[k]], pa.string()),
                        pa.array(index.place[k], pa.int64()),
                        pa.array(longest[k], pa.int64()),
                        keys.take(pa.array(row, pa.int64())),
                        pa.array(place[k] - first[row], pa.int64()),
                    ],
                    names=["item", "item_word", "matched", "doc", "doc_word"],
                )

        return run

    parts = [
        docs.select(key, text).mapInArrow(search(block), schema)
        for block in _broadcast_blocks(benchmark, item, item_text, window, block_bytes)
    ]
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = F.min(F.struct((-F.col("matched")).alias("less"), "doc", "doc_word")).alias("best")
    return (
        found.groupBy("item", "item_word").agg(best)
        .select("item", "item_word", (-F.col("best.less")).alias("matched"), "best.doc", "best.doc_word")
    )
