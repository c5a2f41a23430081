"""Token ids in grammar-compressed files that allow random access.

Documents are range-partitioned and sorted by key (then by a hash of the text, so that rows of
one key are ordered too), encoded, and written in blocks of about
``BLOCK_IDS`` ids. Each block is compressed by Re-Pair: the most frequent pairs of
neighbouring symbols become new symbols, again and again, ``PAIRS_A_ROUND``
pairs at a time. A block stores its rules, the expansion length of every rule, and
for each document the ids and symbols it takes, so one document is decoded
without the others. Rules never cross a document's end.

One row of a file: ``part`` and ``first_id`` (ids before the block within its
part), ``n_ids``, ``keys``, ``id_counts``, ``code_counts`` (lists, by document), ``codes``
(16-bit symbols), ``base`` (the first new symbol), ``rules`` (pairs of symbols, one per
new symbol) and ``lengths``.

Defined results: a null or empty text has only the end id; null keys come first; rows
with one key are all kept; no rows give an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perilscope.llm import bpe
from perilscope.llm import words as W
from perilscope.session import job_folder

BLOCK_IDS = 1 << 20
PAIRS_A_ROUND = 4096
ROUNDS = 4
LEAST = 8  # a pair that is seen less often is left
SYMBOLS = 1 << 16


@dataclass
class Grammar:
    """``codes`` over ids below ``base`` and rules; rule k is the symbol ``base + k``."""

    base: int
    codes: np.ndarray
    rules: np.ndarray  # (n, 2)
    lengths: np.ndarray  # ids that each rule stands for

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expansions of all symbols: flat ids, first, length."""
        n = len(self.rules)
        flat = self.rules.reshape(-1).astype(np.int64)
        while n and (flat >= self.base).any():
            new = flat >= self.base
            size = np.where(new, 2, 1)
            out = np.repeat(flat, size)
            at = np.cumsum(size) - size
            out[at[new]] = self.rules[flat[new] - self.base, 0]
            out[at[new] + 1] = self.rules[flat[new] - self.base, 1]
            flat = out
        length = np.concatenate([np.ones(self.base, np.int64), self.lengths.astype(np.int64)])
        return np.concatenate([np.arange(self.base), flat]), np.cumsum(length) - length, length

    def expand(self, codes: np.ndarray, table: tuple | None = None) -> np.ndarray:
        flat, first, length = table or self.table()
        codes = codes.astype(np.int64)
        return flat[W.ragged(length[codes], first[codes])]


def compress(ids: np.ndarray, ends: np.ndarray, base: int, rounds: int = ROUNDS) -> tuple[Grammar, np.ndarray]:
    """Re-Pair over the ids of several documents; ``ends`` marks each one's last id.
    Also returns the marks of the codes."""
    seq, last = ids.astype(np.int64), ends.copy()
    rules: list[np.ndarray] = []
    lengths = np.ones(base, dtype=np.int64)
    n_rules = 0
    for _ in range(rounds):
        room = min(PAIRS_A_ROUND, SYMBOLS - base - n_rules)
        if len(seq) < 2 or room <= 0:
            break
        pairs = (seq[:-1] << 17) | seq[1:]
        pairs[last[:-1]] = -1
        ordered = np.sort(pairs)
        at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        seen = np.diff(np.append(at, len(ordered)))
        often = np.flatnonzero((seen >= LEAST) & (ordered[at] >= 0))
        if not len(often):
            break
        if len(often) > room:  # the most frequent, ties by pair
            often = often[np.argsort(-seen[often], kind="stable")[:room]]
        chosen = np.sort(ordered[at[often]])
        number = W.known(chosen, pairs)
        marked = np.flatnonzero(number >= 0)
        # of overlapping pairs the first, third, fifth ... are replaced
        opens = np.append(True, np.diff(marked) != 1)
        group = np.cumsum(opens) - 1
        place = marked - marked[np.flatnonzero(opens)][group]
        taken = marked[place % 2 == 0]
        left, right = chosen >> 17, chosen & ((1 << 17) - 1)
        rules.append(np.stack([left, right], 1))
        lengths = np.concatenate([lengths, lengths[left] + lengths[right]])
        seq[taken] = base + n_rules + number[taken]
        last[taken] = last[taken + 1]
        keep = np.ones(len(seq), dtype=bool)
        keep[taken + 1] = False
        seq, last = seq[keep], last[keep]
        n_rules += len(chosen)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return Grammar(base, seq, table, lengths[base:]), last


def _row(keys: list, ids: list[np.ndarray], counts: list[int], base: int, part: int, first_id: int) -> dict:
    flat = np.concatenate(ids)
    ends = np.zeros(len(flat), dtype=bool)
    ends[np.cumsum(counts) - 1] = True
    grammar, last = compress(flat, ends, base)
    return {
        "part": part,
        "first_id": first_id,
        "n_ids": len(flat),
        "keys": keys,
        "id_counts": counts,
        "code_counts": np.diff(np.append(-1, np.flatnonzero(last))).tolist(),
        "base": base,
        "codes": grammar.codes.astype("<u2").tobytes(),
        "rules": grammar.rules.astype("<u2").tobytes(),
        "lengths": grammar.lengths.astype("<u4").tobytes(),
    }


def write_token_files(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 1,
    block_ids: int = BLOCK_IDS, folder: str | None = None,
) -> str:
    """Encode all documents with the tokenizer file ``path`` and write the blocks; returns their folder."""
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("keys", T.ArrayType(kind)),
        T.StructField("id_counts", T.ArrayType(T.LongType())),
        T.StructField("code_counts", T.ArrayType(T.LongType())),
        T.StructField("base", T.IntegerType()),
        T.StructField("codes", T.BinaryType()),
        T.StructField("rules", T.BinaryType()),
        T.StructField("lengths", T.BinaryType()),
    ])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.encoder(path)
        base, part = len(own.names), TaskContext.get().partitionId()
        keys: list = []
        ids: list[np.ndarray] = []
        counts: list[int] = []
        held = before = 0
        arrow = None
        for batch, data, offsets in W.batches(stream, text):
            if arrow is None:
                kinds = {"keys": pa.list_(batch.column(batch.schema.get_field_index(key)).type)}
                kinds |= {"part": pa.int32(), "base": pa.int32(), "first_id": pa.int64(), "n_ids": pa.int64()}
                kinds |= {c: pa.list_(pa.int64()) for c in ("id_counts", "code_counts")}
                kinds |= {c: pa.binary() for c in ("codes", "rules", "lengths")}
                arrow = pa.schema([(f.name, kinds[f.name]) for f in schema.fields])
            tokens, first = own.encode(data, offsets)
            names = batch.column(batch.schema.get_field_index(key)).to_pylist()
            begin = 0
            while begin < len(names):
                room = max(block_ids - held, 1)
                end = int(np.searchsorted(first, first[begin] + room, side="right")) - 1
                end = min(max(end, begin + 1), len(names))
                part_ids = np.insert(tokens[first[begin] : first[end]], first[begin + 1 : end + 1] - first[begin], end_id)
                ids.append(part_ids)
                keys += names[begin:end]
                counts += (np.diff(first[begin : end + 1]) + 1).tolist()
                held += len(part_ids)
                if held >= block_ids:
                    yield pa.RecordBatch.from_pylist([_row(keys, ids, counts, base, part, before)], arrow)
                    before += held
                    keys, ids, counts, held = [], [], [], 0
                begin = end
        if keys:
            yield pa.RecordBatch.from_pylist([_row(keys, ids, counts, base, part, before)], arrow)

    folder = folder or job_folder(docs.sparkSession, "tokens")
    (
        docs.select(key, text).withColumn("_order", F.xxhash64(text))
        .repartitionByRange(key, "_order").sortWithinPartitions(key, "_order")
        .select(key, text)
        .mapInArrow(run, schema)
        .write.parquet(folder)
    )
    return folder


def read_token_files(spark: SparkSession, folder: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per document: key, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``, and ``tokens`` if asked for."""
    blocks = spark.read.parquet(folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per part file
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    placed = blocks.join(F.broadcast(parts), "part").withColumn("first_id", F.col("first_id") + F.col("before")).drop("before", "part")
    fields = [
        T.StructField(key, blocks.schema["keys"].dataType.elementType),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("tokens", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for k in range(len(batch)):
                row = {c: batch.column(batch.schema.get_field_index(c)).slice(k, 1) for c in batch.schema.names}
                ids, bounds = decode_block(row)
                raw = ids.astype("<u4")
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
                columns = [
                    row["keys"].flatten(),
                    pa.array(row["first_id"][0].as_py() + bounds[:-1], pa.int64()),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array(crcs, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return placed.mapInArrow(run, schema)


def _grammar(row: dict) -> Grammar:
    rules = np.frombuffer(row["rules"][0].as_py(), "<u2").reshape(-1, 2).astype(np.int64)
    lengths = np.frombuffer(row["lengths"][0].as_py(), "<u4")
    codes = np.frombuffer(row["codes"][0].as_py(), "<u2")
    return Grammar(row["base"][0].as_py(), codes, rules, lengths)


def decode_block(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block and each document's bounds."""
    grammar = _grammar(row)
    counts = row["id_counts"].flatten().to_numpy()
    return grammar.expand(grammar.codes), np.concatenate([[0], np.cumsum(counts)])


def decode_document(row: dict, k: int) -> np.ndarray:
    """The ids of one document of a block, from its own symbols alone."""
    grammar = _grammar(row)
    bounds = np.concatenate([[0], np.cumsum(row["code_counts"].flatten().to_numpy())])
    return grammar.expand(grammar.codes[bounds[k] : bounds[k + 1]])
