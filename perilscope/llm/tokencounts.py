"""Token counts through a cache of digests.

The normalised content of a text (null counts as empty, a tokenizer's own normaliser is part of its
version) has a sha256 digest; the tokenizer's version has one too: of its file's bytes, the library's name and
its release. Counts are stored under both. Documents are joined to the stored counts by digest; of
the others one text per digest is encoded, and the new counts are appended to the cache, from which all
documents then take theirs.

Copies are dropped inside the reading tasks before anything is shuffled, so a text with a third of all rows
moves once per task; its count is sent back by broadcast (see ``groups``). Appended files are
committed by Spark's writer: a job that fails leaves no half-written counts, two jobs that
append the same digest leave a repeated row, which reading removes.

Defined results: a null text counts as an empty one, with 0 bytes and 0 tokens; repeated rows and equal texts
have equal counts; no rows give no rows; columns named like the added ones are replaced. A text of any length
is counted whole: long ones are encoded in pieces, cut where the tokenizer splits in any case.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilscope.llm import words as W
from perilscope.llm.groups import join_groups
from perilscope.session import job_folder, materialise, path_exists

PIECE_BYTES = 1 << 16  # of a long text, encoded at once
TOGETHER_BYTES = 1 << 18  # of texts and pieces, encoded at once
FEW_MISSES = 100_000  # digests (32 bytes each) that are sent to every task

#: The settings for which the places where long texts are cut are known to be borders.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

CACHE_SCHEMA = "digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """The digest of all that counts depend on besides the text."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    seen = hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode())
    with open(path, "rb") as file:
        seen.update(file.read())
    return seen.hexdigest()


class Counter:
    """Counts tokens of strings: tokenizers for ``.json`` files, sentencepiece for ``.model`` files.

    Special strings inside texts are what the library takes them for by default; nothing is cut off, padded
    or added.
    """

    def __init__(self, path: str):
        self.divisible = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count: Callable[[list[str]], list[int]] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core; the library's threads would compete
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.count = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        names = [x["content"] for x in spec["added_tokens"]]
        self.divisible = (
            spec["normalizer"] is None
            and spec["pre_tokenizer"] == BYTE_LEVEL
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
            and not any(c.isspace() or c.isdigit() for name in names for c in name)
        )

    def pieces(self, data: np.ndarray, size: int = PIECE_BYTES) -> list[int]:
        """Ends of the pieces of one text of more than ``size`` bytes.

        A cut stands before ASCII white space that follows another ASCII sign, or between an ASCII letter
        and an ASCII digit: no unit of the tokenizer's pattern and no special string goes across. A stretch without
        such a place stays whole.
        """
        if not self.divisible:
            return [len(data)]
        kind = _KIND[data]
        a, b = kind[:-1], kind[1:]
        places = np.flatnonzero(((a >= 2) & (b == 1)) | ((a == 3) & (b == 4)) | ((a == 4) & (b == 3))) + 1
        ends, last = [], 0
        while len(data) - last > size:
            k = np.searchsorted(places, last + size)
            if k == len(places):
                break
            last = int(places[k])
            ends.append(last)
        return [*ends, len(data)]

    def __call__(self, data: np.ndarray, offsets: np.ndarray, size: int = PIECE_BYTES) -> np.ndarray:
        """Tokens of every row of a text column."""
        counts = np.zeros(len(offsets) - 1, dtype=np.int64)
        texts: list[str] = []
        rows: list[int] = []
        held = 0

        def encode() -> None:
            nonlocal held
            if texts:
                np.add.at(counts, rows, self.count(texts))
            texts.clear()
            rows.clear()
            held = 0

        for row, (first, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            raw = data[first:end]
            last = 0
            for stop in self.pieces(raw, size) if len(raw) > size else [len(raw)]:
                texts.append(raw[last:stop].tobytes().decode("utf-8", "replace"))
                rows.append(row)
                held += stop - last
                last = stop
                if held >= TOGETHER_BYTES:
                    encode()
        encode()
        return counts


# ASCII white space 1, letters 3, digits 4, other signs 2; everything else 0
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[65:91] = _KIND[97:123] = 3
_KIND[48:58] = 4

def counter(path: str) -> Counter:
    """The counter of this Python worker."""
    return W.kept(f"counter {path}", lambda: Counter(path))


class CountCache:
    """Stored counts below ``path``, a folder that every machine reaches, one subfolder per tokenizer version."""

    def __init__(self, spark: SparkSession, path: str, version: str):
        self.spark, self.path = spark, f"{path}/version={version}"

    def stored(self) -> DataFrame | None:
        """``digest`` and ``n_tokens``, each digest once; None while nothing is stored."""
        if not path_exists(self.spark, self.path):
            return None
        return self.spark.read.schema(CACHE_SCHEMA).parquet(self.path).dropDuplicates(["digest"])

    def append(self, counts: DataFrame) -> None:
        counts.select("digest", "n_tokens").write.mode("append").parquet(self.path)


def count_tokens(
    docs: DataFrame, path: str, cache: str | None = None, text: str = "text", piece: int = PIECE_BYTES
) -> DataFrame:
    """The columns of ``docs`` but the text, with ``n_bytes`` and ``n_tokens``, for the tokenizer file ``path``
    (on every machine). ``cache`` is the folder of stored counts; without one a new, empty folder is taken."""
    spark = docs.sparkSession
    store = CountCache(spark, cache or job_folder(spark, "token-counts"), tokenizer_version(path))
    others = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens")]
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(content, 256)).alias("digest")
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("row")
    keys = materialise(docs.select(row, digest, F.octet_length(content).cast("long").alias("n_bytes")), "content")
    sizes = materialise(keys.groupBy("digest").agg(F.count(F.lit(1)).alias("_rows")), "digests")

    texts = docs.select(digest, content.alias("text"))
    stored = store.stored()
    if stored is not None:
        missing = materialise(sizes.select("digest").join(stored, "digest", "left_anti"), "missing")
        few = missing.count() <= FEW_MISSES
        texts = texts.join(F.broadcast(missing) if few else missing, "digest", "left_semi")
    distinct = texts.groupBy("digest").agg(F.first("text").alias("text"))

    def encode(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch, data, offsets in W.batches(stream, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.binary()), pa.array(own(data, offsets, piece))], names=["digest", "n_tokens"]
            )

    store.append(distinct.mapInArrow(encode, CACHE_SCHEMA))
    counts = sizes.join(store.stored(), "digest")
    counted = join_groups(keys, counts, "digest", "_rows")
    return counted.select(*[F.col("row")[c].alias(c) for c in others], "n_bytes", "n_tokens")
