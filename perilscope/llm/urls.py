"""URL filters over a sorted array of digests.

Filter entries are host suffixes with an optional path prefix. Their 64-bit
xxhash digests are sorted in one file beside the full strings; every task maps
the file into memory, probes all candidate prefixes of its URLs with one
vectorised binary search and compares the stored string, so that a collision of
digests never decides. A file is built only up to ``MAX_BYTES``; a larger list
is joined on the digest and the string instead, with the same result.

Defined results: a null URL or one without ``://`` has an empty host and path and
no entry; repeated URLs are judged one by one; of repeated entries the same
key with verdict ``block`` wins; of entries of equal length that fit, the one with the longer
path wins; other columns pass through.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES = 256 << 20
SEED = 42  # the seed of Spark's own xxhash64

_HOST_END = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path of a URL."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = _HOST_END.search(rest)
    if end is None:
        return rest.translate(_LOWER), ""
    host, path = rest[: end.start()], rest[end.start() :]
    stop = _PATH_END.search(path)
    return host.translate(_LOWER), path[: stop.start()] if stop else path


def candidates(host: str, path: str, labels: int, lengths: list[int]) -> list[str]:
    """Every entry that could fit: host suffixes of up to ``labels`` labels, with path prefixes of the given lengths."""
    suffixes, at = [], len(host)
    for _ in range(labels):
        at = host.rfind(".", 0, at)
        suffixes.append(host[at + 1 :])
        if at < 0:
            break
    return [s + path[:n] for s in suffixes for n in lengths if n <= len(path)]


def digest(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), np.uint64, len(keys))


def entry_table(entries: DataFrame) -> DataFrame:
    """Entries (``key``, ``verdict``, ``listed``) with digest, one row per key and kind.

    ``listed`` entries only count where no rule (``listed`` false) fits.
    """
    return (
        entries.where("key is not null and verdict is not null")
        .groupBy("key", F.coalesce("listed", F.lit(False)).alias("listed"))
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("digest", F.xxhash64("key"))
    )


class Index:
    """The memory-mapped file: sorted digests, string offsets, marks, then the strings."""

    def __init__(self, path: str):
        n = int(np.fromfile(path, np.int64, 1)[0])
        self.digests = np.memmap(path, np.uint64, "r", 8, (n,)) if n else np.zeros(0, np.uint64)
        self.offsets = np.memmap(path, np.int64, "r", 8 + 8 * n, (n + 1,))
        self.marks = np.memmap(path, np.uint8, "r", 16 + 16 * n, (n,)) if n else np.zeros(0, np.uint8)
        size = int(self.offsets[-1])
        self.strings = np.memmap(path, np.uint8, "r", 16 + 17 * n, (size,)) if size else np.zeros(0, np.uint8)

    @staticmethod
    def write(path: str, keys: list[str], marks: list[int]) -> None:
        digests = digest(keys)
        order = np.argsort(digests, kind="stable")
        raw = [keys[i].encode() for i in order]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        with open(path, "wb") as out:
            out.write(np.int64(len(keys)).tobytes())
            out.write(digests[order].tobytes())
            out.write(offsets.tobytes())
            out.write(np.asarray(marks, np.uint8)[order].tobytes())
            out.write(b"".join(raw))

    def probe(self, keys: list[str]) -> list[list[int]]:
        """The marks of each key's entries; none for a key that is not stored."""
        wanted = digest(keys)
        low = np.searchsorted(self.digests, wanted, side="left")
        high = np.searchsorted(self.digests, wanted, side="right")
        found: list[list[int]] = [[] for _ in keys]
        for k in np.flatnonzero(high > low).tolist():
            raw = keys[k].encode()
            for at in range(low[k], high[k]):
                if self.strings[self.offsets[at] : self.offsets[at + 1]].tobytes() == raw:
                    found[k].append(int(self.marks[at]))
        return found


_MARKS = {(False, "block"): 0, (False, "allow"): 1, (True, "block"): 2, (True, "allow"): 3}
_open: dict[str, Index] = {}


def _path_length() -> Column:
    slash = F.locate("/", F.col("key"))
    return F.when(slash > 0, F.char_length("key") - slash + 1).otherwise(0)


def filter_urls(
    pages: DataFrame, entries: DataFrame, url: str = "url", max_bytes: int = MAX_BYTES
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the longest that fits, else null) and ``verdict``.

    A rule's verdict counts before a listed entry's; of listed entries the
    longest counts; without any, ``allow``. The four columns replace columns
    of these names.
    """
    table = entry_table(entries)
    shape = table.agg(
        F.sum(F.octet_length("key") + 17).alias("size"),
        F.max(F.size(F.split("key", r"\.", -1))).alias("labels"),
        F.collect_set(_path_length()).alias("lengths"),
    ).first()
    labels, lengths = shape["labels"] or 0, sorted(shape["lengths"])
    added = [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]
    base = pages.drop("host", "path", "rule", "verdict") if url not in ("host", "path", "rule", "verdict") else pages
    if (shape["size"] or 0) > max_bytes:
        return _joined(base, table, url, labels, lengths)
    rows = table.select("key", "listed", "verdict").collect()
    name = f"digests-{uuid.uuid4().hex}.bin"
    local = os.path.join(tempfile.mkdtemp(prefix="digests-"), name)
    Index.write(local, [r["key"] for r in rows], [_MARKS[r["listed"], r["verdict"]] for r in rows])
    pages.sparkSession.sparkContext.addFile(local)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _open:
            _open.clear()  # a worker keeps one file open
            _open[name] = Index(SparkFiles.get(name))
        index = _open[name]
        for batch in stream:
            parts = [split_url(u) for u in batch.column(batch.schema.get_field_index(url)).to_pylist()]
            keys = [candidates(h, p, labels, lengths) for h, p in parts]
            flat = [k for ks in keys for k in ks]
            marks = iter(index.probe(flat))
            rules, verdicts = [], []
            for ks in keys:
                best = {True: ("", "allow"), False: (None, None)}
                for key in ks:
                    for mark in next(marks):
                        listed, verdict = mark > 1, "allow" if mark % 2 else "block"
                        # candidates come with the shorter host, that is the longer path, first
                        if len(key) > len(best[listed][0] or ""):
                            best[listed] = (key, verdict)
                rules.append(best[False][0])
                verdicts.append(best[False][1] or best[True][1])
            new = [[h for h, _ in parts], [p for _, p in parts], rules, verdicts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(x, pa.string()) for x in new)],
                names=[*batch.schema.names, *(f.name for f in added)],
            )

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *added]))


def _joined(pages: DataFrame, table: DataFrame, url: str, labels: int, lengths: list[int]) -> DataFrame:
    """The same result for a list of any size: distinct hosts and paths are
    joined with the entries on digest and string, the decision joined back."""
    pair = F.udf(lambda u: split_url(u), "struct<host: string, path: string>")
    fitting = F.udf(lambda h, p: candidates(h, p, labels, lengths), T.ArrayType(T.StringType()))
    split = pages.withColumn("_url", pair(url)).withColumns({"host": F.col("_url.host"), "path": F.col("_url.path")})
    keys = (
        split.select("host", "path").distinct()
        .select("host", "path", F.explode(fitting("host", "path")).alias("key"))
        .withColumn("digest", F.xxhash64("key"))
    )
    hits = keys.join(table, ["digest", "key"])
    longest = F.struct(F.char_length("key").alias("n"), _path_length().alias("path_length"), "key", "verdict")
    decided = hits.groupBy("host", "path").agg(
        F.max(longest).alias("any"), F.max(F.when(~F.col("listed"), longest)).alias("rule_row")
    )
    return (
        split.drop("_url").join(decided, ["host", "path"], "left")
        .withColumns({
            "rule": F.col("rule_row.key"),
            "verdict": F.coalesce("rule_row.verdict", "any.verdict", F.lit("allow")),
        })
        .select(*pages.columns, "host", "path", "rule", "verdict")
    )
