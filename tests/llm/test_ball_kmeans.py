"""Codes of vectors against plain k-means in Python integers."""

import hashlib
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilscope.llm import ballkmeans as B
from perilscope.llm import groups

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    width = -(-size // parts)
    single = [[struct.unpack("f", struct.pack("f", x))[0] for x in r[1]] for r in kept]
    most = B.limit(parts * width, entries)
    whole = [[min(max(math.floor(256 * x), -most), most) for x in v] + [0] * (parts * width - size) for v in single]
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for v in cut:
                members.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            for j, xs in members.items():
                books[p][j] = tuple(sum(c) // len(xs) for c in zip(*xs))
    out, sums = [], {}
    for r, v in zip(kept, cut):
        found = [nearest(v[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        sums[r[2]] = sums.get(r[2], 0) + error
        out.append((r[0], "".join(f"{j:02x}" for _, j in found), error, r[2]))
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((k, c, e, sums[label]) for k, c, e, label in out), key=str), digest


def codes(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3, F.rand(1))
    for name in ("key", "x", "code", "error", "label_error", "_group", "v"):
        df = df.withColumn(name, F.lit("z"))
    done = B.compress(df, **options)
    out = B.with_label_error(done.codes(), "label").collect()
    found = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out), key=str)
    return found, done.codebooks and done.codebooks.digest()


def vectors(seed, n, size):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 0.3, (5, size))
    rows = [(int(k), (centres[k % 5] + r.normal(0, 0.05, size)).tolist(), int(k % 4)) for k in r.permutation(n)]
    rows += [(k, rows[0][1], None) for k in range(n, n + 30)]  # one vector many times: equal entries and ties
    return rows + rows[:9]


@pytest.mark.parametrize("seed,size,entries,hot", [(1, 32, 64, 512), (2, 20, 8, 2), (3, 16, 64, 1)])
def test_against_plain_k_means(spark, seed, size, entries, hot, monkeypatch):
    monkeypatch.setattr(groups, "HOT_GROUPS", hot)
    monkeypatch.setattr(B, "BATCH", 50)
    rows = vectors(seed, 220, size)
    bad = [(-1, None, 1), (-2, [], 1), (-3, [None] * size, 1), (-4, [math.nan] * size, 2), (-5, [math.inf] * size, 2), (900, [1.0], 1)]
    odd = [(None, rows[3][1], None), (901, [1e30] * size, 3), (902, [0.0] * size, 3)]
    assert codes(spark, rows + bad + odd, entries=entries) == brute(rows + bad + odd, entries=entries)


def test_few_and_no_vectors(spark):
    few = vectors(4, 3, 16)[:3]
    assert codes(spark, few) == brute(few)
    assert codes(spark, []) == ([], None)
    assert codes(spark, [(1, None, 1)]) == ([], None)


def test_rings_skip_work_and_change_nothing():
    r = np.random.default_rng(5)
    book = r.integers(-1000, 1000, (64, 4))
    book[9] = book[40]
    x = book[r.integers(0, 64, 5000)] + r.integers(-60, 60, (5000, 4))
    before = B.nearest_of_all(x, book)
    moved = book + r.integers(-20, 20, book.shape)
    entry, distance, compared = B.nearest_from(x, moved, before)
    assert (entry == B.nearest_of_all(x, moved)).all() and (distance == ((x - moved[entry]) ** 2).sum(1)).all()
    assert compared < 0.25 * 64 * len(x)
    far, _, _ = B.nearest_from(x, moved, np.zeros(len(x), dtype=np.int64))
    assert (far == entry).all()


def test_a_code_stands_for_a_vector_nearby(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    done = B.compress(df)
    rows = {r["vec_id"]: r for r in done.codes().collect()}
    for r in df.limit(20).collect():
        if r["embedding"]:
            back = np.floor(256 * done.codebooks.vector(rows[r["vec_id"]]["code"]))
            assert int(((np.floor(256 * np.array(r["embedding"])) - back) ** 2).sum()) == rows[r["vec_id"]]["error"]
