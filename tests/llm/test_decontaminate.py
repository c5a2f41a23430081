"""Benchmark decontamination against a plain search."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilscope.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(docs, items, window=10):
    out = []
    for key, text in docs:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            v = words(item)
            size = min(window, len(v))
            for i in range(len(v) - size + 1 if v else 0):
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == v[i : i + size]:
                        hit |= set(range(j, j + size))
                        names.add("null" if name is None else str(name))
        out.append((key, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


def found(frame):
    rows = frame.collect()
    return sorted(
        ((r["doc_id"], r["n_words"], sum(h["end"] - h["start"] for h in r["hits"]), r["hit_items"]) for r in rows), key=str
    )


def frames(spark, docs, items):
    d = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, hits string, n_words int")
    return d, spark.createDataFrame(items, "item_id long, text string")


def corpus(seed, n=60, vocabulary=6):
    r = random.Random(seed)
    some = ["ab", "É", "c3", "the", "日本", "Zz", "7"][:vocabulary]
    text = lambda k: "".join(r.choice(some) + r.choice([" ", ", ", "\n", "-"]) for _ in range(k))
    items = [(i, text(r.choice([1, 3, 10, 14]))) for i in range(8)] + [(3, None), (None, text(12)), (4, ""), (2, "ab")]
    docs = [(i, text(r.randint(0, 40))) for i in range(n)] + [(5, None), (None, items[-3][1]), (6, ""), (7, "?!"), (5, items[0][1] * 3)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_hits_equal_a_plain_search(spark, seed):
    docs, items = corpus(seed)
    d, b = frames(spark, docs, items)
    assert found(D.find_contamination(d, b)) == brute(docs, items)


def test_several_blocks_give_the_same(spark):
    docs, items = corpus(3)
    d, b = frames(spark, docs, items)
    assert found(D.find_contamination(d, b, block_bytes=20)) == brute(docs, items)


def test_clean_documents_stay_whole(spark):
    docs, items = corpus(4, vocabulary=7)
    d, b = frames(spark, docs, items)
    clean = {(k, t) for (k, t) in docs if brute([(k, t)], items)[0][2] == 0}
    kept = D.decontaminate(d, b)
    assert kept.columns == d.columns
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == clean


def test_empty_tables(spark):
    docs, items = corpus(5, n=4)
    d, b = frames(spark, docs, items)
    assert all(not r["hits"] and r["hit_items"] == [] for r in D.find_contamination(d, b.limit(0)).collect())
    assert D.find_contamination(d.limit(0), b).count() == 0
    assert D.decontaminate(d, b.limit(0)).count() == len(docs)
    assert D.longest_matches(d, b.limit(0)).count() == 0


def test_longest_matches_and_their_places(spark):
    text = "x0 " * 30 + " ".join(f"w{i}" for i in range(25)) + " y" * 2000
    d, b = frames(spark, [(1, text), (2, " ".join(f"w{i}" for i in range(12)))], [(9, " ".join(f"w{i}" for i in range(5, 40)))])
    rows = {r["item_word"]: r for r in D.longest_matches(d, b).collect()}
    assert (rows[0]["matched"], rows[0]["doc"], rows[0]["doc_word"]) == (20, "1", 35)
    assert rows[10]["matched"] == 10 and max(rows) == 10


def test_suffix_array_orders_suffixes():
    r = np.random.default_rng(2)
    text = np.append(r.integers(1, 4, 300), np.zeros(40, np.int64))
    order = D.suffix_array(text, np.arange(300), 20)
    keys = [tuple(text[i : i + 20]) for i in order]
    assert keys == sorted(keys)


def test_query_on_small_tables(spark, sf_dir):
    from perilscope.llm.queries import op1_decontamination

    assert op1_decontamination(spark, sf_dir).where(F.col("contaminated")).count() > 0
