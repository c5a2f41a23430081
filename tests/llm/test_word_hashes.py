"""Words that polynomial hashes cannot tell apart, in every operator that hashes words."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from perilscope.llm import bpe, decontaminate, hmm, jaccard
from perilscope.llm import words as W
from perilscope.llm.queries import TOKENIZER


def pair(a="a", b="b", length=1024):
    """Two words in Thue-Morse order: one has the letters of the other swapped."""
    bits = [bin(k).count("1") % 2 for k in range(length)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


ONE, TWO = pair()


def hashed(texts, seed=0):
    data, offsets = W.buffer(pa.array(texts))
    return W.hashes(data, offsets[:-1], offsets[1:], seed)


@pytest.mark.parametrize("length", [8, 64, 512, 1024, 2048, 65536])
def test_hashes_tell_them_apart(length):
    for seed in (0, 7):
        assert len(set(hashed([*pair(length=length), *pair("0", "1", length)], seed).tolist())) == 4


def test_equal_bytes_have_equal_hashes_wherever_they_stand():
    r = np.random.default_rng(1)
    base = ["", "a", "ab" * 500, "x" * 1024, "x" * 1025, "y" * 5000] + ["".join(chr(97 + c) for c in r.integers(0, 3, n)) for n in r.integers(1, 40, 300)]
    alone = [int(hashed([t])[0]) for t in base]
    for shift in range(9):
        data, offsets = W.buffer(pa.array(["z" * shift, *base]))
        assert W.hashes(data, offsets[1:-1], offsets[2:]).tolist() == alone
    assert len(set(alone)) == len(set(base))
    assert not set(alone) & {int(x) for x in hashed(base, 7)}


def test_token_ids(spark):
    library = Tokenizer.from_file(TOKENIZER)
    texts = [ONE, TWO, f"{ONE} {TWO}", *pair("0", "1"), f"x {TWO} y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in bpe.encode_texts(df, TOKENIZER, add=("tokens",)).collect():
        assert r["tokens"] == library.encode(r["text"], add_special_tokens=False).ids


def test_a_full_table_changes_no_id(spark, monkeypatch):
    monkeypatch.setattr(bpe, "SLOTS", 16)
    monkeypatch.setattr(bpe, "STORE_IDS", 50)
    library = Tokenizer.from_file(TOKENIZER)
    encoder = bpe.Encoder(TOKENIZER)
    texts = [" ".join(f"w{k * j % 97}" for k in range(60)) for j in range(1, 30)]
    for t in texts:
        data, offsets = W.buffer(pa.array([t]))
        assert encoder.encode(data, offsets)[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_links_and_passages(spark):
    rest = " ".join(f"w{k}" for k in range(30))
    rows = [(1, f"{ONE} b c"), (2, f"{TWO} b c"), (3, ONE), (4, TWO), (5, f"{ONE} {rest}"), (6, f"{ONE} {rest}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_join(df).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5}
    benchmark = spark.createDataFrame([("i", f"{ONE} b c")], "item_id string, text string")
    found = {r["doc_id"]: len(r["hit_items"]) for r in decontaminate.find_contamination(df, benchmark).collect()}
    assert found == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0}


def test_word_counts(spark):
    rows = [(1, ONE, True), (2, TWO, False), (3, ONE, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    assert {r["doc_id"]: r["n_known"] for r in hmm.score_texts(df).collect()} == {1: 2, 2: 1, 3: 2}
