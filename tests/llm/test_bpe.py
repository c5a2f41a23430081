"""BPE against the tokenizers library, and token files by an exact round trip."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from perilscope.llm import bpe, tokenfile
from perilscope.llm import words as W
from perilscope.llm.queries import TOKENIZER

PIECES = ["a", "b", "e", "th", "ing", "er", "S", "'s", "'", "'re", "!", "?!", ",", "7", "12", " ", "\n", "é", "É", "ß",
          "日本", "e\u0301", "€", "<|endoftext|>", "<|", "|>", "İ", "K", "\u00a0", "\x1c", "σΣ", "가", "x", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(TOKENIZER)


def encoded(encoder, texts, leaf):
    data, offsets = W.buffer(pa.array(texts, pa.large_string()))
    ids, first = encoder.encode(data, offsets, leaf)
    return [ids[a:b].tolist() for a, b in zip(first, first[1:])]


def direct(library, texts):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("leaf", [4, 16, 60, 8192])
def test_any_leaves_give_the_library_s_ids(library, encoder, leaf):
    r = random.Random(leaf)
    for pool in (PIECES, [p for p in PIECES if p.strip()], ["a", "b", "th", "ing", "é", "S"]):
        texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 150))) for _ in range(200)]
        assert encoded(encoder, texts, leaf) == direct(library, texts)


def test_windows_grow_until_both_sides_agree(library, encoder):
    r = random.Random(9)
    for pool in (["a", "b", "th", "ing", "er", "é", "tion"], ["a", "'", "'s", "!", "é", "..."]):
        for _ in range(150):
            text = "".join(r.choice(pool) for _ in range(r.randint(60, 400)))
            cuts = sorted({len(text[:c].encode()) for c in r.sample(range(1, len(text)), 5)})
            assert encoder.concatenate(text.encode(), cuts, window=2, whole=0).tolist() == direct(library, [text])[0]


def test_a_very_long_unbroken_text(library, encoder):
    r = random.Random(4)
    text = "".join(r.choice("abcdefgé") for _ in range(60_000))
    assert encoded(encoder, [text, "ok"], 1024) == direct(library, [text, "ok"])


def test_forgetting_the_table_changes_nothing(library, encoder, monkeypatch):
    texts = ["some words here", "and others there, 12 of them"] * 3
    monkeypatch.setattr(bpe, "STORE_IDS", 1)
    assert encoded(encoder, texts, 8) == direct(library, texts)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 300))) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(3, None), (None, "no key"), (200, ""), (7, texts[7]), (7, "another text"), (300, "word " * 30_000)]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, 5) for k, t in rows], "doc_id long, text string, n_tokens int")


def test_encode_and_decode_texts(spark, library, rows):
    add = ("n_tokens", "tokens", "ids_sha256", "decoded", "decoded_sha256")
    out = bpe.encode_texts(frame(spark, rows), TOKENIZER, add=add, leaf=64)
    assert out.columns == ["doc_id", "text", *add]
    for r in out.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r["tokens"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == text
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    again = bpe.decode_tokens(out.select("doc_id", "tokens", "decoded").withColumnRenamed("decoded", "want"), TOKENIZER)
    assert again.where("decoded <> want").count() == 0


def test_empty_tables(spark, tmp_path):
    none = frame(spark, []).limit(0)
    assert bpe.encode_texts(none, TOKENIZER).count() == 0
    folder = tokenfile.write_token_files(none, TOKENIZER, folder=str(tmp_path / "none"))
    assert tokenfile.read_token_files(spark, folder).count() == 0


def test_token_files_give_back_every_id(spark, library, rows, tmp_path):
    folder = tokenfile.write_token_files(frame(spark, rows), TOKENIZER, block_ids=2000, folder=str(tmp_path / "t"))
    got = sorted(tokenfile.read_token_files(spark, folder).collect(), key=lambda r: r["start"])
    assert len(got) == len(rows)
    start = 0
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: -1 if k is None else k)
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["tokens"]) and r["tokens"][-1] == 1
        assert r["ids_crc32"] == zlib.crc32(np.array(r["tokens"], "<u4").tobytes())
        start += r["n_tokens"]
    want = sorted((-1 if k is None else k, library.encode(t or "", add_special_tokens=False).ids + [1]) for k, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["tokens"]) for r in got) == want


def test_grammar_decodes_single_documents():
    r = np.random.default_rng(3)
    for alphabet in (2, 5, 400):
        ids = r.integers(0, alphabet, 20_000)
        ends = r.random(len(ids)) < 0.01
        ends[-1] = True
        grammar, last = tokenfile.compress(ids, ends, base=500)
        assert (grammar.expand(grammar.codes) == ids).all()
        assert len(grammar.codes) < len(ids) or not len(grammar.rules)
        bounds, codes = np.flatnonzero(ends) + 1, np.append(0, np.flatnonzero(last) + 1)
        k = len(bounds) // 2
        assert (grammar.expand(grammar.codes[codes[k] : codes[k + 1]]) == ids[bounds[k - 1] : bounds[k]]).all()
        for rule, length in zip(grammar.rules, grammar.lengths):
            assert length == len(grammar.expand(rule))
