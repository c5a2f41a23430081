"""Token counts against the libraries, and what the cache saves."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from perilscope.llm import tokencounts
from perilscope.session import job_folder

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def texts(seed, n=60):
    r = random.Random(seed)
    parts = ["word", " ", "  ", "\n", "\n\n ", "it's", "12345", "a1b2", "<|endoftext|>", "é", "日本語", "...", "!?", "\t", "don't ", " ", "x" * 50, "'", "s "]
    return ["".join(r.choice(parts) for _ in range(r.choice([1, 5, 60, 400]))) for _ in range(n)]


@pytest.mark.parametrize("piece", [7, 64, 1 << 16])
def test_counts_are_the_librarys(spark, piece):
    library = Tokenizer.from_file(BYTES)
    rows = list(enumerate([*texts(piece), None, "", " ", "long text without end " * 20_000, "x" * 300_000, *["copy"] * 50]))
    rows.append((0, rows[0][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("n_tokens", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("row", F.lit(2))
    out = tokencounts.count_tokens(df, BYTES, piece=piece)
    assert out.columns == ["doc_id", "digest", "row", "n_bytes", "n_tokens"]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in out.collect())
    want = [(k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in rows]
    assert got == sorted(want)


def test_sentencepiece_and_no_rows(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = list(enumerate(texts(9)))
    out = tokencounts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out) == [(k, len(model.encode(t))) for k, t in rows]
    assert tokencounts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_only_distinct_misses_are_encoded(spark, few, monkeypatch):
    monkeypatch.setattr(tokencounts, "FEW_MISSES", few)
    cache = job_folder(spark, "counts")
    version = tokencounts.tokenizer_version(BYTES)
    store = tokencounts.CountCache(spark, cache, version)
    first = spark.createDataFrame([(k, f"text {k % 5}") for k in range(40)], "doc_id long, text string")
    before = tokencounts.count_tokens(first, BYTES, cache)
    assert store.stored().count() == 5 and spark.read.parquet(store.path).count() == 5
    assert before.count() == 40
    second = spark.createDataFrame([(k, f"text {k % 8}") for k in range(40)], "doc_id long, text string")
    assert tokencounts.count_tokens(second, BYTES, cache).where("n_tokens = 2").count() == 40
    assert spark.read.parquet(store.path).count() == 8  # three more, none twice
    other = tokencounts.count_tokens(second, public_tokenizers.path("word_bpe_49k.json"), cache)
    assert other.count() == 40 and spark.read.parquet(store.path).count() == 8
    # stored counts are taken as they are, a digest that was appended twice once
    forged = spark.read.parquet(store.path).withColumn("n_tokens", F.lit(99).cast("long"))
    again = job_folder(spark, "counts")
    for _ in range(2):
        tokencounts.CountCache(spark, again, version).append(forged)
    assert tokencounts.count_tokens(second, BYTES, again).where("n_tokens = 99").count() == 40
