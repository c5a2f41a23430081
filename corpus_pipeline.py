"""A corpus pipeline of four operators: language, near duplicates, benchmark passages, tokens.

Each stage takes the documents its predecessor kept and returns the columns of ``documents``;
the last returns tokens. Every stage's result is written before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilscope.llm import bpe, decontaminate, jaccard, langid
from perilscope.llm.queries import TOKENIZER, read
from perilscope.session import materialise

#: A document stays if its language is known with this share of its words at least.
LEAST_SCORE = 0.4
#: Near copies of the corpus; the registered join has a rule of its own.
NEAR = jaccard.Rule(width=5, part=4, whole=5)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language, learned from those that carry a label."""
    judged = langid.identify(docs, langid.train(docs))
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links at a Jaccard similarity of 0.8 over 5-word shingles."""
    return jaccard.one_of_each(docs, rule=NEAR).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 10-word window of a benchmark item."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text."""
    return bpe.encode_texts(
        docs.select("doc_id", "text"), TOKENIZER, add=("n_tokens", "ids_sha256", "decoded_sha256", "tokens"), keep_text=False
    )


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("tokens", tokens),
]

#: Fitted models and token ids cannot be written in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
