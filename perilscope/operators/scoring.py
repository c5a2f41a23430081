"""Scorers: callables that add one score column and leave the others as they are."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perilscope.functions import expressions as X
from perilscope.operators.features import FeaturePipeline

Scorer = Callable[[DataFrame, str], DataFrame]

_RAW = "_raw"


def _beside(df: DataFrame, run: Callable[[DataFrame], DataFrame], score: Column, output: str):
    """Run a transformation that may overwrite columns, keep only its score.

    The originals travel in a struct that Catalyst takes apart again, so this
    costs neither a join nor a second scan.
    """
    names = [name for name in df.columns if name != output]
    scored = run(df.withColumn(_RAW, F.struct(*names)))
    return scored.select(*[F.col(_RAW)[n].alias(n) for n in names], score.alias(output))


@dataclass
class LogisticScorer:
    """Sigmoid of a weighted sum of prepared features."""

    pipeline: FeaturePipeline
    weights: Mapping[str, float]
    intercept: float = 0.0

    def logit(self, df: DataFrame, output: str = "logit") -> DataFrame:
        return _beside(
            df, self.pipeline.transform, X.linear_score(self.weights, self.intercept), output
        )

    def __call__(self, df: DataFrame, output: str = "score") -> DataFrame:
        return self.logit(df, output).withColumn(output, X.sigmoid(F.col(output)))


@dataclass
class ModelScorer:
    """Probability of the event under a fitted Spark ML classifier."""

    pipeline: FeaturePipeline
    model: PipelineModel

    def __call__(self, df: DataFrame, output: str = "score") -> DataFrame:
        return _beside(
            df,
            lambda raw: self.model.transform(self.pipeline.transform(raw)),
            vector_to_array("probability")[1],
            output,
        )


@dataclass
class PandasScorer:
    """A model from outside Spark, called on Arrow batches.

    Rows are independent, so batches of any partitioning give the same scores.
    """

    predict: Callable[[pd.DataFrame], pd.Series]

    def __call__(self, df: DataFrame, output: str = "score") -> DataFrame:
        predict = self.predict

        def run(batches):
            for batch in batches:
                yield batch.assign(**{output: predict(batch)})

        schema = T.StructType([*df.drop(output).schema.fields, T.StructField(output, T.DoubleType())])
        return df.drop(output).mapInPandas(run, schema)


def with_scores(df: DataFrame, scorers: Mapping[str, Scorer]) -> DataFrame:
    """One column per named scorer, all from the same scan."""
    for name, scorer in scorers.items():
        df = scorer(df, name)
    return df


def score_difference(df: DataFrame, scorers: Mapping[str, Scorer], minus: str, plus: str) -> DataFrame:
    """Two models on the same rows and how far they are apart."""
    return with_scores(df, {n: scorers[n] for n in (minus, plus)}).withColumn(
        "spread", F.col(plus) - F.col(minus)
    )


def with_user_column(
    df: DataFrame, inputs: list[str], function: Callable[..., Column], output: str
) -> DataFrame:
    """Add ``output = function(*inputs)``; pass a Column function or a pandas UDF."""
    return df.withColumn(output, function(*[F.col(name) for name in inputs]))
