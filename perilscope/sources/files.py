"""CSV, JSON and saved-model input and output."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perilscope.operators.boosting import BoostedTrees, TreeScorer
from perilscope.operators.nets import Net, NetScorer
from perilscope.operators.features import FeaturePipeline
from perilscope.operators.models import FrequencySeverity
from perilscope.operators.perceptrons import classifier_scorer
from perilscope.operators.scoring import ModelScorer, Scorer, with_scores
from perilscope.session import path_exists
from perilscope.sources.tables import POLICY_SCHEMA


def load_data(
    spark: SparkSession, path: str, schema: T.StructType | None = POLICY_SCHEMA
) -> DataFrame:
    """CSV files with a header; columns are found by their names there, in any order.

    A missing column, a file whose header differs from the first one's, a row of another
    length and a cell that does not fit its column's type are errors. Columns outside the
    schema are left out. Without a schema Spark infers one, at the cost of a scan.
    """
    if schema is None:
        return spark.read.csv(path, header=True, inferSchema=True)
    header = spark.read.csv(path, header=True).schema
    missing = [f.name for f in schema if f.name not in header.names]
    if missing:
        raise ValueError(f"columns missing in {path}: {missing}")
    text = (
        spark.read.schema(header).option("header", True).option("enforceSchema", False)
        .option("mode", "FAILFAST").csv(path)
    )
    return text.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def load_for_prediction(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = POLICY_SCHEMA,
    target: str = "claim_amount",
) -> DataFrame:
    """The same without the target column, which need not be there."""
    if schema is not None:
        schema = T.StructType([f for f in schema if f.name != target])
    return load_data(spark, path, schema).drop(target)


def write_csv(df: DataFrame, path: str) -> None:
    """Comma-separated part files, each with a header (sweep results, tables)."""
    df.write.mode("overwrite").csv(path, header=True)


def write_predictions(df: DataFrame, column: str, path: str, order_by: str) -> None:
    """One prediction per line, no header, in ``order_by`` order.

    Rows are range-partitioned by the sort, so the part files read in name order
    give the whole column in key order without passing through one task.
    """
    df.orderBy(order_by).select(column).write.mode("overwrite").csv(path, header=False)


def write_keyed_predictions(df: DataFrame, key: str, column: str, path: str) -> None:
    """Key and prediction, no header; needs no sort."""
    df.select(key, column).write.mode("overwrite").csv(path, header=False)


# --- JSON requests ----------------------------------------------------------

def request_bodies(df: DataFrame, key: str, batch: int = 100) -> DataFrame:
    """Scoring requests: JSON arrays of up to ``batch`` records each.

    ``key`` must be a unique integer; a request covers one key range of width
    ``batch``, so its array cannot grow past ``batch`` records.
    """
    record = F.struct(F.col(key), *[F.col(c) for c in df.columns if c != key])
    return (
        df.groupBy(F.floor(F.col(key) / batch).cast("bigint").alias("request_id"))
        .agg(F.sort_array(F.collect_list(record)).alias("records"))
        .select("request_id", F.to_json("records").alias("body"))
    )


def parse_requests(requests: DataFrame, schema: T.StructType, body: str = "body") -> DataFrame:
    """One row per record of a JSON array body, with its position in the request.

    Bodies that are no array of records, and empty ones, have no rows here; see ``request_status``.
    """
    records = F.from_json(F.col(body), T.ArrayType(schema))
    others = [c for c in requests.columns if c != body]
    return requests.select(*others, F.posexplode(records).alias("position", "record")).select(
        *others, "position", "record.*"
    )


def request_status(requests: DataFrame, schema: T.StructType, body: str = "body") -> DataFrame:
    """Requests with ``status``: ``ok``, ``empty`` (no records) or ``bad`` (no array of records)."""
    records = F.from_json(F.col(body), T.ArrayType(schema))
    status = F.when(records.isNull(), "bad").when(F.size(records) == 0, "empty").otherwise("ok")
    return requests.withColumn("status", status)


def score_responses(scored: DataFrame, request: str = "request_id", score: str = "score") -> DataFrame:
    """``{"score": [...]}`` per request, scores in record order.

    A request is one line of its source, so its records come from one row.
    """
    pairs = F.sort_array(F.collect_list(F.struct("position", score)))
    scores: Column = F.transform(pairs, lambda pair: pair[score])
    return scored.groupBy(request).agg(F.to_json(F.struct(scores.alias("score"))).alias("response"))


def all_responses(
    requests: DataFrame, schema: T.StructType, scorer, request: str = "request_id", body: str = "body"
) -> DataFrame:
    """One row per request row: ``request``, ``status`` and ``response``; see ``model_responses``."""
    return model_responses(requests, schema, {"": scorer}, request, body).drop("model")


def model_responses(
    requests: DataFrame, schema: T.StructType, scorers: Mapping[str, Scorer], request: str = "request_id", body: str = "body"
) -> DataFrame:
    """One row per request row and model: ``request``, ``model``, ``status`` and ``response``.

    Every row is answered by itself, whatever its id: repeated and null ids have a reply each. An empty
    request has an empty list of scores, a bad one an error; nothing of it is scored. Bodies are taken apart once for all
    models, and only numbers are shuffled: rows are told apart by their place in the scan, so requests should come from files.
    """
    outputs = {name: f"_score_{k}" for k, name in enumerate(scorers)}
    placed = requests.select(F.monotonically_increasing_id().alias("_request"), F.col(request).alias("_id"), F.col(body).alias("_body"))
    records = with_scores(parse_requests(placed, schema, "_body"), {outputs[name]: scorer for name, scorer in scorers.items()})
    listed = F.sort_array(F.collect_list(F.struct("position", *outputs.values())))
    pairs = records.groupBy("_request", "_id").agg(listed.alias("_pairs"))

    def scores(output: str) -> Column:
        return F.to_json(F.struct(F.transform("_pairs", lambda pair: pair[output]).alias("score")))

    def replies(rows: DataFrame, status: Column, response: Callable[[str], Column]) -> DataFrame:
        cells = [F.struct(F.lit(name).alias("model"), status.alias("status"), response(output).alias("response")) for name, output in outputs.items()]
        return rows.select(F.col("_id").alias(request), F.inline(F.array(*cells)))

    others = request_status(requests.select(F.col(request).alias("_id"), F.col(body).alias("_body")), schema, "_body").where("status <> 'ok'")
    said = F.when(F.col("status") == "empty", F.lit('{"score":[]}')).otherwise(F.lit('{"error":"not an array of records"}'))
    return replies(pairs, F.lit("ok"), scores).unionByName(replies(others, F.col("status"), lambda _: said))


# --- saved models -----------------------------------------------------------

def save_scorer(scorer: ModelScorer | TreeScorer | NetScorer, spark: SparkSession, path: str) -> None:
    """Preprocessing parameters and model, side by side."""
    scorer.pipeline.save(spark, f"{path}/preprocessing")
    if isinstance(scorer, TreeScorer):
        scorer.model.save(spark, f"{path}/trees")
    elif isinstance(scorer, NetScorer):
        scorer.net.save(spark, f"{path}/net")
    else:
        scorer.model.write().overwrite().save(f"{path}/model")


def load_scorer(spark: SparkSession, path: str) -> ModelScorer | TreeScorer | NetScorer:
    pipeline = FeaturePipeline.load(spark, f"{path}/preprocessing")
    if path_exists(spark, f"{path}/trees"):
        return TreeScorer(pipeline, BoostedTrees.load(spark, f"{path}/trees"))
    if path_exists(spark, f"{path}/net"):
        return NetScorer(pipeline, Net.load(spark, f"{path}/net"))
    return classifier_scorer(pipeline, PipelineModel.load(f"{path}/model"))


@dataclass
class BatchScoring:
    """A scoring job from a dataset path to an output path."""

    scorer: object
    schema: T.StructType = POLICY_SCHEMA
    key: str = "id_policy"
    target: str = "claim_amount"

    def run(self, spark: SparkSession, source: str, destination: str) -> None:
        rows = load_for_prediction(spark, source, self.schema, self.target)
        write_keyed_predictions(self.scorer(rows, "prediction"), self.key, "prediction", destination)


def predict_batch(
    spark: SparkSession, source: str, model: str, destination: str, output: str = "claims",
    schema: T.StructType = POLICY_SCHEMA, key: str = "id_policy",
) -> None:
    """Expected claims or prices of a dataset, by a saved frequency-severity model: one value per
    line without header, in key order. The target is left out where it is present."""
    if output not in ("claims", "prices"):
        raise ValueError("output is claims or prices")
    rows = load_for_prediction(spark, source, schema)
    scored = FrequencySeverity.load(spark, model).premium(rows, key)
    write_predictions(scored, {"claims": "expected_claim", "prices": "premium"}[output], destination, key)
