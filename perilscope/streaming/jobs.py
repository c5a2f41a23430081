"""Request scoring and spread monitoring as Structured Streaming jobs."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perilscope.operators.scoring import Scorer
from perilscope.operators.whatif import whatif_spread
from perilscope.session import path_exists
from perilscope.sources.files import model_responses, parse_requests


BAD_LINE = "_bad_line"


def _parsed_lines(spark: SparkSession, path: str, schema: T.StructType, files_a_batch: int | None) -> DataFrame:
    """Every line as text and as a record; ``BAD_LINE`` holds a line that is no record."""
    reader = spark.readStream
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    marked = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])
    record = F.from_json("value", marked, {"columnNameOfCorruptRecord": BAD_LINE})
    return reader.text(path).select("value", record.alias("record"))


def request_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_a_batch: int | None = None
) -> DataFrame:
    """Records of JSON-lines files as they arrive in a folder. Lines that are no record are left to
    ``bad_lines``; they are never scored."""
    lines = _parsed_lines(spark, path, schema, files_a_batch)
    return lines.where(F.col(f"record.{BAD_LINE}").isNull()).select(*[F.col(f"record.`{f.name}`") for f in schema])


def bad_lines(
    spark: SparkSession, path: str, schema: T.StructType, files_a_batch: int | None = None
) -> DataFrame:
    """The lines of the same files that are no record, as text."""
    lines = _parsed_lines(spark, path, schema, files_a_batch)
    return lines.where(F.col(f"record.{BAD_LINE}").isNotNull()).select(F.col("value").alias("line"))


BODY_SCHEMA = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("body", T.StringType())])


def body_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_a_batch: int | None = None
) -> DataFrame:
    """Records of request bodies: lines with ``request_id`` and a JSON array ``body``."""
    return parse_requests(request_stream(spark, path, BODY_SCHEMA, files_a_batch), schema)


def run_batches(stream: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Write ``work`` of every micro-batch to a folder of its own, then read all of them.

    A batch that is run again after a failure replaces its folder, so every row is there once.
    Without any batch the result is ``work`` of no rows.
    """
    spark = stream.sparkSession
    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    none = work(spark.createDataFrame([], stream.schema))
    if not path_exists(spark, path):
        return none
    return spark.read.schema(none.schema).parquet(path)


def respond(
    spark: SparkSession, inbox: str, schema: T.StructType, scorers: dict[str, Scorer], path: str, checkpoint: str,
    files_a_batch: int | None = None,
) -> DataFrame:
    """A reply of every model to every request: ``request_id``, ``model``, ``status``, ``response``.

    A request is one line, so its records are in one micro-batch.
    """
    def replies(batch: DataFrame) -> DataFrame:
        return model_responses(batch, schema, scorers).select("request_id", "model", "status", "response")

    return run_batches(request_stream(spark, inbox, BODY_SCHEMA, files_a_batch), path, checkpoint, replies)


def run_to_folder(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything available, then read the sink back.

    The file sink and the checkpoint make a restarted run continue where the
    last one stopped, writing every row once.
    """
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def score_stream(stream: DataFrame, key: str, scorers: dict[str, Scorer]) -> DataFrame:
    """Scores of every arriving record with its request and position, where it has them; a projection, so
    no state is kept. Records without a key have no score."""
    kept = [c for c in ("request_id", "position") if c in stream.columns and c != key]
    stream = stream.where(F.col(key).isNotNull())
    for name, scorer in scorers.items():
        stream = scorer(stream, name)
    return stream.select(key, *kept, *scorers)


def spread_monitor(
    stream: DataFrame,
    event_time: str,
    column: str,
    value_a: object,
    value_b: object,
    scorer: Scorer,
    window: str = "1 day",
    delay: str = "1 hour",
) -> DataFrame:
    """Mean what-if spread and record count per time window.

    The watermark is set after scoring, which rebuilds the columns. State is one
    partial average per open window.
    """
    spreads = whatif_spread(stream, column, value_a, value_b, scorer).select(event_time, "spread")
    return (
        spreads.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, window))
        .agg(F.avg("spread").alias("mean_spread"), F.count(F.lit(1)).alias("n"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "mean_spread",
            "n",
        )
    )


def spread_windows(
    stream: DataFrame, event_time: str, column: str, value_a: object, value_b: object, scorer: Scorer,
    path: str, checkpoint: str, window: str = "1 day",
) -> DataFrame:
    """The same figures of every window, the last one and late records included.

    A micro-batch writes one sum and count per window; they are added up on reading.
    """
    def sums(batch: DataFrame) -> DataFrame:
        spreads = whatif_spread(batch, column, value_a, value_b, scorer).select(event_time, "spread")
        return (
            spreads.groupBy(F.window(event_time, window))
            .agg(F.sum("spread").alias("total"), F.count("spread").alias("scored"), F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "total", "scored", "n")
        )

    return (
        run_batches(stream, path, checkpoint, sums).groupBy("window_start", "window_end")
        .agg((F.sum("total") / F.sum("scored")).alias("mean_spread"), F.sum("n").alias("n"))
    )


def window_figures(
    stream: DataFrame, event_time: str, value: str, path: str, checkpoint: str, window: str = "1 day",
    grid: Sequence[float] = (), bandwidth: float = 0.01, delay: str | None = None,
) -> DataFrame:
    """Count, mean and Gaussian kernel density of ``value`` per time window, kept as state.

    The state of a window is its counts, a sum, and one sum of kernels per grid point, so it does not grow with the records.
    Every micro-batch writes the windows it changed, under its own number; a batch that is run again
    replaces what it wrote, and the newest row of a window counts. A job that was stopped goes on from
    its checkpoint. Late records change their window however late they are; with ``delay`` the state of a
    window is dropped when the watermark has passed it, and records that come after that are not counted.

    ``window_start``, ``window_end``, ``n``, ``mean`` and ``density`` (one number per grid point) of all windows so far. Records
    without a time are in no window; those without a value count in ``n`` only; a window without values has nulls.
    """
    spark = stream.sparkSession
    if delay:
        stream = stream.withWatermark(event_time, delay)
    kernels = [F.sum(F.exp(-0.5 * F.pow((F.lit(float(g)) - F.col(value)) / F.lit(bandwidth), 2))).alias(f"k{i}") for i, g in enumerate(grid)]
    state = stream.groupBy(F.window(event_time, window)).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("known"), F.sum(F.col(value).cast("double")).alias("total"), *kernels
    )
    rows = state.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *state.columns[1:])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())])
    written = spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)
    newest = written.groupBy("window_start", "window_end").agg(
        F.max_by(F.struct("n", "known", "total", *[f"k{i}" for i in range(len(grid))]), "batch").alias("s")
    )
    density = [F.col(f"s.k{i}") / (F.col("s.known") * F.lit(bandwidth * math.sqrt(2 * math.pi))) for i in range(len(grid))]
    empty = F.col("s.known") == 0
    return newest.select(
        "window_start", "window_end", F.col("s.n").alias("n"), F.when(~empty, F.col("s.total") / F.col("s.known")).alias("mean"),
        F.when(~empty, F.array(*density).cast("array<double>")).alias("density"),
    )
