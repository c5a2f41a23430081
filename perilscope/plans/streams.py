"""Queries that run Structured Streaming jobs over everything available."""

from __future__ import annotations

from pyspark.sql import functions as F

from perilscope.operators.whatif import whatif_spread
from perilscope.plans.catalog import (
    SCORED, fitted, logistic_scorers, query, rounded, with_policies,
)
from perilscope.plans.scores import AGE_SQL
from perilscope.session import job_folder, materialise
from perilscope.sources.files import request_bodies
from perilscope.sources.tables import POLICY_SCHEMA, table
from perilscope.streaming import jobs

REQUEST_SCHEMA = type(POLICY_SCHEMA)([f for f in POLICY_SCHEMA.fields if f.name != "claim_amount"])
PAIRED = "\nselect id_policy, round(net, 6) as net, round(gbt, 6) as gbt from scored"


@query("stream_score", with_policies(SCORED + PAIRED))
def stream_score(spark, sf_dir):
    df, pipeline = fitted(spark, sf_dir)
    inbox = job_folder(spark, "requests")
    df.select(*REQUEST_SCHEMA.names).write.json(inbox)
    stream = jobs.request_stream(spark, inbox, REQUEST_SCHEMA)
    scored = jobs.score_stream(stream, "id_policy", logistic_scorers(pipeline))
    out = jobs.run_to_folder(scored, job_folder(spark, "scores"), job_folder(spark, "progress"))
    return rounded(out, "net", "gbt")


@query("stream_score_bodies", with_policies(SCORED + PAIRED))
def stream_score_bodies(spark, sf_dir):
    df, pipeline = fitted(spark, sf_dir)
    inbox = job_folder(spark, "bodies")
    request_bodies(df.select(*REQUEST_SCHEMA.names), "id_policy").write.json(inbox)
    stream = jobs.body_stream(spark, inbox, REQUEST_SCHEMA)
    scored = jobs.score_stream(stream, "id_policy", logistic_scorers(pipeline))
    out = jobs.run_to_folder(scored, job_folder(spark, "scores"), job_folder(spark, "progress"))
    return rounded(out.select("id_policy", "net", "gbt"), "net", "gbt")


@query("stream_responses", with_policies(SCORED + """
select cast(floor(id_policy / 100) as bigint) as request_id, 'net' as model, 'ok' as status,
  cast(row_number() over (partition by floor(id_policy / 100) order by id_policy) - 1 as int) as position, round(net, 6) as score from scored
union all
select cast(floor(id_policy / 100) as bigint), 'gbt', 'ok',
  cast(row_number() over (partition by floor(id_policy / 100) order by id_policy) - 1 as int), round(gbt, 6) from scored
union all select -1, m, 'empty', null, null from (values ('net'), ('gbt')) t(m)
union all select -2, m, 'bad', null, null from (values ('net'), ('gbt')) t(m)"""))
def stream_responses(spark, sf_dir):
    """Replies of both models to requests as they arrive; an empty and a bad request among them."""
    df, pipeline = fitted(spark, sf_dir)
    inbox = job_folder(spark, "bodies")
    odd = spark.createDataFrame([(-1, "[]"), (-2, "[{")], "request_id long, body string")
    request_bodies(df.select(*REQUEST_SCHEMA.names), "id_policy").unionByName(odd).write.json(inbox)
    replies = jobs.respond(
        spark, inbox, REQUEST_SCHEMA, logistic_scorers(pipeline), job_folder(spark, "replies"), job_folder(spark, "progress"),
        files_a_batch=4,
    )
    scores = F.from_json("response", "score array<double>")["score"]
    listed = replies.select("request_id", "model", "status", F.posexplode_outer(scores).alias("position", "score"))
    return rounded(listed, "score")


@query("stream_spread_monitor", with_policies(AGE_SQL + """
select strftime(date_trunc('day', e.ts), '%Y-%m-%d') as day, round(avg(spread), 6) as mean_spread, cast(count(*) as bigint) as n
from events e join spreads s on e.event_id = s.id_policy group by 1"""))
def stream_spread_monitor(spark, sf_dir):
    """Every event asks for its policy's spread; all days. The policies are written once, not joined anew in every batch."""
    df, pipeline = fitted(spark, sf_dir)
    df = materialise(df.select(*REQUEST_SCHEMA.names), "policies")
    schema = table(spark, sf_dir, "events").schema
    events = (
        spark.readStream.schema(schema)
        .parquet(f"{sf_dir}/events*.parquet")
        .select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    )
    requests = events.join(df, events.event_id == df.id_policy)
    out = jobs.spread_windows(
        requests, "ts", "drv_age1", 40, 60, logistic_scorers(pipeline)["net"],
        job_folder(spark, "spreads"), job_folder(spark, "progress"),
    )
    return rounded(
        out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "mean_spread", "n"),
        "mean_spread",
    )


SPREAD_GRID = [round(-0.2 + 0.02 * i, 2) for i in range(21)]
SPREAD_WIDTH = 0.01


def _window_figures(spark, sf_dir):
    """The events arrive in two parts; the job stops between them and goes on from its checkpoint. The second part holds
    earlier times too, so every window changes late."""
    df, pipeline = fitted(spark, sf_dir)
    df = materialise(df.select(*REQUEST_SCHEMA.names), "policies")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    inbox, path, progress = (job_folder(spark, name) for name in ("events", "windows", "progress"))
    for part in (0, 1):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part).write.mode("append").parquet(inbox)
        arrived = spark.readStream.schema(events.schema).parquet(inbox)
        requests = arrived.join(df, arrived.event_id == df.id_policy)
        spreads = whatif_spread(requests, "drv_age1", 40, 60, logistic_scorers(pipeline)["net"]).select("ts", "spread")
        out = jobs.window_figures(spreads, "ts", "spread", path, progress, grid=SPREAD_GRID, bandwidth=SPREAD_WIDTH)
    return out.withColumn("day", F.date_format("window_start", "yyyy-MM-dd"))


@query("stream_window_state", with_policies(AGE_SQL + """
select strftime(date_trunc('day', e.ts), '%Y-%m-%d') as day, round(avg(spread), 6) as mean_spread, cast(count(*) as bigint) as n
from events e join spreads s on e.event_id = s.id_policy group by 1"""))
def stream_window_state(spark, sf_dir):
    return rounded(_window_figures(spark, sf_dir).select("day", F.col("mean").alias("mean_spread"), "n"), "mean_spread")


@query("stream_window_density", with_policies(AGE_SQL + f"""
select strftime(date_trunc('day', e.ts), '%Y-%m-%d') as day, x,
  round(sum(exp(-0.5 * power((x - spread) / {SPREAD_WIDTH}, 2))) / (count(*) * {SPREAD_WIDTH} * sqrt(2 * pi())), 6) as density
from events e join spreads s on e.event_id = s.id_policy
cross join (select cast(unnest([{", ".join(map(str, SPREAD_GRID))}]) as double) as x) group by 1, 2"""))
def stream_window_density(spark, sf_dir):
    """Distribution of the spread in every time window."""
    points = F.arrays_zip(F.array(*map(F.lit, SPREAD_GRID)).alias("x"), F.col("density").alias("density"))
    return rounded(_window_figures(spark, sf_dir).select("day", F.inline(points)).toDF("day", "x", "density"), "density")
