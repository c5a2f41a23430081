import glob
import json
import math
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perilscope.operators.aggregates import mean_and_std
from perilscope.operators.whatif import overwrite, stack_frames, variant_spread, whatif_spread, whatif_variants
from perilscope.plans.catalog import logistic_scorers
from perilscope.plans.streams import REQUEST_SCHEMA
from perilscope.session import job_folder, materialise, shared_folder
from perilscope.sources import files
from perilscope.sources.tables import POLICY_SCHEMA, policies
from perilscope.streaming import jobs


def test_declared_schema_is_the_tables(spark, sf_dir):
    df = policies(spark, sf_dir)
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in POLICY_SCHEMA]


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == shared_folder(spark)
    table = materialise(spark.range(5), "five")
    assert table.count() == 5
    assert table.inputFiles()[0].replace("file://", "").replace("file:", "").startswith(
        shared_folder(spark).replace("file:", "")
    )


def test_predictions_are_one_ordered_column_without_header(spark):
    path = job_folder(spark, "predictions").replace("file:", "")
    df = spark.range(1000).withColumn("prediction", F.col("id") / 2).repartition(7, F.rand(3))
    files.write_predictions(df, "prediction", path, "id")
    lines = []
    for part in sorted(glob.glob(os.path.join(path, "part-*"))):
        with open(part) as handle:
            lines += [float(line) for line in handle]
    assert lines == [i / 2 for i in range(1000)]


def test_csv_with_inferred_schema(spark):
    path = job_folder(spark, "csv")
    files.write_csv(spark.createDataFrame([(1, 0.5, "x")], "a int, b double, claim_amount string"), path)
    read = files.load_for_prediction(spark, path, schema=None)
    assert [tuple(r) for r in read.collect()] == [(1, 0.5)]


def test_requests_are_bounded_arrays_in_key_order(spark, sf_dir):
    df = policies(spark, sf_dir).select("id_policy", "vh_value", "vh_age")
    bodies = files.request_bodies(df, "id_policy", batch=64)
    for row in bodies.collect():
        records = [r["id_policy"] for r in json.loads(row["body"])]
        assert 0 < len(records) <= 64 and records == sorted(records)


def test_response_is_json_with_scores_in_order(spark):
    scored = spark.createDataFrame(
        [(1, 1, 0.5), (1, 0, 0.25), (2, 0, 1.0)], "request_id long, position int, score double"
    )
    got = {r["request_id"]: json.loads(r["response"]) for r in files.score_responses(scored).collect()}
    assert got == {1: {"score": [0.25, 0.5]}, 2: {"score": [1.0]}}


def test_whatif_keeps_the_row_and_both_forms_agree(fitted_policies):
    df, pipeline = fitted_policies
    scorer = logistic_scorers(pipeline)["net"]
    wide = whatif_spread(df, "drv_age1", 40, 60, scorer)
    assert wide.select(*df.columns).exceptAll(df).count() == 0
    long = variant_spread(whatif_variants(df, "drv_age1", [40, 60], scorer), "id_policy")
    both = wide.select("id_policy", "spread").join(
        long.withColumnRenamed("spread", "other"), "id_policy"
    )
    assert both.where("abs(spread - other) > 1e-12").count() == 0 < both.count()
    stacked = stack_frames(overwrite(df, "drv_age1", 40), overwrite(df, "drv_age1", 60))
    assert stacked.count() == 2 * df.count()
    assert mean_and_std(stacked, ["drv_age1"]).first()["mean"] == 50.0


def test_restarted_stream_scores_only_new_files(spark, fitted_policies):
    df, pipeline = fitted_policies
    scorers = logistic_scorers(pipeline)
    inbox, sink, progress = (job_folder(spark, n) for n in ("inbox", "sink", "progress"))
    rows = df.select(*REQUEST_SCHEMA.names)

    def run():
        stream = jobs.score_stream(jobs.request_stream(spark, inbox, REQUEST_SCHEMA), "id_policy", scorers)
        return jobs.run_to_folder(stream, sink, progress)

    rows.where("id_policy < 500").write.mode("append").json(inbox)
    assert run().count() == 500
    rows.where("id_policy >= 500").write.mode("append").json(inbox)
    streamed = run()
    assert streamed.count() == rows.count()
    batch = scorers["gbt"](scorers["net"](rows, "net_b"), "gbt_b")
    both = streamed.join(batch, "id_policy")
    assert both.where("abs(net - net_b) > 1e-12 or abs(gbt - gbt_b) > 1e-12").count() == 0


def test_late_records_are_left_out_of_closed_windows(spark, fitted_policies):
    df, pipeline = fitted_policies
    inbox, sink, progress = (job_folder(spark, n) for n in ("late", "late-sink", "late-progress"))
    one = df.where("id_policy = 0").select(*REQUEST_SCHEMA.names)

    def send(*times):
        stamps = F.explode(F.array(*[F.lit(t).cast("timestamp") for t in times]))
        one.withColumn("ts", stamps).write.mode("append").json(inbox)

    def run():
        schema = REQUEST_SCHEMA.jsonValue()
        stream = spark.readStream.schema(type(REQUEST_SCHEMA).fromJson(schema).add("ts", "timestamp")).json(inbox)
        monitored = jobs.spread_monitor(
            stream, "ts", "pol_coverage", "Min", "Max", logistic_scorers(pipeline)["net"]
        )
        return jobs.run_to_folder(monitored, sink, progress)

    send("2024-01-01 10:00:00", "2024-01-01 11:00:00", "2024-01-03 00:00:00")
    assert [r["n"] for r in run().collect()] == [2]
    send("2024-01-01 12:00:00", "2024-01-05 00:00:00")
    assert sorted(r["n"] for r in run().collect()) == [1, 2]


# --- CSV by name ------------------------------------------------------------------

PAIR = "id_policy long, vh_value double"


def _schema(spark, text):
    return spark.createDataFrame([], text).schema


def write_lines(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as handle:
        handle.write("\n".join(lines) + "\n")


def test_csv_columns_are_found_by_name(spark, tmp_path):
    write_lines(tmp_path / "a", "1.csv", "vh_value,extra,id_policy,claim_amount", "7.0,x,3,0", ",y,4,1")
    schema = _schema(spark, PAIR)
    rows = files.load_data(spark, str(tmp_path / "a"), schema).orderBy("id_policy").collect()
    assert [tuple(r) for r in rows] == [(3, 7.0), (4, None)]
    assert files.load_for_prediction(spark, str(tmp_path / "a"), _schema(spark, PAIR + ", claim_amount double")).columns == [
        "id_policy", "vh_value",
    ]


def test_csv_errors_are_not_silent(spark, tmp_path):
    schema = _schema(spark, PAIR)
    write_lines(tmp_path / "missing", "1.csv", "vh_value", "7.0")
    with pytest.raises(ValueError, match="id_policy"):
        files.load_data(spark, str(tmp_path / "missing"), schema)
    write_lines(tmp_path / "cell", "1.csv", "id_policy,vh_value", "3,many")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|many"):
        files.load_data(spark, str(tmp_path / "cell"), schema).collect()
    write_lines(tmp_path / "two", "1.csv", "id_policy,vh_value", "3,1.0")
    write_lines(tmp_path / "two", "2.csv", "vh_value,id_policy", "1.0,3")
    with pytest.raises(Exception):
        files.load_data(spark, str(tmp_path / "two"), schema).collect()


# --- broken requests ----------------------------------------------------------------

def test_every_request_has_a_reply(spark):
    schema = _schema(spark, PAIR)
    good = '[{"id_policy": 1, "vh_value": 2.0}, {"id_policy": 2}]'
    bodies = [(1, good), (2, "[]"), (3, good[:-5]), (4, "nonsense"), (5, None), (6, '{"id_policy": 9}')]
    requests = spark.createDataFrame(bodies, "request_id long, body string")
    replies = files.all_responses(requests, schema, lambda df, name: df.withColumn(name, F.coalesce("vh_value", F.lit(0.5))))
    got = {r["request_id"]: (r["status"], json.loads(r["response"])) for r in replies.collect()}
    assert got[1] == ("ok", {"score": [2.0, 0.5]}) and got[2] == ("empty", {"score": []})
    assert all(got[k][0] == "bad" and "error" in got[k][1] for k in (3, 4, 5))
    assert len(got) == 6


def test_broken_lines_are_kept_apart_and_never_scored(spark, tmp_path):
    schema = _schema(spark, PAIR)
    inbox, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    write_lines(inbox, "a.json", '{"id_policy": 1, "vh_value": 2.0}', '{"id_policy": 2, "vh_v', "{}")
    scorer = lambda df, name: df.withColumn(name, F.coalesce("vh_value", F.lit(0.5)))
    stream = jobs.score_stream(jobs.request_stream(spark, inbox, schema), "id_policy", {"s": scorer})
    assert [tuple(r) for r in jobs.run_to_folder(stream, sink, progress).collect()] == [(1, 2.0)]
    bad = jobs.run_to_folder(jobs.bad_lines(spark, inbox, schema), sink + "-bad", progress + "-bad")
    assert [r["line"] for r in bad.collect()] == ['{"id_policy": 2, "vh_v']


def test_replies_of_a_stream_are_written_once(spark, tmp_path):
    schema = _schema(spark, PAIR)
    inbox, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    scorer = lambda df, name: df.withColumn(name, F.col("vh_value") * 2)

    def run():
        return jobs.respond(spark, inbox, schema, {"net": scorer, "gbt": scorer}, sink, progress, files_a_batch=1)

    body = json.dumps([{"id_policy": 1, "vh_value": 2.0}, {"id_policy": 2, "vh_value": 1.0}])
    write_lines(inbox, "a.json", json.dumps({"request_id": 7, "body": body}))
    write_lines(inbox, "b.json", json.dumps({"request_id": 8, "body": "[]"}), "cut off {")
    first = run().collect()
    assert sorted((r["request_id"], r["model"], r["status"], r["response"]) for r in first) == [
        (7, "gbt", "ok", '{"score":[4.0,2.0]}'), (7, "net", "ok", '{"score":[4.0,2.0]}'),
        (8, "gbt", "empty", '{"score":[]}'), (8, "net", "empty", '{"score":[]}'),
    ]
    write_lines(inbox, "c.json", json.dumps({"request_id": 9, "body": "?"}))
    assert run().count() == 6


def test_all_windows_are_complete(spark, fitted_policies, tmp_path):
    df, pipeline = fitted_policies
    inbox, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    one = df.where("id_policy = 0").select(*REQUEST_SCHEMA.names)

    def run(*times):
        stamps = F.explode(F.array(*[F.lit(t).cast("timestamp") for t in times]))
        one.withColumn("ts", stamps).write.mode("append").json(inbox)
        schema = type(REQUEST_SCHEMA).fromJson(REQUEST_SCHEMA.jsonValue()).add("ts", "timestamp")
        stream = spark.readStream.schema(schema).json(inbox)
        out = jobs.spread_windows(
            stream, "ts", "pol_coverage", "Min", "Max", logistic_scorers(pipeline)["net"], sink, progress
        )
        return [r["n"] for r in out.orderBy("window_start").collect()]

    assert run("2024-01-01 10:00:00", "2024-01-01 11:00:00", "2024-01-03 00:00:00") == [2, 1]
    assert run("2024-01-01 12:00:00", "2024-01-05 00:00:00") == [3, 1, 1]


def test_every_request_row_has_its_own_reply(spark):
    schema = T.StructType([T.StructField("x", T.DoubleType())])
    rows = [
        (1, '[{"x":1.0}]'), (1, '[{"x":2.0},{"x":3.0}]'), (None, '[{"x":4.0}]'), (None, "none"),
        (2, "[]"), (2, "[]"), (3, '[{"x":5.0}]'), (3, '[{"x":5.0}]'), (4, None),
    ]
    requests = spark.createDataFrame(rows, "request_id long, body string").repartition(3)
    replies = files.all_responses(requests, schema, lambda df, name: df.withColumn(name, F.col("x")))
    assert replies.columns == ["request_id", "status", "response"]
    got = sorted((str(r["request_id"]), r["status"], r["response"]) for r in replies.collect())
    bad = '{"error":"not an array of records"}'
    assert got == sorted([
        ("1", "ok", '{"score":[1.0]}'), ("1", "ok", '{"score":[2.0,3.0]}'), ("None", "ok", '{"score":[4.0]}'),
        ("None", "bad", bad), ("2", "empty", '{"score":[]}'), ("2", "empty", '{"score":[]}'),
        ("3", "ok", '{"score":[5.0]}'), ("3", "ok", '{"score":[5.0]}'), ("4", "bad", bad),
    ])


def test_a_stream_without_a_batch_has_an_empty_result(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    stream = jobs.request_stream(spark, str(inbox), jobs.BODY_SCHEMA)
    out = jobs.run_batches(stream, str(tmp_path / "out"), str(tmp_path / "mark"), lambda batch: batch.withColumn("n", F.lit(1)))
    assert out.columns == ["request_id", "body", "n"] and out.count() == 0


def window_rows(spark, inbox, path, progress, files_a_batch=1, **options):
    schema = "ts timestamp, v double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(inbox)
    out = jobs.window_figures(stream, "ts", "v", path, progress, grid=[0.0, 0.5], bandwidth=0.5, **options)
    return {str(r["window_start"])[:10]: (r["n"], r["mean"], r["density"]) for r in out.collect()}


def test_window_state_survives_a_stop_a_failure_and_late_records(spark, monkeypatch):
    import datetime

    inbox, path, progress = (job_folder(spark, n) for n in ("inbox", "windows", "progress"))
    rows = [(datetime.datetime(2024, 1, 1 + k % 3, k % 24), None if k % 10 == 9 else k / 40) for k in range(40)]
    rows += [(None, 1.0), (datetime.datetime(2024, 2, 1), None)]

    def arrive(some):
        spark.createDataFrame(some, "ts timestamp, v double").coalesce(1).write.mode("append").json(inbox)

    arrive(rows[:10])
    assert window_rows(spark, inbox, path, progress)["2024-01-01"][0] == 4
    arrive(rows[10:25])
    # the second batch fails after it wrote
    write = type(spark.range(1).write).parquet
    def broken(self, path, *a, **k):
        write(self, path, *a, **k)
        if path.endswith("batch=1"):
            raise RuntimeError("lost")
    monkeypatch.setattr(type(spark.range(1).write), "parquet", broken)
    with pytest.raises(Exception, match="lost"):
        window_rows(spark, inbox, path, progress)
    monkeypatch.undo()
    arrive(rows[25:])
    out = window_rows(spark, inbox, path, progress)
    assert set(out) == {"2024-01-01", "2024-01-02", "2024-01-03", "2024-02-01"}
    assert out["2024-02-01"] == (1, None, None)
    for day in (1, 2, 3):
        own = [v for t, v in rows if t and t.month == 1 and t.day == day]
        known = [v for v in own if v is not None]
        n, mean, density = out[f"2024-01-0{day}"]
        assert n == len(own) and mean == pytest.approx(sum(known) / len(known))
        for g, d in zip((0.0, 0.5), density):
            want = sum(math.exp(-0.5 * ((g - v) / 0.5) ** 2) for v in known) / (len(known) * 0.5 * math.sqrt(2 * math.pi))
            assert d == pytest.approx(want)
    assert window_rows(spark, inbox, path, progress) == out  # nothing new


def test_window_state_of_an_empty_folder(spark):
    import os

    inbox = job_folder(spark, "inbox")
    os.makedirs(inbox.removeprefix("file:"))
    assert window_rows(spark, inbox, job_folder(spark, "windows"), job_folder(spark, "progress")) == {}
