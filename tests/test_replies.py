import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from perilscope.sources import files

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("x", T.DoubleType())])


def scorers():
    return {"up": lambda df, name: df.withColumn(name, F.col("x") + 1), "down": lambda df, name: df.withColumn(name, F.col("x") - 1)}


def test_all_models_answer_every_row_by_itself(spark):
    body = json.dumps([{"k": 1, "x": 2.0}, {"k": 2}, {"k": 3, "x": 4.0}])
    rows = [(1, body), (1, body), (None, body), (2, "[]"), (2, "[]"), (3, "[{"), (None, None)]
    requests = spark.createDataFrame(rows, "request_id long, body string").repartition(3)
    found = files.model_responses(requests, SCHEMA, scorers())
    assert found.columns == ["request_id", "model", "status", "response"]
    said = sorted((str(r["request_id"]), r["model"], r["status"], r["response"]) for r in found.collect())
    want = []
    for model, scores in (("up", "[3.0,null,5.0]"), ("down", "[1.0,null,3.0]")):
        want += [(i, model, "ok", f'{{"score":{scores}}}') for i in ("1", "1", "None")]
        want += [("2", model, "empty", '{"score":[]}')] * 2
        want += [(i, model, "bad", '{"error":"not an array of records"}') for i in ("3", "None")]
    assert said == sorted(want)
    assert files.model_responses(requests.limit(0), SCHEMA, scorers()).count() == 0


def test_bodies_are_taken_apart_once_for_all_models(spark):
    requests = spark.range(10).select(F.col("id").alias("request_id"), F.format_string('[{"k": %d, "x": 1}]', "id").alias("body"))
    plan = files.model_responses(requests, SCHEMA, scorers())._jdf.queryExecution().optimizedPlan().toString()
    # a join or a second aggregate would shuffle the bodies
    assert plan.count("Generate posexplode") == 1 and plan.count("Aggregate [") == 1 and "Join" not in plan
