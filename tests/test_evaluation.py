"""Shapes of nested columns, judge payloads and evaluation runs."""

import json

import pytest
from pyspark.sql import functions as F

from oracle import rows_of, tables
from sparkloom.functions import shapes
from sparkloom.plans import evaluation, pipelines, run_queries

SF = "/root/testdata/sf0.001"
NESTED = "id string, a struct<x:string,Likes:int,deep:array<struct<y:string,gmv:double,more:map<string,string>>>>, m map<string,array<int>>, only struct<price:int>, e array<string>, likes int"


def nested(spark, rows):
    return spark.createDataFrame(rows, NESTED)


def shown(df, column, allowed=None, filled=False):
    c = shapes.shaped(F.col(column), df.schema[column].dataType, allowed, filled=filled)
    return None if c is None else [r["o"] for r in df.select(F.to_json(F.struct(c.alias("v"))).alias("o")).collect()]


def test_shapes_keep_what_is_allowed(spark):
    df = nested(spark, [("1", ("t", 3, [("u", 1.0, {"price": "9", "k": "v"}), None]), {"Sales": [1], "ok": [2]}, (5,), ["", "z"], 1), ("2", None, None, None, None, None)])
    assert shown(df, "a") == ['{"v":{"x":"t","deep":[{"y":"u","more":{"k":"v"}},null]}}', "{}"]
    assert shown(df, "a", {"deep": {"y": None, "gmv": None}, "Likes": None}) == ['{"v":{"deep":[{"y":"u"},null]}}', "{}"]
    assert shown(df, "m") == ['{"v":{"ok":[2]}}', "{}"]
    assert shown(df, "only") is None and shown(df, "a", {"nothing": None}) is None and shown(df, "a", {"Likes": None}) is None
    assert shown(df, "e", filled=True) == ['{"v":["z"]}', "{}"]


def test_public_context_has_no_private_null_or_empty_values(spark):
    df = nested(spark, [("1", (" ", 3, [("", 1.0, {"price": "9"})]), {"ok": []}, (5,), [], 7), ("2", ("x", 1, []), {"gmv": [1], "b": [1]}, None, ["q"], 7), (None, None, None, None, None, None)])
    got = [json.loads(r["c"]) for r in df.select(shapes.public_context(df, ["id", "a", "m", "only", "e", "likes"]).alias("c")).collect()]
    assert got == [{"id": "1"}, {"id": "2", "a": {"x": "x"}, "m": {"b": [1]}, "e": ["q"]}, {}]
    plan = df.select(shapes.public_context(df, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert [r[0] for r in df.select(shapes.public_context(df, ["likes", "only"])).collect()] == ["{}"] * 3


@pytest.mark.parametrize("name", ["judge_payloads", "judged_details", "judged_report"])
def test_queries_equal_their_sql(spark, name):
    df = next(q for q in run_queries.ALL if q.__name__ == name)(spark, SF)
    found = tables(SF).sql(run_queries.ORACLES[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(list(found.columns), found.fetchall())


def test_evaluation_of_repeats_missing_answers_and_bad_replies(spark):
    gold = spark.createDataFrame([(i, t, "q", "g") for i, t in (("a", "bp"), ("b", "CM"), ("c", "CM"), ("d", "CM"), ("e", "BP"))], "vqa_id string, task_type string, question string, gold_answer string")
    answers = spark.createDataFrame([("a", "2", 1), ("a", "1", 2), ("c", "x", 1), ("d", " ", 1), ("e", "y", 1), ("zz", "extra", 1), (None, "n", 1)], "vqa_id string, answer string, at int")
    seen = []

    def ask(asked):
        seen.extend(json.loads(r["payload"]) for r in asked.collect())
        reply = F.when(F.col("vqa_id") == "c", "nothing").otherwise('{"score": 0.5, "reason": "ok"}')
        return asked.select("vqa_id", (F.col("vqa_id") != "e").alias("success"), reply.alias("reply"))

    details, report = evaluation.evaluate_answers(gold, answers, ask, "at")
    got = {r["vqa_id"]: (r["score"], r["missing"], r["fault"]) for r in details.collect()}
    assert got == {"a": (0.5, False, None), "b": (0.0, True, None), "c": (None, False, "NO_SCORE"), "d": (0.0, True, None), "e": (None, False, "JUDGE_FAILED")}
    first = next(p for p in seen if p["vqa_id"] == "a")
    assert first["model_output"] == "1" and first["reference_answer"] == "g" and first["graph_context"] == {"commerce_cues": [], "commercial_relations": []} and first["video_id"] == ""
    assert {r["block"]: (r["count"], r["failed"]) for r in report.collect()}["micro"] == (3, 2)
    none, _ = evaluation.evaluate_answers(gold.limit(0), answers.limit(0), ask, "at")
    assert none.count() == 0


def test_the_plain_evaluation_counts_a_repeated_prediction_once(spark):
    gold = spark.createDataFrame([("a", "BP")], "vqa_id string, task_type string")
    answers = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "b")], "vqa_id string, answer string")

    def judge(rows):
        return [{"vqa_id": r["vqa_id"], "correctness": 1.0, "grounding": 1.0, "completeness": 1.0, "judge_success": True} for r in rows]

    assert pipelines.evaluate(gold, answers, "vqa_id", judge)[0].count() == 1
