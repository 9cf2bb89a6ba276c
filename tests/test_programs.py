"""Questions from templates and diversity reports."""

import pytest

from sparkloom.plans import programs

ITEM = "task_type string, task_subtype string, question_format string, target string, gold_value string, extra int"


def rendered(spark, rows, table=None):
    df = spark.createDataFrame([(*r, 1) for r in rows], ITEM)
    return [(r["question"], r["answer"]) for r in programs.rendered_questions(df, table or programs.program_table(spark)).collect()]


def test_names_defaults_and_answers(spark):
    rows = [
        ("BP", "ENTITY_ATTRIBUTE", "direct_question", '{"subject": "Brand", "predicate": "Weight"}', '{"value": "5 kg"}'),
        ("BP", "ENTITY_ATTRIBUTE", "direct_question", None, '{"predicate": "TITLE", "z": "last", "b": "first"}'),
        ("CM", "CLAIM_EVIDENCE_RELATION", "relation_choice", '{"claim": "old"}', '{"claim": "it lasts", "relation": "SUPPORTED"}'),
        ("BP", "PRODUCT_IDENTITY", "grounded_question", "no json", None),
    ]
    assert sorted(rendered(spark, rows)) == sorted([
        ("What is the Weight of the brand shown in the video?", "5 kg"), ("What is the title of the target object shown in the video?", "first"),
        ("How does the visual or textual evidence relate to the claim that it lasts?", "SUPPORTED"), ("What product is presented in the video?", ""),
    ])
    assert rendered(spark, []) == []


def test_missing_templates_and_names_are_errors(spark):
    with pytest.raises(Exception, match="no question program for BP\\|NOPE\\|direct_question"):
        rendered(spark, [("BP", "NOPE", "direct_question", "{}", "{}")])
    own = programs.program_table(spark, (("BP", "X", "f", "{colour} and {subject}{subject}"),))
    assert rendered(spark, [("BP", "X", "f", '{"colour": "red"}', '{"subject": "s"}')], own) == [("red and ss", "s")]
    with pytest.raises(Exception, match="no value for colour"):
        rendered(spark, [("BP", "X", "f", "{}", "{}")], own)


def test_diversity(spark):
    rows = [("What 1?", "BP", ["a", "b"]), ("What 2?", "CM", ["b", " a "]), ("Who?", "BP", ["c"]), ("Why?", "BP", ["c", ""]), ("What 3?", "BP", ["d"]), ("what 4", "CM", ["d"]), (None, "CM", None)]
    schema = "question string, task_type string, evidence_refs array<string>"
    got = programs.diversity(spark.createDataFrame(rows, schema)).first()
    assert tuple(got) == (7, 3, round(4 / 7, 6), 2, 0)
    assert tuple(programs.diversity(spark.createDataFrame([], schema)).first()) == (0, 0, 0.0, 0, 0)
