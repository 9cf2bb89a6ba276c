"""Queries of model replies on the driver tables, and their SQL twins. Replies are written from the rows of conversations, some of them broken."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..sources.scans import table
from . import replies


def turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "text", F.pmod(F.col("conv_id") + F.col("turn"), F.lit(8)).alias("i"), F.length("text").alias("n"))


def listed(n, item: str):
    return F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit(item), n.cast("int")), ","), F.lit("]"))


def list_replies(spark, d):
    """Cue replies: how many objects and abstentions, or why refused."""
    t, n = turns(spark, d), F.pmod(F.col("n"), F.lit(4))
    cues = listed(n, '{"a": 1}, 5')
    body = F.concat(F.lit('{"commerce_cues": '), cues, F.lit(', "abstentions": '), listed(F.pmod(F.col("n"), F.lit(3)), '{"r": "x"}'), F.lit("}"))
    made = (
        F.when(F.col("i") == 0, F.concat(F.lit("```json\n"), body)).when(F.col("i") == 1, F.concat(F.lit('{"commerce_cues": '), cues, F.lit(', "abstentions": {}}'))).when(F.col("i") == 2, '{"other": []}')
        .when(F.col("i") == 3, F.concat(F.lit('{"commerce_cues": '), cues, F.lit("}"))).when(F.col("i") == 4, '{"commerce_cues": 3}').when(F.col("i") == 5, " ").otherwise(body)
    )
    out = replies.list_reply(t.withColumn("reply", made), "reply", "commerce_cues")
    return out.select("conv_id", "turn", "refused", F.size("items").alias("n_items"), F.size("abstentions").alias("n_abstentions"))


def adjudications(spark, d):
    """Adjudication replies in both forms."""
    t, n = turns(spark, d), F.pmod(F.col("n"), F.lit(4))
    key = F.when(F.col("i") < 4, "accepted_groups").otherwise("grounded_annotations")
    made = F.when(F.col("i") == 7, "{}").otherwise(F.concat(F.lit('{"'), key, F.lit('": '), listed(n, '{"g": 1}'), F.lit(', "human_review_queue": '), F.when(F.col("i") == 0, '"none"').otherwise('[{"h": 1}]'), F.lit("}")))
    out = replies.adjudication_reply(t.withColumn("reply", made), "reply")
    return out.select("conv_id", "turn", "refused", "decision_only", F.size("items").alias("n_items"), F.size("human_review_queue").alias("n_queue"))


def judge_replies(spark, d):
    """Judge replies: JSON with and without parts, answer lines, faults of each kind."""
    t, i, s = turns(spark, d), F.col("i"), F.col("n") % 5 / 4
    parts = F.concat(F.lit('{"score": 1, "correctness": '), s.cast("string"), F.lit(', "grounding": 0.5, "completeness": 1, "error_tags": [" factual_error", "FACTUAL_ERROR", "unanswered"], "reason": "fine"}'))
    made = (
        F.when(i == 0, F.concat(F.lit("So: "), parts)).when(i == 1, F.concat(F.lit('{"Answer": "'), s.cast("string"), F.lit('", "reason": "x"}'))).when(i == 2, '{"score": 0.3}').when(i == 3, '{"score": 1, "error_tags": "UNANSWERED"}')
        .when(i == 4, '{"score": 1, "error_tags": ["BAD"]}').when(i == 5, F.concat(F.lit("answer : 0.75\nReason: "), F.lit("good"))).when(i == 6, "no score").otherwise('{"score": 0.5, "reason": "好"}')
    )
    out = replies.judge_reply(t.withColumn("reply", made), "reply")
    return out.select("conv_id", "turn", "refused", "score", "reported", F.array_join("tags", ",").alias("tags"), F.col("reason").alias("why"))


def quality_replies(spark, d):
    """Quality verdicts of questions; a pass with false fields is turned."""
    t, i = turns(spark, d), F.col("i")
    flag = lambda f: F.when((F.col("n") % 3 == 0) & F.lit(f in ("unique_answer", "non_trivial")), "false").when((i == 6) & F.lit(f == "task_aligned"), '"true"').otherwise("true")
    fields = F.concat_ws(", ", *[F.concat(F.lit(f'"{f}": '), flag(f)) for f in replies.QUALITY_FIELDS if f != "reference_closed"], F.when(i != 5, '"reference_closed": true'))
    made = F.concat(F.lit('{"spec_id": "'), F.when(i == 1, "other").otherwise(F.col("conv_id").cast("string")), F.lit('", "verdict": "'), F.when(i == 2, "maybe").when(i == 3, "human_review").otherwise("pass"), F.lit('", "reason": "'), F.when(i == 4, " ").otherwise("ok"), F.lit('", '), fields, F.when(i == 0, "").otherwise("}"))
    out = replies.quality_reply(t.withColumn("reply", made).withColumn("spec", F.col("conv_id").cast("string")), "reply", "spec")
    return out.select("conv_id", "turn", "refused", "verdict", F.col("reason").alias("why"), F.array_join("failed", ",").alias("failed"))


def relation_replies(spark, d):
    """Verdicts of each conversation's turns as relations: judged once each, or the reply's first fault."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("r"), F.col("turn").cast("string")).alias("relation_id"))
    i = F.pmod("conv_id", F.lit(7))
    row = F.concat(F.lit('{"relation_id": "'), "relation_id", F.lit('", "verdict": "'), F.when((i == 4) & (F.col("turn") == 0), "maybe").otherwise("pass"), F.lit('", "reason": "'), F.when((i == 3) & (F.col("turn") == 0), "").otherwise("ok"), F.lit('"}'))
    some = t.withColumn("row", F.when((i == 5) & (F.col("turn") == 0), "7").otherwise(row))
    held = some.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("row")), ", ").alias("rows"))
    more = F.when(i == 1, ', {"relation_id": "zz", "verdict": "PASS", "reason": "ok"}').when(i == 2, ', {"relation_id": "r0", "verdict": "PASS", "reason": "ok"}').otherwise("")
    made = held.select("conv_id", F.when(i == 6, '{"verifications": 1}').otherwise(F.concat(F.lit('{"verifications": ['), "rows", more, F.lit("]}"))).alias("reply"))
    good, refused = replies.relation_verdicts(t.select("conv_id", "relation_id"), made, "conv_id", "reply")
    return good.groupBy("conv_id").agg(F.concat(F.lit("PASS "), F.count_if(F.col("verdict") == "PASS").cast("string")).alias("outcome")).unionByName(refused.withColumnRenamed("refused", "outcome"))


def decision_checks(spark, d):
    """Orders as human decisions on customers' items."""
    o, n = table(spark, d, "orders"), F.col("o_orderkey")
    said = F.when(n % 5 == 0, "revise").when(n % 5 == 1, "ACCEPT_GOLD_B").when(n % 5 == 2, "MAYBE").otherwise("REJECT")
    made = o.select("o_orderkey", F.col("o_custkey").cast("string").alias("review_item_id"), n.cast("string").alias("proposal_id"), said.alias("decision"), F.when(n % 7 == 0, " ").otherwise("me").alias("reviewer_id"), F.lpad(n.cast("string"), 12, "0").alias("reviewed_at"), F.lit("X").alias("reason_code"), F.when(n % 2 == 0, "v").alias("revised_value"), F.when(n % 3 == 0, F.array(F.lit("e"))).alias("revised_evidence_ids"))
    return replies.decision_issues(made).select("o_orderkey", F.array_join("issues", ",").alias("codes"))


def prediction_checks(spark, d):
    """Turns as predictions of items: task types made equal, answers under another name, missing ids and answers."""
    t = table(spark, d, "conversations").select(F.when(F.col("turn") % 5 == 0, " ").otherwise(F.concat_ws(":", "conv_id", "turn")).alias("vqa_id"), "conv_id", "turn", F.when(F.col("turn") % 3 > 0, F.col("text")).alias("model_answer"), F.when(F.col("turn") % 2 == 0, " bp").otherwise("SS").alias("task_type"))
    answer, codes = replies.prediction_issues(t.columns)
    return replies.known_tasks(t, "task_type").select("conv_id", "turn", "task_type", F.length(answer).alias("n_answer"), F.array_join(codes, ",").alias("codes"))


def realized_questions(spark, d):
    """Turns as written questions, some of them formulaic or giving their answer away."""
    t = turns(spark, d)
    question = F.when(F.col("i") == 0, F.concat(F.lit("Based on the evidence, "), "text", F.lit("?"))).when(F.col("i") == 1, F.concat("text", F.lit(" 好?"))).when(F.col("i") < 5, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    answer = F.get(F.split("text", " "), F.lit(0))
    return t.select("conv_id", "turn", F.array_join(replies.realized_issues(question, answer), ",").alias("codes"))


ALL = (list_replies, adjudications, judge_replies, quality_replies, relation_replies, decision_checks, prediction_checks, realized_questions)

T = "WITH t AS (SELECT conv_id, turn, text, (conv_id + turn) % 8 AS i, length(text) AS n FROM conversations)"


def codes(*pairs: tuple[str, str]) -> str:
    return "coalesce(array_to_string(list_filter([" + ", ".join(f"CASE WHEN {when} THEN '{code}' END" for code, when in pairs) + "], lambda x: x IS NOT NULL), ','), '') AS codes"


ORACLES = {
    "list_replies": f"""{T} SELECT conv_id, turn, CASE i WHEN 0 THEN 'FENCED' WHEN 1 THEN 'NOT_A_LIST' WHEN 2 THEN 'MISSING_KEY' WHEN 4 THEN 'NOT_A_LIST' WHEN 5 THEN 'EMPTY' END AS refused,
  CAST(CASE WHEN i IN (3, 6, 7) THEN n % 4 ELSE 0 END AS INTEGER) AS n_items, CAST(CASE WHEN i IN (6, 7) THEN n % 3 ELSE 0 END AS INTEGER) AS n_abstentions FROM t""",
    "adjudications": f"""{T} SELECT conv_id, turn, CASE i WHEN 0 THEN 'NOT_A_LIST' WHEN 7 THEN 'MISSING_KEY' END AS refused, i < 4 AS decision_only, CAST(CASE WHEN i IN (0, 7) THEN 0 ELSE n % 4 END AS INTEGER) AS n_items, CAST(i NOT IN (0, 7) AS INTEGER) AS n_queue FROM t""",
    "judge_replies": f"""{T}, s AS (SELECT *, n % 5 / 4.0::DOUBLE AS c FROM t)
SELECT conv_id, turn, CASE i WHEN 2 THEN 'INVALID_SCORE' WHEN 3 THEN 'TAGS_NOT_A_LIST' WHEN 4 THEN 'UNKNOWN_TAG' WHEN 6 THEN 'NO_SCORE' WHEN 7 THEN 'NOT_ENGLISH' END AS refused,
  CASE WHEN i = 0 THEN CASE WHEN c = 0 THEN 0.25 WHEN c = 0.25 THEN 0.5 WHEN c <= 0.75 THEN 0.5 + 0.25 * CAST(c > 0.5 AS INTEGER) ELSE 0.75 END WHEN i = 1 THEN c WHEN i = 5 THEN 0.75 END::DOUBLE AS score,
  CASE i WHEN 0 THEN 1.0 WHEN 1 THEN c WHEN 5 THEN 0.75 END::DOUBLE AS reported, CASE WHEN i = 0 THEN 'FACTUAL_ERROR,UNANSWERED' WHEN i IN (1, 5) THEN '' END AS tags, CASE i WHEN 0 THEN 'fine' WHEN 1 THEN 'x' WHEN 5 THEN 'good' END AS why FROM s""",
    "quality_replies": f"""{T}, q AS (SELECT *, CASE i WHEN 0 THEN 'NOT_JSON' WHEN 1 THEN 'OTHER_SPEC' WHEN 2 THEN 'UNKNOWN_VERDICT' WHEN 4 THEN 'NO_REASON' WHEN 5 THEN 'NOT_BOOLEAN' WHEN 6 THEN 'NOT_BOOLEAN' END AS refused, CASE WHEN n % 3 = 0 THEN 'unique_answer,non_trivial' ELSE '' END AS f FROM t)
SELECT conv_id, turn, refused, CASE WHEN refused IS NULL THEN CASE WHEN i = 3 THEN 'HUMAN_REVIEW' WHEN f <> '' THEN 'REJECT' ELSE 'PASS' END END AS verdict,
  CASE WHEN refused IS NULL THEN CASE WHEN i <> 3 AND f <> '' THEN 'ok Failed quality dimensions: unique_answer, non_trivial.' ELSE 'ok' END END AS why, CASE WHEN refused IS NULL THEN f END AS failed FROM q""",
    "relation_replies": """SELECT conv_id, CASE WHEN conv_id % 7 = 1 THEN 'UNKNOWN_RELATION' WHEN conv_id % 7 = 2 THEN CASE WHEN bool_or(turn = 0) THEN 'DUPLICATE_RELATION' ELSE 'UNKNOWN_RELATION' END WHEN conv_id % 7 = 3 AND bool_or(turn = 0) THEN 'NO_REASON'
  WHEN conv_id % 7 = 4 AND bool_or(turn = 0) THEN 'UNKNOWN_VERDICT' WHEN conv_id % 7 = 5 AND bool_or(turn = 0) THEN 'OMITTED_RELATION' WHEN conv_id % 7 = 6 THEN 'NO_LIST' ELSE 'PASS ' || count(*) END AS outcome FROM conversations GROUP BY 1""",
    "decision_checks": f"""WITH o AS (SELECT o_orderkey AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT n AS o_orderkey, {codes(("MISSING_FIELD", "n % 7 = 0"), ("INVALID_DECISION", "n % 5 = 2"), ("REVISE_WITHOUT_VALUE", "n % 5 = 0 AND n % 2 <> 0"), ("REVISE_WITHOUT_EVIDENCE", "n % 5 = 0 AND n % 3 <> 0"), ("DUPLICATE_ITEM", "r > 1"))} FROM o""",
    "prediction_checks": f"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'BP' ELSE 'SS' END AS task_type, CASE WHEN turn % 3 > 0 THEN length(text) END AS n_answer, {codes(("missing_vqa_id", "turn % 5 = 0"), ("missing_answer_field", "turn % 3 = 0"))} FROM conversations""",
    "realized_questions": f"""{T}, q AS (SELECT *, trim(CASE WHEN i = 0 THEN 'Based on the evidence, ' || text || '?' WHEN i = 1 THEN text || ' 好?' WHEN i < 5 THEN text || '?' ELSE text END) AS q, lower(trim(string_split(text, ' ')[1])) AS a FROM t)
SELECT conv_id, turn, {codes(("NON_ENGLISH_QUESTION", "q = '' OR regexp_matches(q, '[' || chr(13312) || '-' || chr(19903) || chr(19968) || '-' || chr(40959) || ']')"), ("MISSING_QUESTION_MARK", "q <> '' AND NOT ends_with(q, '?')"),
  ("FORMULAIC_QUESTION", "regexp_matches(lower(q), 'what mechanism|what strategy|what audience|support the answer|support your answer|according to the evidence|based on the evidence')"), ("ANSWER_LEAKAGE", "length(a) > 3 AND contains(lower(q), a)"))} FROM q""",
}
