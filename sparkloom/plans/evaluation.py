"""The evaluation run: what a judge is shown, its replies, and scores of every question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.shapes import shaped
from ..operators import aggregates
from . import replies

# Fields of a judge's context.
EVIDENCE = {f: None for f in ("evidence_id", "modality", "content_en", "start_s", "end_s", "frame_indices", "confidence")}
GRAPH = {
    "commerce_cues": {f: None for f in ("cue_id", "cue_type", "content_en", "evidence_ids", "directness")},
    "commercial_relations": {f: None for f in ("relation_id", "relation_type", "source_cue_ids", "target_cue_ids", "evidence_ids", "status", "rationale_en", "provenance")},
}
TEXTS = ("vqa_id", "video_id", "question", "task_type", "task_subtype", "capability", "reasoning_operator")


def judge_payload(gold: DataFrame, model_output: Column) -> Column:
    """JSON that a judge is shown for an answered question: its texts, both answers, and the allowed part of its evidence and graph.

    gold: TEXTS and gold_answer, and where it has them answer_type, evidence_context (array of structs) and graph_context (struct of arrays). Missing texts are empty,
    missing contexts empty lists; fields outside the shape, private ones above all, cannot pass, since the payload is made of named columns only.
    """
    has = set(gold.columns)
    fields = [(text.clean(F.col(c)) if c in has else F.lit("")).alias(c) for c in TEXTS]
    none = F.from_json(F.lit("[]"), "array<string>")

    def part(column: str, allowed: dict, inner: str | None = None) -> Column:
        kind = gold.schema[column].dataType
        c = F.col(column)
        if inner is not None:
            if inner not in getattr(kind, "names", []):
                return none
            kind, c, allowed = kind[inner].dataType, c[inner], allowed[inner]
        out = shaped(c, kind, allowed)
        return none if out is None else F.coalesce(out, F.array().cast(gold.select(out.alias("x")).schema["x"].dataType))

    evidence = part("evidence_context", EVIDENCE) if "evidence_context" in has else none
    graph = [(part("graph_context", GRAPH, k) if "graph_context" in has else none).alias(k) for k in GRAPH]
    kind = F.coalesce(F.nullif(text.clean(F.col("answer_type")), F.lit("")), F.lit("open")) if "answer_type" in has else F.lit("open")
    return F.to_json(F.struct(
        *fields, F.col("gold_answer").alias("reference_answer"), text.clean(model_output).alias("model_output"),
        F.struct(evidence.alias("evidence_refs"), kind.alias("answer_type")).alias("evidence_context"), F.struct(*graph).alias("graph_context"),
    ))


def one_answer(predictions: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """key and answer, one row for each key that is not blank: the last by order, without an order the smallest answer. So a repeated prediction doubles nothing."""
    kept = predictions.filter(text.clean(F.col(key)) != "")
    return kept.groupBy(key).agg((F.min("answer") if order is None else F.max_by("answer", order)).alias("answer"))


def evaluate_answers(gold: DataFrame, predictions: DataFrame, ask: Callable[[DataFrame], DataFrame], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Details of every gold row, and the score report by task, micro and macro.

    gold: vqa_id (unique) and what judge_payload reads; predictions: vqa_id, answer. ask maps (vqa_id, payload) of answered questions to (vqa_id, success, reply).
    A question without an answer scores 0; one whose judge failed or gave a reply that cannot be read has no score and leaves the means. Answers to
    other questions are ignored; a null answer is none. Empty tables give no details and a report of nothing.
    """
    answers = one_answer(predictions, "vqa_id", order)
    met = gold.join(answers.withColumnRenamed("answer", "_answer"), "vqa_id", "left")
    missing = text.clean(F.col("_answer")) == ""
    asked = met.filter(~missing)
    given = ask(asked.select("vqa_id", judge_payload(asked, F.col("_answer")).alias("payload")))
    judged = replies.judge_reply(given.filter("success").select("vqa_id", "reply"), "reply").select("vqa_id", "score", "tags", "reason", F.col("refused").alias("fault"))
    told = met.select("vqa_id", F.upper(text.clean(F.col("task_type"))).alias("task_type"), missing.alias("missing")).join(judged, "vqa_id", "left")
    fault = F.when(~F.col("missing") & F.col("score").isNull(), F.coalesce("fault", F.lit("JUDGE_FAILED")))
    details = told.select("vqa_id", "task_type", "missing", F.when(F.col("missing"), 0.0).otherwise(F.col("score")).alias("score"), fault.isNull().alias("judge_success"), fault.alias("fault"), "tags", "reason")
    return details, aggregates.score_report(details, "task_type", "score", "judge_success")
