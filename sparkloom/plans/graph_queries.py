"""Queries of the evidence graph on the driver tables: every event stands for an evidence unit, a cue and a relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scans import table
from . import evidence, graph

CUE_TYPES = ("PRICE", "OFFER_CONDITION", "PRODUCT_ATTRIBUTE", "BENEFIT", "PRICE_CLAIM", "BEFORE_AFTER", "PRODUCT_IDENTITY", "PROCESS_DEMONSTRATION", "EFFECT_CLAIM", "CTA")
RELATION_TYPES = ("OFFER_REQUIRES_CONDITION", "FEATURE_FRAMED_AS_BENEFIT", "CLAIM_REPEATED_ACROSS_MODALITIES", "CLAIM_SUPPORTED_BY_DEMONSTRATION", "CLAIM_TEMPORALLY_MISALIGNED", "CONTENT_PRECEDES_CTA", "NO_SUCH")
ROLES = ("BACKGROUND_HANDLING", "PRODUCT_INSPECTION", "FUNCTIONAL_OPERATION", "OUTCOME_DEMONSTRATION")
SCOPES = ("OBSERVED_FACT", "SPOKEN_CLAIM", "OBSERVED_FACT", "CONDITIONAL")
WINDOWS = ("FRAME", "LONG_TERM_CLAIM", "SHORT_CLIP", "FULL_VIDEO", "FRAME")
STATUSES = ("SUPPORTED", "PARTIALLY_SUPPORTED", "TEMPORALLY_MISALIGNED", "UNCLEAR")
CONTENTS = ("plain", "The presenter holds the product", "The speaker says it lasts", "")
RATIONALES = ("ok", "it increases trust", "不", "", "fits")
TASKS = ("BP", "CM", "SS", "AE")


def pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(number, F.lit(len(values))).cast("int") + 1)


def name(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def divides(n: int) -> Column:
    return F.col("event_id") % n == 0


def codes(issues: str = "issues") -> Column:
    return F.array_join(issues, ",").alias("codes")


def units(spark, d) -> DataFrame:
    """Every event as an evidence unit of its user, with the user's next event."""
    n = F.col("event_id")
    mode = F.when(F.col("event_type") == "view", "visual").when(F.col("event_type") == "click", "ocr").otherwise("asr")
    nxt = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").select(
        "event_id", name("e", n).alias("evidence_id"), F.col("user_id").cast("string").alias("video_id"), mode.alias("modality"),
        F.concat_ws(" ", "event_type", (n % 7).cast("string")).alias("content_en"), (n % 5).cast("string").alias("value"), nxt.alias("next_id"),
        F.when(mode == "visual", pick(ROLES, n)).alias("action_role"), pick(SCOPES, n).alias("assertion_scope"), pick(WINDOWS, n).alias("temporal_scope"),
        F.when(mode == "visual", "OBSERVED").when(mode == "ocr", "OCR_TEXT").otherwise("SPOKEN_CLAIM").alias("assertion_type"),
    )


def cues(evidence_units: DataFrame) -> DataFrame:
    """A cue for every unit: it cites its event, the user's next one, and now and then an unknown or a foreign one."""
    n = F.col("event_id")
    refs = F.array_compact(F.array(F.col("evidence_id"), name("e", F.col("next_id")), F.when(divides(13), name("x", n)), F.when(divides(17), name("e", n + 1))))
    content = F.when(divides(3), F.concat(F.lit("price "), (n % 9).cast("string"))).when(divides(29), "网").otherwise(pick(CONTENTS, n))
    return evidence_units.select(
        "event_id", name("c", n).alias("cue_id"), "video_id", pick(CUE_TYPES, n).alias("cue_type"), content.alias("content_en"), refs.alias("evidence_ids"), F.when(n % 6 < 4, pick(ROLES, n + 3)).alias("action_role"),
        F.when(n % 5 < 3, "OBSERVED_FACT").otherwise("SPOKEN_CLAIM").alias("assertion_scope"), F.when(divides(31), "MAYBE").otherwise("DIRECT").alias("directness"), "next_id",
    )


def relations(all_cues: DataFrame) -> DataFrame:
    """A relation of every cue with the user's next cue, some with a lost or a foreign end, the last of a user without any."""
    n = F.col("event_id")
    end = F.when(divides(28), name("z", n)).when(divides(36), name("c", n + 2)).otherwise(name("c", F.col("next_id")))
    return all_cues.select(
        name("r", n).alias("relation_id"), "video_id", pick(RELATION_TYPES, n).alias("relation_type"), F.array("cue_id").alias("source_cue_ids"), F.array_compact(F.array(end)).alias("target_cue_ids"), "evidence_ids",
        F.when(divides(5), "THEORY_DIRECT").otherwise("THEORY_OPERATIONALIZED").alias("provenance"), pick(RATIONALES, n).alias("rationale_en"), pick(STATUSES, n).alias("status"),
    )


def cue_checks(spark, d):
    e = units(spark, d)
    return graph.checked_cues(cues(e), e).select("cue_id", codes())


def relation_checks(spark, d):
    e = units(spark, d)
    c = cues(e)
    return graph.checked_relations(relations(c), c, e).select("relation_id", codes())


def basic_proposals(spark, d):
    e = units(spark, d)
    c = cues(e)
    out = graph.basic_proposals(c, relations(c), e)
    return out.select("cue_id", "video_id", "task_type", "capability", "gold_answer", F.size("evidence_ids").alias("n_evidence"), F.array_join("commercial_relation_ids", ",").alias("relations"), "speech_only")


def evidence_checks(spark, d):
    """Issue codes of events as evidence units, with gaps in every rule's columns."""
    e = units(spark, d)
    made = e.select(
        F.when(~divides(19), F.col("evidence_id")).alias("evidence_id"), "event_id", "video_id", F.when(divides(23), "metadata").otherwise(F.col("modality")).alias("modality"), F.lit("user").alias("subject"), F.lit("did").alias("predicate"), "value",
        F.when(divides(3), F.lit("网")).otherwise(F.col("content_en")).alias("content_en"), F.when(~divides(4), F.lit("said")).alias("source_text_native"), F.when(~divides(5), F.lit(1.0)).alias("start_s"), F.lit(2.0).alias("end_s"),
        F.when(divides(10), F.lit("unavailable")).alias("timestamp_status"), F.when(~divides(6), F.array(F.lit(1))).alias("frame_indices"), ((F.col("event_id") % 8) / 8).alias("confidence"),
        F.when(F.col("modality") == "visual", "OBSERVED").otherwise("SPOKEN_CLAIM").alias("assertion_type"), F.when(divides(2), "FRAME").otherwise("SHORT_CLIP").alias("temporal_scope"),
    )
    return made.select("event_id", F.array_join(evidence.evidence_issues(), ",").alias("codes"))


def spec_checks(spark, d):
    """Issue codes of orders as question specs."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    task = pick(TASKS, key)
    made = o.select(
        "o_orderkey", task.alias("task_type"), F.when(key % 5 == 0, "draft").when(key % 5 == 1, "auto_accepted_candidate").otherwise("human_accepted").alias("lifecycle_status"), F.array(F.lit("a"), F.when(key % 3 == 0, "a").otherwise("b")).alias("evidence_refs"),
        F.when(key % 7 > 0, F.array(F.lit("r"))).alias("commercial_relation_ids"), F.when(key % 2 > 0, F.array(F.lit("c"))).alias("commerce_cue_ids"), F.lit("t").alias("target"), F.when(key % 11 == 0, " ").when(key % 13 == 0, "3 cups").otherwise("cups").alias("gold_answer"),
        F.lit("why").alias("question_intent"), F.lit("short_fact").alias("answer_type"),
    )
    return made.select("o_orderkey", F.array_join(evidence.spec_issues(), ",").alias("codes"))


def compiled_questions(spark, d):
    """User turns as candidate questions: kept, or the reason why not."""
    t = table(spark, d, "conversations").filter("role = 'user'")
    made = t.select((F.col("conv_id") % 50).cast("string").alias("video_id"), F.concat_ws(":", "conv_id", "turn").alias("vqa_id"), pick(TASKS, F.col("turn")).alias("task_type"), name("k", F.col("turn") % 3).alias("capability"), F.concat("text", F.lit("?")).alias("question"), F.lit("no").alias("gold_answer"), F.length("text").cast("double").alias("score"))
    kept, rejected = evidence.compile_questions(made, {"BP": 0, "CM": 1, "SS": 2, "AE": 3}, per_task=3, per_capability=2)
    return kept.select("vqa_id", F.lit("KEPT").alias("outcome")).unionByName(rejected.select("vqa_id", F.col("reason").alias("outcome")))


def merged_reviews(spark, d):
    """Customers as queue items; their last order is the decision: shipped accepts, open revises, others reject."""
    queue = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("review_item_id"), F.col("c_mktsegment").alias("gold_value"), F.array("c_name").alias("evidence_ids"), F.lit("needs_human_review").alias("lifecycle_status"))
    o = table(spark, d, "orders")
    said = F.when(F.col("o_orderstatus") == "F", "ACCEPT").when(F.col("o_orderstatus") == "O", "REVISE").otherwise("REJECT")
    decisions = o.select(F.col("o_custkey").cast("string").alias("review_item_id"), said.alias("decision"), F.col("o_orderpriority").alias("revised_value"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("revised_evidence_ids"), F.col("o_orderkey").alias("reviewed_at"))
    return evidence.merge_reviews(queue, decisions).select("review_item_id", "gold_value", F.size("evidence_ids").alias("n_evidence"), "lifecycle_status")


def redacted_json(spark, d):
    """Private keys two levels deep in open JSON leave."""
    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"z": [{"Likes": 1, "p": '), "props", F.lit('}], "a": '), (F.col("event_id") % 5).cast("string"), F.lit("}")).alias("payload"))
    return graph.redacted(e, "payload")


def translation_checks(spark, d):
    """Turns with a translation that is whole, lost or missing."""
    t = table(spark, d, "conversations")
    target = F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit(" 译"))).when(F.col("conv_id") % 3 == 1, F.lit("译")).otherwise(F.col("text"))
    return t.select("conv_id", "turn", F.array_join(graph.translation_issues(F.col("text"), target), ",").alias("codes"))


ALL = (cue_checks, relation_checks, basic_proposals, evidence_checks, spec_checks, compiled_questions, merged_reviews, redacted_json, translation_checks)
