"""Evidence, cues, relations and question specs: validation, duplicates, routing."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import rules
from ..sources import sinks

# Domains and markers of the evidence graph.
DIRECT = ("visual", "ocr", "asr")
ASSERTIONS = {"visual": "OBSERVED", "asr": "SPOKEN_CLAIM", "ocr": "OCR_TEXT"}
SCOPES = {"visual": ("FRAME", "SHORT_CLIP"), "ocr": ("FRAME", "SHORT_CLIP"), "asr": ("SHORT_CLIP", "FULL_VIDEO", "LONG_TERM_CLAIM")}
CREATOR_MARKERS = ("creator handle", "account handle", "account identifier", "username", "douyin handle", "tiktok handle", "抖音号", "账号")
META_MARKERS = ("evidenceunit", "evidence unit", "commercecue", "commerce cue", "commercialrelation", "commercial relation", "evidence_id", "evidence_refs", "cue_id", "relation_id", "spec_id", "task_type", "task_subtype")
RELATION_TOKENS = (
    "description_refers_to_product", "claim_supported_by_demonstration", "claim_repeated_across_modalities", "claim_partially_supported", "claim_contradicted", "claim_temporally_misaligned", "feature_framed_as_benefit", "demonstration_shows_state_change",
    "problem_addressed_by_solution", "objection_responded_by_cue", "content_addresses_fit_uncertainty", "content_addresses_usage_uncertainty", "content_addresses_price_uncertainty", "offer_requires_condition", "content_precedes_cta",
)
GENERIC_QUESTIONS = ("what is shown in the video", "what happens in the video", "what does the video show", "what is happening", "what is the main point")
HANDLING = ("flips through", "turns the pages", "holds up", "points to the product", "shows the product", "rotates the product")
TRIVIAL = ("flips through", "turns the pages", "holds up", "points to", "shows the product", "rotates the product")
HIGH_VALUE = ("PRODUCT_IDENTITY", "ATTRIBUTE_AND_VARIANT", "QUANTITY_AND_BUNDLE", "PRICE_AND_DISCOUNT", "OFFER_CONDITION", "DEMONSTRATED_STATE_CHANGE", "USAGE_SCENARIO")
WORD = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?"
NUMBER = r"(?<![A-Za-z])\d+(?:[.,]\d+)?"


def blank(name: str) -> Column:
    return text.clean(F.col(name)) == ""


def mentions(c: Column, markers: tuple[str, ...]) -> Column:
    return text.mentions(c, markers, ())


def meta_leak(c: Column) -> Column:
    """A marker of the benchmark's own vocabulary, or a relation type as a word."""
    return text.mentions(c, META_MARKERS, RELATION_TOKENS)


def evidence_issues() -> Column:
    """Issue codes of an evidence unit from its own columns."""
    mode = F.lower(F.col("modality"))
    spoken = mode.isin("asr", "ocr")
    localised = F.col("start_s").isNotNull() & F.col("end_s").isNotNull()
    exempt = (mode == "asr") & (F.lower(text.clean(F.col("timestamp_status"))) == "unavailable")
    assertion = F.coalesce(*[F.when(mode == m, F.lit(a)) for m, a in ASSERTIONS.items()])
    scoped = F.lit(False)
    for m, allowed in SCOPES.items():
        scoped = scoped | ((mode == m) & ~F.coalesce(F.upper(F.col("temporal_scope")).isin(*allowed), F.lit(False)))
    words = F.concat_ws(" ", "subject", "predicate", "value", "content_en")
    return rules.issue_codes(
        [
            ("INVALID_GOLD_VALUE", blank("evidence_id") | blank("video_id") | blank("subject") | blank("predicate") | blank("value") | (F.col("start_s") > F.col("end_s"))),
            ("INVALID_CONFIDENCE", F.coalesce(F.col("confidence"), F.lit(0.0)) <= 0),
            ("NON_DIRECT_EVIDENCE", ~F.coalesce(mode.isin(*DIRECT), F.lit(False))),
            ("MISSING_FRAME_REFERENCE", (mode == "visual") & (F.size(F.coalesce("frame_indices", F.array().cast("array<int>"))) == 0)),
            ("MISSING_TEXT_SPAN", spoken & blank("source_text_native")),
            ("MISSING_TEMPORAL_LOCALIZATION", spoken & ~localised & ~exempt),
            ("ASSERTION_MODALITY_MISMATCH", ~F.upper(F.coalesce(F.col("assertion_type"), F.lit(""))).eqNullSafe(assertion) & assertion.isNotNull()),
            ("TEMPORAL_SCOPE_MODALITY_MISMATCH", scoped),
            ("NON_ENGLISH_NORMALIZED_TEXT", text.contains_cjk(words)),
            ("CREATOR_METADATA_LEAK", mentions(F.concat_ws(" ", words, F.col("source_text_native")), CREATOR_MARKERS)),
        ]
    )


#: Enum columns of evidence that with_references gathers, where the evidence has them; their values are few.
GATHERED = {"modality": "modalities", "action_role": "roles", "assertion_scope": "scopes", "assertion_type": "assertions", "temporal_scope": "windows"}


def with_references(df: DataFrame, key: str, ids: str, evidence: DataFrame) -> DataFrame:
    """df with the facts of its distinct referenced evidence: n_refs, n_missing, n_foreign, and the sets in GATHERED; one join and one regroup."""
    refs = df.select(key, "video_id", F.explode(F.array_distinct(ids)).alias("_ref"))
    gathered = {c: out for c, out in GATHERED.items() if c in evidence.columns}
    there = evidence.select(F.col("evidence_id").alias("_ref"), F.col("video_id").alias("_of"), *[(F.lower(c) if c == "modality" else F.upper(c)).alias(f"_{c}") for c in gathered])
    facts = refs.join(there, "_ref", "left").groupBy(key).agg(
        F.count(F.lit(1)).alias("n_refs"), F.count_if(F.col("_of").isNull()).alias("n_missing"), F.count_if(F.col("_of") != F.col("video_id")).alias("n_foreign"),
        *[F.array_sort(F.collect_set(f"_{c}")).alias(out) for c, out in gathered.items()],
    )
    out = df.join(facts, key, "left")
    return out.select(*df.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_refs", "n_missing", "n_foreign")], *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in gathered.values()])


def answer_type(task: Column, answer: Column) -> Column:
    return F.when(task == "BP", F.when(text.clean(answer).rlike(NUMBER), "numeric_fact").otherwise("short_fact")).when(task == "CM", "relation_explanation").when(task == "SS", "commercial_reasoning").otherwise("bounded_need_reasoning")


def spec_issues(allow_candidates: bool = False) -> Column:
    """Issue codes of a question spec."""
    task = F.upper(text.clean(F.col("task_type")))
    states = ("human_accepted",) + (("auto_accepted_candidate",) if allow_candidates else ())
    none = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0
    return rules.issue_codes(
        [
            ("LIFECYCLE_NOT_COMPILABLE", ~F.coalesce(F.lower(text.clean(F.col("lifecycle_status"))).isin(*states), F.lit(False))),
            ("INSUFFICIENT_TASK_EVIDENCE", F.size(F.array_distinct(F.coalesce("evidence_refs", F.array().cast("array<string>")))) < F.when(task == "BP", 1).otherwise(2)),
            ("MISSING_COMMERCIAL_RELATION", task.isin("CM", "SS") & none("commercial_relation_ids")),
            ("MISSING_COMMERCE_GRAPH_REF", (task == "AE") & none("commercial_relation_ids") & none("commerce_cue_ids")),
            ("MISSING_TARGET", blank("target")),
            ("MISSING_GOLD_ANSWER", blank("gold_answer")),
            ("BENCHMARK_META_LEAKAGE", meta_leak(F.col("gold_answer"))),
            ("MISSING_QUESTION_INTENT", blank("question_intent")),
            ("ANSWER_TYPE_MISMATCH", text.clean(F.col("answer_type")) != answer_type(task, F.col("gold_answer"))),
        ]
    )


def stem(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def question_issues(task: Column, question: Column, answer: Column) -> Column:
    """Issue codes of a written question and its answer."""
    q, a = text.clean(question), text.clean(answer)
    words = F.regexp_count(q, F.lit(WORD))
    kind = answer_type(task, a)
    leaks = (F.length(a) > 3) & (stem(a) != "") & (F.position(stem(a), stem(q)) > 0)
    return rules.issue_codes(
        [
            ("NON_ENGLISH_QUESTION", (q == "") | text.contains_cjk(q)),
            ("MISSING_QUESTION_MARK", (q != "") & ~q.endswith("?")),
            ("QUESTION_LENGTH_OUT_OF_RANGE", ~words.between(5, 45)),
            ("GENERIC_QUESTION", stem(q).isin(*GENERIC_QUESTIONS)),
            ("ANSWER_LEAKAGE", leaks),
            ("NON_ENGLISH_GOLD_ANSWER", text.contains_cjk(a)),
            ("BENCHMARK_META_LEAKAGE", meta_leak(q) | meta_leak(a)),
            ("BACKGROUND_HANDLING_QUESTION", (task == "BP") & mentions(F.concat_ws(" ", q, a), HANDLING)),
            ("BP_ANSWER_TOO_LONG", (kind == "short_fact") & (F.size(F.filter(F.split(a, r"\s+"), lambda x: x != "")) > 20)),
            ("INVALID_NUMERIC_ANSWER", (kind == "numeric_fact") & ~a.rlike(NUMBER)),
        ]
    )


def candidate_score(confidence: Column, n_cues: Column, n_relations: Column, task: Column, capability: Column, answer: Column, n_true_checks: Column) -> Column:
    """Additive score: confidence, graph, reasoning value and checks, less trivial actions and long answers; rounded to 6."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    words = F.regexp_count(low, F.lit(WORD))
    gain = F.round(confidence * 50.0, 6) + F.least(F.lit(18), n_cues * 3 + n_relations * 8) + F.when(task != "BP", 10.0).otherwise(0.0)
    gain = gain + F.when((task == "BP") & F.upper(capability).isin(*HIGH_VALUE), 8.0).otherwise(0.0) + F.coalesce(n_true_checks, F.lit(0)) * 2
    loss = F.when(mentions(low, TRIVIAL), 45.0).otherwise(0.0) + F.greatest(F.lit(0), words - 30) * 0.5
    return F.round(gain - loss, 6)


def compile_round(judged: DataFrame, taken: DataFrame | None, quotas: tuple[int, int, int], least: float) -> DataFrame:
    """One pass over each video's candidates in order, with the questions that earlier videos hold taken away.

    A task reads its videos' sorted rows as a stream and keeps only the accepted questions of the present video, so memory does
    not grow with a video.
    """
    most, per_task, per_capability = quotas
    rows = judged.select("video_id", "vqa_id", "_p", "_s", F.col("task_type").alias("task"), F.upper(text.clean(F.col("capability"))).alias("capability"), "_stem", F.lower(F.get("issues", F.lit(0))).alias("issue"))
    rows = rows.withColumn("taken", F.lit(False)) if taken is None else rows.join(taken, "_stem", "left").withColumn("taken", F.coalesce(F.col("_by") < F.col("video_id"), F.lit(False))).drop("_by")
    ordered = rows.repartition("video_id").sortWithinPartitions("video_id", "_p", "_s", "vqa_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, held, tasks, capabilities = None, {}, Counter(), Counter()
        for pdf in frames:
            reasons = []
            for of, task, capability, stem, issue, used in zip(*(pdf[c] for c in ("video_id", "task", "capability", "_stem", "issue", "taken"))):
                if of != video:
                    video, held, tasks, capabilities = of, {}, Counter(), Counter()
                if len(held) >= most:
                    reasons.append("video_quota")
                elif tasks[task] >= per_task:
                    reasons.append("task_quota")
                elif capabilities[capability] >= per_capability:
                    reasons.append("capability_quota")
                elif isinstance(issue, str):
                    reasons.append(issue)
                elif used or stem in held:
                    reasons.append("exact_duplicate_question")
                elif any(similar(held[s], stem) >= least for s in held):
                    reasons.append("within_video_semantic_duplicate")
                else:
                    reasons.append("")
                    held[stem] = set(stem.split())
                    tasks[task] += 1
                    capabilities[capability] += 1
            yield pd.DataFrame({"vqa_id": pdf["vqa_id"], "video_id": pdf["video_id"], "_stem": pdf["_stem"], "reason": reasons})

    return ordered.mapInPandas(run, "vqa_id string, video_id string, _stem string, reason string")


def similar(words: set[str], stem: str) -> float:
    """Jaccard index of two questions' words; 1 when both have none."""
    other = set(stem.split())
    return len(words & other) / len(words | other) if words or other else 1.0


def compile_questions(
    candidates: DataFrame, priority: dict[str, int], most: int = 8, per_task: int = 2, per_capability: int = 1, least: float = 0.92
) -> tuple[DataFrame, DataFrame]:
    """Selected and rejected candidates (video_id, vqa_id unique, task_type, capability, question, gold_answer, score), the latter with `reason`.

    Greedy per video by task priority, score (high first) and id: full quotas refuse a candidate first, then its first issue, then a
    question (numbers as <num>) that this or an earlier video has, then one with `least` of its words in common with
    one of the video. Refused candidates use no quota. Videos go by name. A question taken by one video frees a place in another: after the first round only
    videos for which a question became taken or free by an earlier one choose again, until none does; after round n the first n of any chain of
    videos are settled, so the rounds end. Ties in a null score go last.
    """
    rank = F.coalesce(*[F.when(F.col("task_type") == t, F.lit(n)) for t, n in priority.items()], F.lit(len(priority)))
    judged = candidates.withColumn("issues", question_issues(F.col("task_type"), F.col("question"), F.col("gold_answer")))
    judged = judged.withColumns({"_p": rank, "_s": -F.coalesce(F.col("score"), F.lit(float("-inf"))), "_stem": text.question_stem(F.col("question"))})
    judged = sinks.cut(judged.select("video_id", "vqa_id", "_p", "_s", "task_type", "capability", "_stem", "issues"), "judged")
    quotas = (most, per_task, per_capability)
    chosen = sinks.cut(compile_round(judged, None, quotas, least), "chosen")
    taken = sinks.cut(chosen.filter("reason = ''").groupBy("_stem").agg(F.min("video_id").alias("_by")), "taken")
    moved = taken.select("_stem", F.lit(None).cast(taken.schema["_by"].dataType).alias("_was"), "_by")
    while True:
        earlier = lambda c: F.coalesce(F.col(c) < F.col("video_id"), F.lit(False))
        again = sinks.cut(judged.select("video_id", "_stem").join(moved, "_stem").filter(earlier("_was") != earlier("_by")).select("video_id").distinct(), "again")
        if again.isEmpty():
            break
        new = sinks.cut(compile_round(judged.join(again, "video_id", "left_semi"), taken, quotas, least), "again")
        touched = chosen.join(again, "video_id", "left_semi").unionByName(new).filter("reason = ''").select("_stem").distinct()
        chosen = sinks.cut(chosen.join(again, "video_id", "left_anti").unionByName(new), "chosen")
        now = chosen.filter("reason = ''").join(touched, "_stem", "left_semi").groupBy("_stem").agg(F.min("video_id").alias("_now"))
        moved = touched.join(taken, "_stem", "left").join(now, "_stem", "left").filter(~F.col("_by").eqNullSafe(F.col("_now")))
        moved = sinks.cut(moved.select("_stem", F.col("_by").alias("_was"), F.col("_now").alias("_by")), "moved")
        taken = sinks.cut(taken.join(moved, "_stem", "left_anti").unionByName(moved.filter("_by IS NOT NULL").select("_stem", "_by")), "taken")
    decided = candidates.join(chosen.select("vqa_id", "reason"), "vqa_id").select(*candidates.columns, "reason")
    return decided.filter("reason = ''").drop("reason"), decided.filter("reason <> ''")


def merge_reviews(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Queue items with their decision applied: rejected ones leave, revisions replace value and evidence; the last decision of an item wins.

    An unknown item in decisions is an error at run time.
    """
    last = decisions.groupBy("review_item_id").agg(F.max_by(F.struct("decision", "revised_value", "revised_evidence_ids"), "reviewed_at").alias("_d"))
    known = last.join(queue.select("review_item_id", F.lit(True).alias("_known")), "review_item_id", "left")
    checked = known.filter(F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown review item: "), F.col("review_item_id")))).otherwise(F.lit(True)))
    out = queue.join(checked.select("review_item_id", "_d"), "review_item_id").filter(F.col("_d.decision").isin("ACCEPT", "REVISE"))
    revised = F.col("_d.decision") == "REVISE"
    return out.withColumn("gold_value", F.when(revised, F.coalesce("_d.revised_value", "gold_value")).otherwise(F.col("gold_value"))).withColumn("evidence_ids", F.when(revised, F.coalesce("_d.revised_evidence_ids", "evidence_ids")).otherwise(F.col("evidence_ids"))).withColumn("lifecycle_status", F.lit("human_accepted")).drop("_d")
