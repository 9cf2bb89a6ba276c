"""Review queues in one form: rows of older shapes with their proposals resolved, quality events as question rows, items fit to compile, guards of translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nested, text
from ..operators import joins, rules
from ..sources import sinks
from .replies import QUALITY_FIELDS

# Reasons that name a stage, issues that mean a conflict, what a queue's texts are called, statuses that may be compiled.
VALIDATION = ("VALIDATION_FAILED", "CONFLICTING_VALUE", "SEMANTIC_DUPLICATE")
CONFLICTS = ("CONFLICTING_VALUE", "DUPLICATE_SEMANTICS")
OBJECT_TYPES = {"human_review": "qa_human_review", "auto_rejected": "qa_rejection", "pipeline_diagnostics": "qa_diagnostic", "accepted_sample": "qa_accepted_sample"}
ACCEPTED, VERIFIED = ("human_accepted",), ("auto_accepted_candidate", "verified")

LINKED = ["task_type", "task_subtype", "capability", "reasoning_operator", "question_intent", "target", "gold", "evidence_ids", "commerce_cue_ids", "commercial_relation_ids"]
STRINGS = "array<string>"


def none() -> Column:
    return F.array().cast(STRINGS)


def ids(c: Column) -> Column:
    """Texts of a list, trimmed, without blanks and repeats; null is empty."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, none()), text.clean), lambda x: x != ""))


def first_list(*lists: Column) -> Column:
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in map(ids, lists)], none())


def first_text(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(text.clean(c), F.lit("")) for c in texts], F.lit(""))


def first_object(*objects: Column) -> Column:
    """The first JSON object that has a key; null if there is none."""
    return F.coalesce(*[F.when(text.clean(c).startswith("{") & ~F.regexp_replace(text.clean(c), r"\s", "").eqNullSafe("{}"), c) for c in objects])


def reason_code(reason: Column, explicit: Column) -> Column:
    """The code as given, else the words before the colon, else REVIEW_REQUIRED; all in upper case."""
    prefix = text.clean(F.substring_index(F.coalesce(reason, F.lit("")), ":", 1))
    worded = F.when(prefix.rlike(r"^[A-Za-z][A-Za-z0-9_ -]*$"), F.upper(F.replace(prefix, F.lit(" "), F.lit("_"))))
    return F.coalesce(F.nullif(F.upper(text.clean(explicit)), F.lit("")), worded, F.lit("REVIEW_REQUIRED"))


def review_rows(queue: DataFrame, proposals: DataFrame) -> DataFrame:
    """Queue rows in one form, with the proposals they come from.

    queue: video_id and review_item_id (a row's key, never null), stage, item_type, task_type, task_subtype, reason, reason_code, proposal_id, source_proposal_ids, issue_codes,
    target and gold (JSON), evidence_ids, commerce_cue_ids, commercial_relation_ids, abstention (struct of task_type, task_subtype, reason), snapshot (struct of
    proposal_id, source_proposal_ids, source_cue_ids, target_cue_ids, relation_id and what proposals have). proposals: video_id and proposal_id (unique), and LINKED.
    Every field is the first that is there of the row's, the snapshot's and the first linked proposal's; lists fall back on those of all linked
    proposals. Null structs, lists and texts are absent ones. Extra columns are left out.
    """
    snap, gone = F.col("snapshot"), F.col("abstention")
    own = text.clean(F.col("proposal_id"))
    held = text.clean(snap["proposal_id"])
    source = F.coalesce(*[F.when(F.size(x) > 0, x) for x in (ids(F.col("source_proposal_ids")), ids(snap["source_proposal_ids"]), ids(F.array(held)), ids(F.array(F.when(own != "stage", own))))], none())
    key = ["video_id", "review_item_id"]
    df = queue.withColumn("_ids", source)
    there = proposals.select("video_id", F.col("proposal_id").alias("_ref"), F.struct(*LINKED).alias("_p"))
    found = df.select(*key, F.posexplode("_ids").alias("_at", "_ref")).join(there, ["video_id", "_ref"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_at", "_ref", "_p"))).alias("_links"))
    df = joins.attach_or_empty_by(df, found, key, "_links").withColumn("_first", F.get("_links", F.lit(0))["_p"])
    first = F.col("_first")
    of_links = lambda f: F.flatten(F.transform("_links", lambda x: F.coalesce(x["_p"][f], none())))
    any_of = lambda f: [F.col(f), snap[f], first[f]]
    cited = F.concat(F.coalesce(snap["source_cue_ids"], none()), F.coalesce(snap["target_cue_ids"], none()))
    lists = {
        "evidence_refs": first_list(*any_of("evidence_ids"), of_links("evidence_ids")), "cue_ids": first_list(*any_of("commerce_cue_ids"), cited, of_links("commerce_cue_ids")),
        "relation_ids": first_list(*any_of("commercial_relation_ids"), F.array(snap["relation_id"]), of_links("commercial_relation_ids")),
    }
    code = reason_code(F.col("reason"), F.col("reason_code"))
    named = lambda c: (text.clean(c["task_type"]) != "") | (text.clean(c["task_subtype"]) != "")
    row_named = (text.clean(F.col("task_type")) != "") | (text.clean(F.col("task_subtype")) != "")
    task = lambda f: F.when(row_named, text.clean(F.col(f))).when(gone.isNotNull() & named(gone), text.clean(gone[f])).when(snap.isNotNull(), text.clean(snap[f])).otherwise(text.clean(first[f]))
    df = df.withColumns({**lists, "_target": first_object(*any_of("target")), "_gold": first_object(*any_of("gold")), "_code": code, "_task": task("task_type"), "_subtype": task("task_subtype")})
    c = F.col("_code")
    embedded = snap.isNotNull()
    kind = F.coalesce(
        F.nullif(text.clean(F.col("item_type")), F.lit("")), F.when(gone.isNotNull() | (c == "ABSTENTION"), "abstention"),
        F.when(c.isin("CONFLICTING_VALUE", "SEMANTIC_DUPLICATE") | F.arrays_overlap(F.coalesce("issue_codes", none()), F.array(*map(F.lit, CONFLICTS))), "conflict"),
        F.when(c.endswith("_FAILED") & ~embedded & first_object(F.col("gold")).isNull(), "stage_failure"), F.lit("candidate"),
    )
    df = df.withColumn("_kind", kind)
    stage = F.coalesce(
        F.nullif(text.clean(F.col("stage")), F.lit("")), F.when(F.lower("review_item_id").contains("adjudicator") | c.startswith("ADJUDICATOR"), "adjudication"), F.when(c.startswith("CHALLENGE"), "challenge"),
        F.when(c.isin(*VALIDATION), "validation"), F.when((F.col("_kind") == "stage_failure") & c.contains("ADJUDICATION"), "adjudication"), F.lit("proposal"),
    )
    unresolved = F.array_except("_ids", F.transform("_links", lambda x: x["_ref"]))
    shown = embedded | F.col("_target").isNotNull() | F.col("_gold").isNotNull() | (F.size("evidence_refs") > 0)
    primary = embedded | first.isNotNull()
    status = (
        F.when(F.col("_kind") == "abstention", "not_applicable").when((F.size(unresolved) > 0) & ~shown, "unresolved")
        .when(F.col("_target").isNull() & F.col("_gold").isNull() & ~primary, "diagnostic").otherwise("resolved")
    )
    main = lambda f: F.when(embedded, text.clean(snap[f])).otherwise(text.clean(first[f]))
    return df.select(
        *key, stage.alias("stage"), F.col("_kind").alias("item_type"), F.col("_task").alias("task_type"), F.col("_subtype").alias("task_subtype"), c.alias("reason_code"), first_text(gone["reason"], F.col("reason")).alias("reason"),
        F.col("_target").alias("target"), F.col("_gold").alias("candidate_gold"), "evidence_refs", F.col("cue_ids").alias("commerce_cue_ids"), F.col("relation_ids").alias("commercial_relation_ids"),
        first_text(main("capability"), F.col("_subtype")).alias("capability"), main("reasoning_operator").alias("reasoning_operator"), main("question_intent").alias("question_intent"), F.col("_ids").alias("source_proposal_ids"),
        F.coalesce("issue_codes", none()).alias("issue_codes"), F.transform("_links", lambda x: F.struct(x["_ref"].alias("proposal_id"), x["_p"].alias("proposal"))).alias("source_candidates"), status.alias("resolution_status"),
        unresolved.alias("unresolved_proposal_ids"), first_text(own, held, F.when(F.size("_ids") == 1, F.get("_ids", F.lit(0)))).alias("proposal_id"),
    )


def quality_rows(events: DataFrame) -> DataFrame:
    """Quality events as rows of the question table.

    events: record_id, video_id, task_type, spec_id, annotation_id, reason, reason_code, bucket, question, rejected_question, spec (struct of spec_id, annotation_id,
    video_id, task_type, capability, gold_answer; may be null). An event without a spec is known by a digest of its record_id.
    """
    spec = F.col("spec")
    spec_id = first_text(F.col("spec_id"), spec["spec_id"])
    code = first_text(F.col("reason_code"), F.lit("QA_QUALITY_EVENT"))
    kind = F.coalesce(*[F.when(F.col("bucket") == k, F.lit(v)) for k, v in OBJECT_TYPES.items()], F.lit("qa_diagnostic"))
    return events.select(
        F.concat(F.lit("qa-quality:"), first_text(spec_id, F.substring(F.sha2(F.col("record_id").cast("string"), 256), 1, 16))).alias("vqa_id"), first_text(F.col("video_id"), spec["video_id"]).alias("video_id"),
        first_text(F.col("task_type"), spec["task_type"], F.lit("UNKNOWN")).alias("task_type"), first_text(spec["capability"]).alias("capability"), first_text(F.col("question"), F.col("rejected_question")).alias("question"),
        first_text(spec["gold_answer"]).alias("gold_answer"), spec_id.alias("spec_id"), ids(F.array(first_text(F.col("annotation_id"), spec["annotation_id"]))).alias("source_annotation_ids"), F.col("bucket").alias("audit_bucket"),
        first_text(F.col("reason"), code).alias("reason"), F.array(code).alias("risk_codes"), kind.alias("translation_object_type"),
    )


def compilable(items: DataFrame, verdicts: DataFrame | None = None, candidates: str = "none") -> DataFrame:
    """Items of the firm tiers whose status may be compiled: candidates is none, automatic (those not yet verified too) or all; another tier than the four is an error.

    items: video_id, annotation_id, capability, task_subtype, gold_tier, review_status. With verdicts (spec_id, verdict, and the twelve fields of a quality verdict as booleans),
    items that no person accepted stay only where their spec passed in every field: a left semi join.
    """
    allowed = ACCEPTED + {"none": (), "automatic": VERIFIED[:1], "all": VERIFIED}[candidates]
    tier = F.col("gold_tier")
    known = F.when(tier.isin("Gold-A", "Gold-B"), True).when(tier.isin("Silver", "Rejected"), False).otherwise(F.raise_error(F.concat(F.lit("unknown tier: "), F.coalesce(tier, F.lit("null")))).cast("boolean"))
    df = items.filter(known).filter(F.col("review_status").isin(*allowed))
    if verdicts is None:
        return df
    passed = (text.clean(F.col("spec_id")) != "") & (F.upper(text.clean(F.col("verdict"))) == "PASS")
    for f in QUALITY_FIELDS:
        passed = passed & F.col(f)
    specs = verdicts.filter(passed).select(text.clean(F.col("spec_id")).alias("_spec"))
    spec = nested.content_id("spec", 12, video=F.col("video_id"), annotation=F.col("annotation_id"), capability=F.upper(first_text(F.col("capability"), F.col("task_subtype"))))
    human = F.col("review_status") == "human_accepted"
    return df.filter(human).unionByName(df.filter(~human).withColumn("_spec", spec).join(specs, "_spec", "left_semi").drop("_spec"))


def translation_faults(rows: DataFrame) -> DataFrame:
    """Rows of a translation table with fault codes: audit mark, private columns, missing parts, keys that an earlier row (by row_ord) has.

    The first row of a key is found by a grouped minimum, so a key with very many rows is folded before it is sent.
    """
    key = ["object_type", "object_id", "source_field", "source_sha256"]
    private = {p.lower() for p in (*nested.PRIVATE, "private_analysis_metadata")}
    lacks = F.lit(False)
    for c in (*key, "translated_text"):
        lacks = lacks | (F.coalesce(F.col(c), F.lit("")) == "")
    first = rows.groupBy(*key).agg(F.min("row_ord").alias("_first"))
    on = F.lit(True)
    for c in key:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}"))
    df = rows.alias("r").join(first.alias("f"), on, "left").select("r.*", "f._first")
    codes = rules.issue_codes([
        ("NOT_AUDIT_ONLY", ~F.coalesce("audit_only", F.lit(False))), ("PRIVATE_FIELD", F.lit(any(c.lower() in private for c in rows.columns))), ("INCOMPLETE", lacks), ("DUPLICATE_KEY", F.col("row_ord") > F.col("_first")),
    ])
    return df.select(*rows.columns, codes.alias("faults"))


def first_seen(sources: list[tuple[DataFrame, str]]) -> DataFrame:
    """Distinct ids of several tables, each with the place of the first table that has it. sources: (table, id column); blank ids are left out."""
    both = None
    for place, (df, key) in enumerate(sources):
        part = df.select(text.clean(F.col(key)).alias("id"), F.lit(place).alias("source")).filter("id <> ''")
        both = part if both is None else both.unionByName(part)
    return both.groupBy("id").agg(F.min("source").alias("source"))


def eligible(df: DataFrame, require_video: bool = False) -> DataFrame:
    """Base records that a cohort may draw: id, bucket, segment and some text, and a video where one is asked for."""
    has = lambda c: text.clean(F.col(c)) != ""
    keep = has("video_id") & has("product_bucket") & has("fan_segment") & (has("title") | has("video_text"))
    return df.filter(keep & (F.col("has_video_asset").cast("boolean") if require_video else F.lit(True)))


def illustrated_refs(annotations: DataFrame, evidence: DataFrame, frames: DataFrame, width: float = 5.0, per_second: float | None = None) -> DataFrame:
    """One row for each reference of an annotation, with the frames that show it; kind tells how they were found.

    annotations: annotation_id (unique), video_id, evidence_refs. evidence: evidence_id (unique), modality, frame_indices, start_s, end_s. frames: video_id, frame_index (unique in
    a video), timestamp_s. direct: what is seen has its own frames, in order; temporal: what is said in a span has the frames in it, else the nearest one; representative:
    what is said without a span has the first, middle and last frame; context: an annotation without references has these too, at place -1; missing: no such unit; none: any
    other unit. Frames rank within their video in one sorted task; temporal frames are found by buckets of `width` seconds. The nearest frame is that of least distance (ties: least index), or with
    per_second that of least distance * per_second + index.
    """
    refs = annotations.select("annotation_id", "video_id", F.posexplode_outer("evidence_refs").alias("place", "evidence_id"))
    units = evidence.select("evidence_id", F.lit(True).alias("_known"), "modality", "frame_indices", F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"))
    spoken = F.col("modality") == "asr"
    kind = (
        F.when(F.col("place").isNull(), "context").when(F.col("_known").isNull(), "missing").when(F.col("modality").isin("visual", "ocr"), "direct")
        .when(spoken & F.col("start_s").isNotNull() & F.col("end_s").isNotNull(), "temporal").when(spoken, "representative").otherwise("none")
    )
    df = refs.join(units, "evidence_id", "left").withColumns({"kind": kind, "place": F.coalesce("place", F.lit(-1))})
    df = sinks.cut(df, "refs")  # each kind reads its own rows of it
    row, shown = ["annotation_id", "place"], ["frame_index", "timestamp_s"]
    direct = df.filter("kind = 'direct'").select(*row, "video_id", F.posexplode("frame_indices").alias("_at", "frame_index")).join(frames.select("video_id", *shown), ["video_id", "frame_index"]).select(*row, "_at", *shown)
    asked = df.filter("kind = 'temporal'")
    timed = frames.filter("timestamp_s IS NOT NULL").select("video_id", *shown)
    spans = joins.in_range_or_nearest(asked.select("video_id", "start_s", "end_s").distinct(), timed, ["video_id"], "start_s", "end_s", "timestamp_s", "frame_index", width, per_second)
    temporal = asked.select(*row, "video_id", "start_s", "end_s").join(spans, ["video_id", "start_s", "end_s"]).select(*row, F.col("frame_index").alias("_at"), *shown)
    ranked = frames.withColumn("_r", F.row_number().over(Window.partitionBy("video_id").orderBy("frame_index"))).join(frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n")), "video_id")
    few = ranked.filter((F.col("_r") == 1) | (F.col("_r") == F.floor(F.col("_n") / 2) + 1) | (F.col("_r") == F.col("_n"))).select("video_id", *shown)
    usual = df.filter("kind IN ('representative', 'context')").select(*row, "video_id").join(few, "video_id").select(*row, F.col("frame_index").alias("_at"), *shown)
    found = direct.unionByName(temporal).unionByName(usual).groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("_at", *shown))).alias("frames"))
    return joins.attach_or_empty_by(df.select(*row, "video_id", "evidence_id", "kind"), found, row, "frames")
