"""Items of the question bank: normalising raw evidence, checking proposals and accepted items, auditing a bank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import nested, numbers, text
from ..operators import aggregates, joins, rules, windows
from .evidence import ASSERTIONS, WORD, mentions, with_references

# Task, capability, what it needs of the graph, and its reasoning operator.
CAPABILITIES = (
    ("BP", "PRODUCT_IDENTITY", "CUE", "IDENTIFY_PRODUCT"), ("BP", "ATTRIBUTE_AND_VARIANT", "CUE", "EXTRACT_ATTRIBUTE"), ("BP", "QUANTITY_AND_BUNDLE", "CUE", "AGGREGATE_OFFER"), ("BP", "PRICE_AND_DISCOUNT", "CUE", "EXTRACT_OFFER"),
    ("BP", "OFFER_CONDITION", "RELATION_OPTIONAL", "EXTRACT_CONDITION"), ("BP", "USAGE_STEP", "CUE", "SEQUENCE_ACTION"), ("BP", "DEMONSTRATED_STATE_CHANGE", "RELATION_OPTIONAL", "COMPARE_STATE"), ("BP", "USAGE_SCENARIO", "CUE", "LOCALIZE_SCENARIO"),
    ("CM", "SPEECH_VISUAL_COREFERENCE", "RELATION_REQUIRED", "ALIGN_COREFERENCE"), ("CM", "OCR_SPEECH_OFFER_ALIGNMENT", "RELATION_REQUIRED", "COMPARE_OFFER"), ("CM", "CLAIM_DEMONSTRATION_STATUS", "RELATION_REQUIRED", "CLASSIFY_CLAIM_SUPPORT"),
    ("CM", "REPETITION_VS_INDEPENDENT_EVIDENCE", "RELATION_REQUIRED", "DISTINGUISH_REPETITION"), ("CM", "PARTIAL_SUPPORT", "RELATION_REQUIRED", "DECOMPOSE_CLAIM"), ("CM", "CONTRADICTION", "RELATION_REQUIRED", "DETECT_CONTRADICTION"),
    ("CM", "TEMPORAL_MISALIGNMENT", "RELATION_REQUIRED", "ALIGN_TEMPORAL_STATE"), ("CM", "NOT_DEMONSTRATED", "RELATION_REQUIRED", "VERIFY_ABSENCE_WITH_SCOPE"),
    ("SS", "PROBLEM_SOLUTION", "RELATION_PATH_REQUIRED", "RECONSTRUCT_PROBLEM_SOLUTION"), ("SS", "FEATURE_BENEFIT", "RELATION_PATH_REQUIRED", "MAP_FEATURE_TO_BENEFIT"), ("SS", "PROCESS_DEMONSTRATION", "RELATION_PATH_REQUIRED", "INTERPRET_PROCESS_ROLE"),
    ("SS", "OUTCOME_DISPLAY", "RELATION_PATH_REQUIRED", "INTERPRET_OUTCOME_ROLE"), ("SS", "BEFORE_AFTER_COMPARISON", "RELATION_PATH_REQUIRED", "COMPARE_PRESENTED_STATES"), ("SS", "VICARIOUS_TRIAL", "RELATION_PATH_REQUIRED", "RECONSTRUCT_VICARIOUS_TRIAL"),
    ("SS", "PRICE_VALUE_FRAMING", "RELATION_PATH_REQUIRED", "LINK_PRICE_TO_VALUE"), ("SS", "REFERENCE_PRICE_ANCHORING", "RELATION_PATH_REQUIRED", "COMPARE_PRICE_ANCHOR"), ("SS", "CREDIBILITY_SIGNAL", "RELATION_PATH_REQUIRED", "IDENTIFY_CREDIBILITY_CUE"),
    ("SS", "SOCIAL_PROOF", "RELATION_PATH_REQUIRED", "IDENTIFY_INTERNAL_SOCIAL_PROOF"), ("SS", "LIMITATION_DISCLOSURE", "RELATION_PATH_REQUIRED", "IDENTIFY_LIMITATION"), ("SS", "OBJECTION_HANDLING", "RELATION_PATH_REQUIRED", "TRACE_OBJECTION_RESPONSE"),
    ("SS", "SCARCITY_AND_URGENCY", "RELATION_PATH_REQUIRED", "EXTRACT_URGENCY_CONDITION"), ("SS", "CTA_SEQUENCE", "RELATION_PATH_REQUIRED", "ORDER_CONTENT_BEFORE_CTA"),
    ("AE", "CONTENT_IMPLIED_NEED", "CUE_OR_RELATION", "INFER_BOUNDED_NEED"), ("AE", "USAGE_CONTEXT", "CUE_OR_RELATION", "LOCALIZE_USAGE_CONTEXT"), ("AE", "FIT_CONSTRAINT", "CUE_OR_RELATION", "MATCH_FIT_CONSTRAINT"), ("AE", "QUALITY_UNCERTAINTY", "CUE_OR_RELATION", "TRACE_QUALITY_CONCERN"),
    ("AE", "USAGE_UNCERTAINTY", "CUE_OR_RELATION", "TRACE_USAGE_CONCERN"), ("AE", "PRICE_UNCERTAINTY", "CUE_OR_RELATION", "TRACE_PRICE_CONCERN"), ("AE", "SERVICE_OR_RISK_CONCERN", "CUE_OR_RELATION", "TRACE_RISK_RESPONSE"),
    ("AE", "DECISION_BARRIER", "CUE_OR_RELATION", "IDENTIFY_DECISION_BARRIER"), ("AE", "OFFER_NEED_ALIGNMENT", "CUE_OR_RELATION", "ALIGN_OFFER_TO_NEED"),
)
# Words of answers by task, wording of inferences, causes and conditions, internal ids.
LONGEST = {"BP": 20, "CM": 45, "SS": 50, "AE": 45}
INFERENCES = ("probably", "likely", "trust", "motivation", "audience", "strategy", "appeal", "可能", "大概", "信任", "受众", "策略", "动机")
CAUSES = ("caused", "because of this", "conversion", "sales", "购买转化", "销售", "归因")
CONDITIONS = (" if ", " when ", " after ", "requires", "conditional", "provided that", "by claiming", "with a coupon")
INTERNAL_ID = r"(?i)\b(?:evidence(?:unit)?|commercecue|commercialrelation|annotation|spec|gold|cue|relation)[_-]?id\b|\b[\w-]+_(?:visual|asr|ocr)_\d{3}_[a-f0-9]{6,}\b"
CLAIM_STATES = ("SUPPORTED", "PARTIALLY_SUPPORTED", "CONTRADICTED", "NOT_SHOWN", "TEMPORALLY_MISALIGNED")
# Classifiers of evidence wording, in order.
SCOPE_WORDS = (
    ("CONDITIONAL", (" if ", " when ", " after claiming", "requires ", "provided that")), ("INSTRUCTION", ("should ", "must ", "need to ", "instructs", "instruction")),
    ("HYPOTHETICAL", ("might ", "could ", "would ", "hypothetical")), ("PROMOTIONAL_PROMISE", ("guarantees", "guaranteed", "will make", "promises")),
)
ROLE_WORDS = (
    ("BACKGROUND_HANDLING", ("simulating tasting", "simulates tasting", "pretends to use", "poses with")),
    ("OUTCOME_DEMONSTRATION", ("state change", "before and after", "before-after", "becomes clean", "becomes empty", "result is shown", "outcome")),
    ("FUNCTIONAL_OPERATION", ("applies ", "connects ", "assembles ", "scans ", "measures ", "installs ", "loads ", "uses the ", "demonstrates how", "eats ", "tastes ", "drinks ", "consumes ")),
    ("PRODUCT_INSPECTION", (
        "opens the package", "opens a package", "exposes ", "cross-section", "close-up", "printed content", "connector", "tears open", "torn open", "revealing its", "reveals its", "layered interior", "product label", "labeled ",
        "tilts the product", "tilts the cart", "flexes the",
    )),
    ("BACKGROUND_HANDLING", ("holds ", "holding ", "points to", "pointing to", "shows ", "displays ", "presents ", "lifts ", "rotates ", "flips through", "turns the pages")),
)
LONG_TERM = ("after a day", "all day", "whole day", "for hours", "for days", "for weeks", "long-lasting", "long lasting", "lasting effect", "durable over time", "overnight", "24/7")
LONG_TIME = r"\b(?:a|an|one|two|three|four|five|six|seven|eight|nine|ten|\d+)[\s-]+(?:hours?|days?|weeks?|months?|years?)\b"
MODES = ("visual", "asr", "ocr", "title", "metadata", "cross_modal")
MODE_NAMES = {"image": "visual", "frame": "visual", "photo": "visual", "video": "visual", "speech": "asr", "audio": "asr", "subtitle": "asr", "subtitles": "asr", "voice": "asr", "on_screen_text": "ocr", "on-screen text": "ocr", "screen_text": "ocr"}
SCOPES = ("OBSERVED_FACT", "SPOKEN_CLAIM", "CONDITIONAL", "INSTRUCTION", "HYPOTHETICAL", "PROMOTIONAL_PROMISE")
ROLES = ("OUTCOME_DEMONSTRATION", "FUNCTIONAL_OPERATION", "PRODUCT_INSPECTION", "BACKGROUND_HANDLING")
LABELS = {"very_high": 0.95, "very high": 0.95, "high": 0.90, "medium": 0.75, "moderate": 0.75, "low": 0.50, "very_low": 0.25, "very low": 0.25}
PLACEHOLDERS = ("english content-specific focus", "specific supported claim", "ask a specific question about the cited product, offer, claim, or sequence.", "a concise english answer bounded by the cited graph.")

NONE = ("", "N/A", "NA", "NONE", "NULL", "NOT_APPLICABLE")


def worded(c: Column, classes: tuple, other: Column) -> Column:
    """The first class one of whose words occurs in the trimmed lower-case text."""

    def first(low: Column) -> Column:
        out = None
        for name, words in classes:
            out = F.when(mentions(low, words), name) if out is None else out.when(mentions(low, words), name)
        return out.otherwise(other)

    return text.bound(F.lower(text.clean(c)), first)


def assertion_scope(mode: Column, content: Column) -> Column:
    return worded(content, SCOPE_WORDS, F.when(mode == "asr", "SPOKEN_CLAIM").otherwise("OBSERVED_FACT"))


def action_role(content: Column) -> Column:
    return worded(content, ROLE_WORDS, F.lit(None).cast("string"))


def temporal_scope(mode: Column, content: Column, declared: Column) -> Column:
    """The declared scope, unless the wording claims a long term; without one, a frame for what is seen and a clip for what is said."""
    low = F.lower(text.clean(content))
    long = (mode == "asr") & (mentions(low, LONG_TERM) | low.rlike(LONG_TIME))
    said = F.nullif(F.upper(text.clean(declared)), F.lit(""))
    return F.when(long, "LONG_TERM_CLAIM").otherwise(F.coalesce(said, F.when(mode.isin("visual", "ocr"), "FRAME").when(mode == "asr", "SHORT_CLIP").otherwise("UNSPECIFIED")))


def closed(c: Column, domain: tuple[str, ...], fallback: Column) -> Column:
    """A value of a closed domain (dashes as underscores), else the fallback."""
    return text.bound(F.replace(F.upper(text.normalize_blanks(c)), F.lit("-"), F.lit("_")), lambda value: F.when(value.isin(*domain), value).otherwise(fallback))


def modality(mode: Column, assertion: Column, frames: Column, native: Column, source: Column) -> Column:
    """The modality of raw evidence: as named, by an alias, by its assertion where none is named, by the source of `text`; else metadata."""
    said = F.upper(text.normalize_blanks(assertion))
    framed, worded_ = F.size(F.coalesce(frames, F.array().cast("array<int>"))) > 0, text.clean(native) != ""
    inferred = text.bound(said, lambda s: F.when((s == "OBSERVED") & framed, "visual").when((s == "OCR_TEXT") & framed & worded_, "ocr").when((s == "SPOKEN_CLAIM") & worded_ & ~framed, "asr").otherwise("metadata"))
    alias = F.create_map(*[F.lit(x) for pair in MODE_NAMES.items() for x in pair])
    spoken, shown = ("asr", "subtitle", "speech", "audio", "口播", "字幕"), ("ocr", "on-screen", "screen_text", "画面文字")
    of_text = text.bound(F.lower(F.concat_ws(" ", source, native)), lambda blob: F.when(mentions(blob, spoken), "asr").when(mentions(blob, shown), "ocr").otherwise("metadata"))
    return text.bound(F.lower(text.normalize_blanks(mode)), lambda x: F.when(x == "", inferred).when(x.isin(*MODES), x).when(x == "text", of_text).otherwise(F.coalesce(F.try_element_at(alias, x), F.lit("metadata"))))


def labelled_confidence(c: Column) -> Column:
    """A label or a number; percentages are scaled; all else is 0."""
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    number = text.bound(F.lower(text.normalize_blanks(c)), lambda low: F.coalesce(F.try_element_at(labels, low), low.try_cast("double")))
    scaled = text.bound(number, lambda x: F.when((x > 1) & (x <= 100), x / 100).otherwise(x))
    return text.bound(scaled, lambda x: F.when(x.between(0, 1), x).otherwise(0.0))


def is_placeholder(c: Column) -> Column:
    """Text that a model copied from its instructions, or in angle brackets."""
    return text.bound(F.lower(text.normalize_blanks(c)), lambda low: low.isin(*PLACEHOLDERS) | (low.startswith("<") & low.endswith(">")))


def normalized_evidence(raw: DataFrame, keep: list[str] | tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Typed evidence units, and refused rows with a reason. keep: further columns of raw that units keep.

    raw: video_id, ordinal, evidence_id, modality, assertion_type, assertion_scope, action_role, temporal_scope, frame_indices, source_text_native, subject,
    predicate, value, content_en, start_s, end_s, timestamp_status, confidence. An id that is not of the form <video>_<modality>_..., or that an earlier row of the
    video has, gives way to one derived from video, modality and ordinal.
    """
    c = lambda name: text.normalize_blanks(F.col(name))
    mode = modality(F.col("modality"), F.col("assertion_type"), F.col("frame_indices"), F.col("source_text_native"), F.col("evidence_id"))
    df = raw.withColumn("_mode", mode).withColumn("_status", F.lower(F.coalesce(F.nullif(c("timestamp_status"), F.lit("")), F.lit("unavailable"))))
    m = F.col("_mode")
    timeless = (m == "asr") & (F.col("_status") == "unavailable")
    start, end = F.when(~timeless, F.col("start_s")), F.when(~timeless, F.col("end_s"))
    confidence = labelled_confidence(F.col("confidence"))
    reason = F.when((c("subject") == "") | (c("predicate") == "") | F.col("value").isNull() | (F.col("value") == ""), "MISSING_FIELD").when(start > end, "START_AFTER_END").when(F.col("confidence").isNull() | (confidence <= 0), "NO_CONFIDENCE")
    derived = nested.content_id("ev", 12, video=F.col("video_id"), mode=m, ordinal=F.col("ordinal"))
    own = F.when(c("evidence_id").startswith(F.concat(c("video_id"), F.lit("_"), m, F.lit("_"))), c("evidence_id"))
    df = df.withColumn("refused", reason)
    good = df.filter("refused IS NULL").withColumn("_id", F.coalesce(own, derived))
    first = F.row_number().over(Window.partitionBy(F.xxhash64("video_id", "_id"), "video_id", "_id").orderBy("ordinal")) == 1  # the hash leads, or sorting compares long equal beginnings of texts
    # each classifier is a column of its own, so none is worked out again where its result is used
    good = good.withColumn("_words", F.coalesce(F.nullif(c("content_en"), F.lit("")), F.col("value"))).withColumn("_low", F.lower(text.clean(F.col("_words"))))
    words, low = F.col("_words"), F.col("_low")
    good = good.withColumns({"_inferred": assertion_scope(m, words), "_seen": action_role(words), "_feigned": mentions(low, ("simulating", "simulates", "pretends to", "poses with"))})
    inferred, role = F.col("_inferred"), F.col("_seen")
    good = good.withColumn("_scope", closed(F.col("assertion_scope"), SCOPES, inferred))
    scope = F.when((m == "asr") & (F.col("_scope") == "OBSERVED_FACT"), F.when(inferred != "OBSERVED_FACT", inferred).otherwise("SPOKEN_CLAIM")).otherwise(F.col("_scope"))
    feigned = (role == "BACKGROUND_HANDLING") & F.col("_feigned")
    role = F.when(feigned | role.isin("PRODUCT_INSPECTION", "FUNCTIONAL_OPERATION", "OUTCOME_DEMONSTRATION"), role).otherwise(closed(F.col("action_role"), ROLES, role))
    native = F.coalesce(F.nullif(c("source_text_native"), F.lit("")), F.when(m.isin("asr", "ocr"), c("value")), F.lit(""))
    frame = F.regexp_extract(F.coalesce("evidence_id", F.lit("")), r"(?i)frame[_-]?(\d+)", 1)
    frames = F.when(F.size(F.coalesce("frame_indices", F.array().cast("array<int>"))) > 0, F.col("frame_indices")).when(frame != "", F.array(frame.cast("int"))).otherwise(F.array().cast("array<int>"))
    assertion = F.coalesce(F.nullif(F.upper(c("assertion_type")), F.lit("")), *[F.when(m == k, F.lit(v)) for k, v in ASSERTIONS.items()], F.lit("OBSERVED"))
    units = good.withColumn("_id", F.when(first, F.col("_id")).otherwise(derived)).select(
        F.col("_id").alias("evidence_id"), "video_id", "ordinal", m.alias("modality"), start.alias("start_s"), end.alias("end_s"), F.col("_status").alias("timestamp_status"), frames.alias("frame_indices"), native.alias("source_text_native"),
        c("subject").alias("subject"), c("predicate").alias("predicate"), "value", c("content_en").alias("content_en"), confidence.alias("confidence"), assertion.alias("assertion_type"), temporal_scope(m, words, F.col("temporal_scope")).alias("temporal_scope"),
        scope.alias("assertion_scope"), F.when(m == "visual", role).alias("action_role"), *keep,
    )
    return units, df.filter("refused IS NOT NULL").select(*raw.columns, "refused")


def source_capabilities(units: DataFrame) -> DataFrame:
    """Per video: whether anything is said, and whether all that is said has a time."""
    said = F.col("modality") == "asr"
    timed = (F.col("timestamp_status") != "unavailable") & F.col("start_s").isNotNull() & F.col("end_s").isNotNull()
    any_said = F.coalesce(F.max(said), F.lit(False))
    return units.groupBy("video_id").agg(any_said.alias("spoken_claim_extraction"), any_said.alias("cross_modal_semantics"), (any_said & F.coalesce(F.min(F.when(said, timed)), F.lit(False))).alias("asr_temporal_order"))


def capability_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CAPABILITIES), "task_type string, task_subtype string, _level string, _operator string")


def normalized_subtype(df: DataFrame) -> DataFrame:
    """df with task_subtype in its domain: an operator's name stands for its capability; null where neither fits. The table has 39 rows."""
    table = capability_table(df.sparkSession)
    names = table.select("task_type", F.col("task_subtype").alias("_as"), F.col("task_subtype").alias("_is")).unionByName(table.select("task_type", F.col("_operator").alias("_as"), F.col("task_subtype").alias("_is")))
    return df.withColumn("_as", F.upper(text.normalize_blanks(F.col("task_subtype")))).join(F.broadcast(names), ["task_type", "_as"], "left").withColumn("task_subtype", F.col("_is")).drop("_as", "_is")


def found_refs(df: DataFrame, key: str, ids: str, targets: DataFrame, target_id: str, prefix: str) -> DataFrame:
    """df with <prefix>_lost and <prefix>_other: references without a target, and with one of another video."""
    refs = df.select(key, "video_id", F.explode(F.array_distinct(ids)).alias("_ref")).join(targets.select(F.col(target_id).alias("_ref"), F.col("video_id").alias("_of")), "_ref", "left")
    facts = refs.groupBy(key).agg(F.count_if(F.col("_of").isNull()).alias(f"{prefix}_lost"), F.count_if(F.col("_of") != F.col("video_id")).alias(f"{prefix}_other"))
    return df.join(facts, key, "left")


def answer_text(gold: str) -> Column:
    """The answer in a map of gold values: the first of the known keys that is not blank, else all values."""
    tries = [F.nullif(text.clean(F.get_json_object(gold, f"$.{k}")), F.lit("")) for k in ("answer", "value", "description", "explanation", "mechanism")]
    return F.coalesce(*tries, values_text(gold))


def values_text(gold: str) -> Column:
    """All values of a JSON object of texts, joined by blanks."""
    return F.array_join(F.filter(F.transform(F.map_values(F.from_json(gold, "map<string,string>")), text.clean), lambda x: x != ""), " ")


def common_issues(level: Column) -> list[tuple[str, Column]]:
    """Rules that proposals and items share; columns as checked_items leaves them."""
    empty = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0
    more = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    return [
        ("UNKNOWN_TASK_SUBTYPE", level.isNull()),
        ("EVIDENCE_NOT_FOUND", F.col("n_missing") > 0),
        ("EVIDENCE_VIDEO_MISMATCH", F.col("n_foreign") > 0),
        ("CAPABILITY_SUBTYPE_MISMATCH", F.upper(F.coalesce(F.nullif(text.clean(F.col("capability")), F.lit("")), F.col("task_subtype"))) != F.col("task_subtype")),
        ("INVALID_REASONING_OPERATOR", F.upper(text.clean(F.col("reasoning_operator"))) != F.col("_operator")),
        ("CUE_NOT_FOUND", more("cue_lost")),
        ("CUE_VIDEO_MISMATCH", more("cue_other")),
        ("RELATION_NOT_FOUND", more("relation_lost")),
        ("RELATION_VIDEO_MISMATCH", more("relation_other")),
        ("MISSING_COMMERCE_CUE", level.isin("CUE", "RELATION_OPTIONAL") & empty("commerce_cue_ids")),
        ("MISSING_COMMERCIAL_RELATION", level.isin("RELATION_REQUIRED", "RELATION_PATH_REQUIRED") & empty("commercial_relation_ids")),
        ("MISSING_COMMERCE_GRAPH_REF", (level == "CUE_OR_RELATION") & empty("commerce_cue_ids") & empty("commercial_relation_ids")),
    ]


def checked_items(items: DataFrame, evidence: DataFrame, cues: DataFrame, relations: DataFrame, accepted: bool = True) -> DataFrame:
    """items with `issues` (code, severity), each code once.

    items: item_id, video_id, task_type, task_subtype, capability, reasoning_operator, evidence_ids, commerce_cue_ids, commercial_relation_ids, target, gold_value (JSON of
    texts), gold_tier, review_status. With accepted=False they are proposals, which only have the shared rules, least evidence (a warning) and modalities.
    """
    df = with_references(items, "item_id", "evidence_ids", evidence)
    df = found_refs(found_refs(df, "item_id", "commerce_cue_ids", cues, "cue_id", "cue"), "item_id", "commercial_relation_ids", relations, "relation_id", "relation")
    df = df.join(F.broadcast(capability_table(items.sparkSession)), ["task_type", "task_subtype"], "left")
    task, answer, blob = F.col("task_type"), answer_text("gold_value"), F.lower(values_text("gold_value"))
    least = F.when(task == "BP", 1).otherwise(2)
    found = [(code, "ERROR", when) for code, when in common_issues(F.col("_level"))]
    few = (F.size("evidence_ids") if not accepted else F.col("n_refs")) < least
    diverse = ("CM_MODALITY_DIVERSITY", "ERROR", (task == "CM") & (F.size("modalities") < 2))
    if not accepted:
        found += [("INSUFFICIENT_EVIDENCE", "WARNING", few), diverse]
    else:
        longest = F.coalesce(*[F.when(task == t, F.lit(n)) for t, n in LONGEST.items()])
        relation = F.upper(text.clean(F.get_json_object("gold_value", "$.relation")))
        tier = F.col("gold_tier")
        firm = tier.isin("Gold-A", "Gold-B")
        found += [
            ("INTERNAL_ID_LEAKAGE", "ERROR", F.concat_ws(" ", "target", blob).rlike(INTERNAL_ID)),
            ("GOLD_ANSWER_TOO_LONG", "ERROR", F.regexp_count(answer, F.lit(WORD)) > longest),
            ("CLAIM_SCOPE_PROMOTION", "ERROR", F.array_contains("scopes", "CONDITIONAL") & ~mentions(F.concat(F.lit(" "), F.lower(answer), F.lit(" ")), CONDITIONS)),
            ("INSUFFICIENT_EVIDENCE", "ERROR", few & firm),
            ("INSUFFICIENT_EVIDENCE", "WARNING", few & ~F.coalesce(firm, F.lit(False))),
            ("OBSERVATION_INFERENCE_MIXED", "ERROR", (task == "BP") & mentions(blob, INFERENCES)),
            diverse,
            ("INVALID_GOLD_VALUE", "ERROR", (task == "CM") & (relation != "") & ~relation.isin(*CLAIM_STATES)),
            ("UNSUPPORTED_CAUSAL_CLAIM", "ERROR", mentions(blob, CAUSES)),
            ("PRIVATE_FIELD_LEAK", "ERROR", nested.has_private_key(F.col("gold_value"))),
            ("INVALID_TIER", "ERROR", (tier == "Gold-A") & task.isin("SS", "AE") & (F.coalesce("review_status", F.lit("")) != "human_accepted")),
        ]
    return df.select(*items.columns, rules.issues(found).alias("issues"))


def question_specs(items: DataFrame, allow_candidates: bool = False, include_invalid: bool = False) -> DataFrame:
    """Specs of the items whose quality is DIRECT or INFERRED, with their issues; only good ones unless include_invalid.

    items: video_id, annotation_id, task_type, task_subtype, capability, reasoning_operator, question_intent, target, gold_value (JSON), evidence_refs,
    commerce_cue_ids, commercial_relation_ids, quality_status, review_status.
    """
    from .evidence import answer_type, spec_issues

    capability = F.upper(F.coalesce(F.nullif(text.clean(F.col("capability")), F.lit("")), text.clean(F.col("task_subtype"))))
    tries = [F.nullif(text.clean(F.get_json_object("gold_value", f"$.{k}")), F.lit("")) for k in ("answer", "value", "action", "relation", "usage_context", "label")]
    by_key = F.map_entries(F.from_json("gold_value", "map<string,string>"))
    fallback = F.get(F.array_sort(by_key), F.lit(0))["value"]
    answer = F.coalesce(*tries, text.clean(fallback))
    df = items.filter(F.upper(text.clean(F.col("quality_status"))).isin("DIRECT", "INFERRED")).withColumns({"capability": capability, "gold_answer": answer, "lifecycle_status": F.lower(text.clean(F.col("review_status")))})
    df = df.withColumn("answer_type", answer_type(F.col("task_type"), F.col("gold_answer"))).withColumn("issues", spec_issues(allow_candidates))
    df = df.withColumn("spec_id", nested.content_id("spec", 12, video=F.col("video_id"), annotation=F.col("annotation_id"), capability=F.col("capability")))
    return df if include_invalid else df.filter(F.size("issues") == 0)


def translation_metrics(sources: list[tuple[DataFrame, str, str, str]], translations: DataFrame) -> DataFrame:
    """One row: share of source texts with a current translation, and translations that are stale.

    sources: (table, object type, id column, text column). The first translation (by `row_ord`) of an object's field counts: it is current when it is
    marked audit_only and has the text's digest.
    """
    wanted = None
    for df, kind, key, field in sources:
        part = df.select(F.lit(kind).alias("object_type"), text.clean(F.col(key)).alias("object_id"), F.lit(field).alias("source_field"), text.clean(F.col(field)).alias("_text")).filter("_text <> '' AND object_id <> ''")
        wanted = part if wanted is None else wanted.unionByName(part)
    of = ["object_id", "object_type", "source_field"]  # ids first: a sort looks at the others only where they are equal
    told = F.struct("audit_only", "source_sha256")
    given = translations.select(*[F.col(c).cast("string").alias(c) for c in of], told.alias("_t"), "row_ord")
    # both meet in one exchange; keys hardly repeat, so nothing is folded before it
    met = wanted.unionByName(given, allowMissingColumns=True).repartition(*of).groupBy(*of).agg(F.max("_text").alias("_text"), F.min_by("_t", "row_ord").alias("_t"))
    joined = met.filter("_text IS NOT NULL")
    current = F.coalesce(F.col("_t.audit_only") & (F.col("_t.source_sha256") == F.sha2("_text", 256)), F.lit(False))
    return joined.agg(aggregates.rounded_ratio(F.count_if(current), F.count(F.lit(1))).alias("audit_translation_coverage"), F.count_if(F.col("_t").isNotNull() & ~current).alias("audit_translation_stale_count"))


def share(when: Column) -> Column:
    return aggregates.rounded_ratio(F.count_if(when), F.count(F.lit(1)))


def broken_references(owners: list[tuple[str, DataFrame, dict[str, Column]]], targets: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """owner, row (any number), kind: a row for each reference without a target, or with one of another video.

    owners: (owner, table, ids by kind); targets: table and id column by kind. All references are one long table and meet all targets in one join; no group is made
    of those that hold.
    """
    refs = there = None
    for owner, df, ids in owners:
        numbered = df.select(F.monotonically_increasing_id().alias("row"), "video_id", F.array(*[F.struct(F.lit(kind).alias("kind"), c.alias("ids")) for kind, c in ids.items()]).alias("_ids"))
        part = numbered.select("row", "video_id", F.inline("_ids")).select(F.lit(owner).alias("owner"), "row", "video_id", "kind", F.explode(F.array_distinct("ids")).alias("ref"))
        refs = part if refs is None else refs.unionByName(part)
    for kind, (df, key) in targets.items():
        part = df.select(F.lit(kind).alias("kind"), F.col(key).alias("ref"), F.col("video_id").alias("_of"))
        there = part if there is None else there.unionByName(part)
    return refs.join(there, ["ref", "kind"], "left").filter(F.col("_of").isNull() | (F.col("_of") != F.col("video_id"))).select("owner", "row", "kind")


def audit_bank(videos: DataFrame, items: DataFrame, evidence: DataFrame, cues: DataFrame, relations: DataFrame, translations: DataFrame) -> DataFrame:
    """The 25 metrics of a bank as rows (metric, value).

    videos: video_id, n_abstentions, payload (JSON). items: as in checked_items, with question_intent and the order of the bank in item_id. References of all entities meet
    what they refer to in one join, and only counts are made of them; duplicates and conflicts compare task, capability, target and gold value within a video.
    """
    size = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>")))
    chinese = sum((text.contains_cjk(F.col(c)).cast("int") for c in ("target", "gold_value", "question_intent")), F.lit(0))
    cm, tier = F.col("task_type") == "CM", F.col("gold_tier")
    n_refs = F.when(F.col("item_id").isNotNull(), F.size(F.array_distinct("evidence_ids"))).otherwise(0)
    number = lambda c: F.count_if(c).cast("double")
    of_items = items.agg(
        F.count(F.lit(1)).cast("double").alias("item_count"), *[number(F.col("task_type") == t).alias(f"item_count_{t}") for t in LONGEST],
        *[number(tier == t).alias(f"item_count_{q}") for q, t in (("DIRECT", "Gold-A"), ("INFERRED", "Gold-B"), ("NEEDS_REVIEW", "Silver"), ("REJECTED", "Rejected"))],
        aggregates.rounded_ratio(F.count_if(cm & (n_refs >= 2)), F.count_if(cm)).alias("cross_modal_coverage"),
        share(tier == "Silver").alias("needs_review_rate"), share(F.col("review_status") == "human_accepted").alias("human_review_rate"),
        share((text.clean(F.col("capability")) != "") & (text.clean(F.col("reasoning_operator")) != "")).alias("capability_operator_coverage"), F.coalesce(F.sum(chinese), F.lit(0)).alias("_zh"),
    )
    alike = windows.conflict_counts(items, ["video_id", "task_type", "task_subtype", "target"], "gold_value", ["item_id"])
    of_groups = alike.select(aggregates.rounded_ratio(F.col("n_duplicate"), F.col("n")).alias("duplicate_rate"), aggregates.rounded_ratio(F.col("n_conflict"), F.col("n")).alias("conflict_rate"))
    # what each entity refers to at all, less what of it is broken
    cited = size("evidence_ids") > 0
    ended = (size("source_cue_ids") > 0) & (size("target_cue_ids") > 0)
    known = lambda df, key: df.filter(F.col(key).isNotNull())
    broken = broken_references([
        ("item", known(items, "item_id"), {"evidence": F.col("evidence_ids"), "cue": F.col("commerce_cue_ids"), "relation": F.col("commercial_relation_ids")}), ("cue", known(cues, "cue_id"), {"evidence": F.col("evidence_ids")}),
        ("relation", known(relations, "relation_id").filter(cited & ended), {"cue": F.concat("source_cue_ids", "target_cue_ids"), "evidence": F.col("evidence_ids")}),
    ], {"evidence": (evidence, "evidence_id"), "cue": (cues, "cue_id"), "relation": (relations, "relation_id")})
    one = lambda *when: F.coalesce(F.max(F.when(F.col("kind").isin(*when), 1)), F.lit(0))
    rows = broken.groupBy("row", "owner").agg(one("evidence").alias("evidence"), one("cue").alias("cue"), one("relation").alias("relation"), F.lit(1).alias("any"))
    lost = lambda owner, kind: F.count_if((F.col("owner") == owner) & (F.col(kind) == 1))
    losses = rows.agg(lost("item", "evidence").alias("_item"), lost("item", "cue").alias("_with_cue"), lost("item", "relation").alias("_with_relation"), lost("cue", "evidence").alias("_cue"), lost("relation", "any").alias("_relation"))
    asked = items.agg(F.count(F.lit(1)).alias("_items"), F.count_if(F.col("item_id").isNotNull() & cited).alias("_of_item"), F.count_if(size("commerce_cue_ids") > 0).alias("_of_cue"), F.count_if(size("commercial_relation_ids") > 0).alias("_of_relation"))
    asked = asked.crossJoin(cues.agg(F.count(F.lit(1)).alias("_cues"), F.count_if(F.col("cue_id").isNotNull() & cited).alias("_of_cues")))
    asked = asked.crossJoin(relations.agg(F.count(F.lit(1)).alias("_relations"), F.count_if(F.col("relation_id").isNotNull() & cited & ended).alias("_of_relations"))).crossJoin(losses)  # rows of one line
    held = lambda of, gone, total: aggregates.rounded_ratio(F.col(of) - F.col(gone), F.col(total))
    of_refs = asked.select(
        held("_of_item", "_item", "_items").alias("evidence_coverage"), held("_of_cue", "_with_cue", "_items").alias("commerce_cue_coverage"), held("_of_relation", "_with_relation", "_items").alias("commercial_relation_coverage"),
        held("_of_cues", "_cue", "_cues").alias("commerce_cue_evidence_validity"), held("_of_relations", "_relation", "_relations").alias("commercial_relation_validity"),
    )
    have = items.filter(F.col("task_type").isin("BP", "CM")).select("video_id", "task_type").distinct().groupBy("video_id").agg(F.count(F.lit(1)).alias("_have"))
    of_videos = videos.join(have, "video_id", "left").agg(
        F.count(F.lit(1)).cast("double").alias("video_count"), F.coalesce(F.sum("n_abstentions"), F.lit(0)).cast("double").alias("abstention_count"), number(F.coalesce("_have", F.lit(0)) < 2).alias("videos_missing_required_tasks"),
        number(nested.has_private_key(F.col("payload"))).alias("private_field_leakage"),
    )
    of_cues = cues.agg(F.count(F.lit(1)).cast("double").alias("commerce_cue_count"), F.count_if(text.contains_cjk(F.col("content_en"))).alias("_zh"))
    causal = F.upper("relation_type").isin("INCREASES_TRUST", "CAUSES_PURCHASE", "IMPROVES_CONVERSION") | mentions(F.col("rationale_en"), ("causes purchase", "improves conversion", "increases trust", "causes sales"))
    of_relations = relations.agg(
        F.count(F.lit(1)).cast("double").alias("commercial_relation_count"),
        share(F.upper(text.clean(F.col("provenance"))).isin("THEORY_DIRECT", "THEORY_OPERATIONALIZED", "BENCHMARK_OPERATIONAL")).alias("relation_provenance_validity"), number(causal).alias("causal_outcome_relation_count"),
        F.count_if(text.contains_cjk(F.col("rationale_en"))).alias("_zh"),
    )
    of_evidence = evidence.agg(F.count_if(text.contains_cjk(F.col("content_en"))).alias("_zh"))
    told = translation_metrics([(evidence, "evidence_unit", "evidence_id", "content_en"), (cues, "commerce_cue", "cue_id", "content_en"), (relations, "commercial_relation", "relation_id", "rationale_en")], translations)
    rows = None
    for one in (of_items, of_groups, of_refs, of_videos, of_cues, of_relations, of_evidence, told):
        long = one.select(*[F.col(c).cast("double").alias(c) for c in one.columns]).unpivot([], one.columns, "metric", "value")
        rows = long if rows is None else rows.unionByName(long)
    name = F.when(F.col("metric") == "_zh", "canonical_chinese_field_count").otherwise(F.col("metric"))

    return rows.groupBy(name.alias("metric")).agg(F.round(F.sum("value"), 6).alias("value"))


def diagnostic_slices(details: DataFrame, strata: DataFrame, resamples: int = 1000) -> DataFrame:
    """Scores by task, metric and stratum: count, mean and an interval. details: video_id, task_type, score; strata: video_id, metric, stratum."""
    scored = details.withColumn("score", numbers.parse_number(F.col("score").cast("string"))).filter("score IS NOT NULL")
    met = scored.withColumn("task_type", F.upper(text.clean(F.col("task_type")))).join(strata, "video_id")
    return aggregates.bootstrap_interval(met, ["task_type", "metric", "stratum"], "score", resamples)


def base_records(raw: DataFrame, numeric: dict[str, str], assets: DataFrame) -> DataFrame:
    """Raw sheet rows as typed base records.

    numeric renames columns that hold numbers; assets: video_id, video_paths, sales_paths. Followers come from the total, ten thousands or millions, the
    text length from its column or the text; genders, verification and buckets by fixed tables.
    """
    have = set(raw.columns)
    c = lambda name: F.col(f"`{name}`") if name in have else F.lit(None).cast("string")
    parsed = {new: numbers.parse_number(c(old)) for old, new in numeric.items()}
    gender = F.replace(text.clean(c("性别")), F.lit("/"), F.lit(""))
    label = F.when(gender.isin("女", "1"), "female").when(gender.isin("男", "0"), "male").otherwise("unknown")
    verified = text.clean(c("认证信息"))
    codes = {"1": "食品", "2": "服饰", "3": "家居家电", "4": "个护美妆", "5": "其他"}
    marks = {"food": "食品", "服饰": "服饰", "家居家电": "家居家电", "个护美妆": "个护美妆", "其他": "其他"}
    coded = lambda name: F.coalesce(*[F.when(text.clean(c(name)) == k, F.lit(v)) for k, v in codes.items()])
    bucket = F.coalesce(*[F.when(numbers.parse_number(c(k)) > 0, F.lit(v)) for k, v in marks.items()], coded("产品类型"), coded("product_type"), F.nullif(text.clean(c("商品分类")), F.lit("")), F.lit("未知"))
    followers = F.coalesce(numbers.parse_number(c("粉丝总数")), numbers.parse_number(c("粉丝数/w")) * 10_000.0, numbers.parse_number(c("粉丝数/ml")) * 1_000_000.0)
    body = text.clean(c("视频文本"))
    chars = F.coalesce(numbers.parse_number(c("视频文本总字符数")), F.when(body != "", F.length(body).cast("double")))
    duration = parsed.get("video_duration_s", F.lit(None).cast("double"))
    out = raw.select(
        text.clean(c("video_id")).alias("video_id"), text.clean(c("视频标题")).alias("title"), body.alias("video_text"), *[v.alias(k) for k, v in parsed.items()], label.alias("gender_clean"),
        F.when(label == "female", 1).when(label == "male", 0).alias("gender_code"), bucket.alias("product_bucket"), (~verified.isin("", "0", "-") & ~verified.contains("未认证")).alias("is_verified"), followers.alias("followers_total"),
        chars.alias("text_length"), numbers.ratio(chars, duration).alias("text_density"), numbers.duration_bucket(duration).alias("duration_bucket"),
    )
    both = joins.attach_or_empty(joins.attach_or_empty(out, assets, "video_id", "video_paths"), assets, "video_id", "sales_paths")
    return both.withColumn("has_video_asset", (F.size("video_paths") > 0).cast("int")).withColumn("has_sales_asset", (F.size("sales_paths") > 0).cast("int"))


def profile(records: DataFrame, segment: str = "fan_segment", bucket: str = "product_bucket") -> DataFrame:
    """Counts of a base table as rows (name, value): records, assets, and each bucket and segment."""
    counts = records.agg(F.count(F.lit(1)).alias("record_count"), F.sum("has_video_asset").alias("records_with_video_asset"), F.sum("has_sales_asset").alias("records_with_sales_asset"))
    out = counts.select(*[F.col(c).cast("bigint").alias(c) for c in counts.columns]).unpivot([], counts.columns, "name", "value")
    for kind in (bucket, segment):
        out = out.unionByName(records.groupBy(F.concat(F.lit(f"{kind}="), kind).alias("name")).agg(F.count(F.lit(1)).alias("value")))
    return out


def context_bundle(raw: DataFrame, domains: dict[str, DataFrame], key: str = "video_id") -> DataFrame:
    """Every raw row with one struct per domain (null where a domain lacks the row), without private columns.

    The audio domain takes video_text from the raw row or the text domain, the text domain title, product_title and video_text from the raw row, where theirs lack.
    """
    base = nested.public(raw)
    out = base.select(key, F.struct(*base.columns).alias("raw"))
    for name, df in domains.items():
        kept = nested.public(df)
        out = out.join(kept.select(key, F.struct(*[c for c in kept.columns if c != key]).alias(name)), key, "left")

    def filled(domain: str, fields: list[str], more: str | None = None) -> Column:
        have = nested.public(domains[domain]).columns
        own = [F.col(f"{domain}.{c}").alias(c) for c in have if c != key and c not in fields]
        for f in fields:
            tries = [F.col(f"{domain}.{f}")] if f in have else []
            tries += [F.col(f"raw.{f}")] if f in base.columns else []
            tries += [F.col(f"{more}.{f}")] if more and f in nested.public(domains[more]).columns else []
            own.append((F.coalesce(*tries) if tries else F.lit(None).cast("string")).alias(f))
        return F.struct(*own)

    if "audio" in domains:
        out = out.withColumn("audio", filled("audio", ["video_text"], "text" if "text" in domains else None))
    return out.withColumn("text", filled("text", ["title", "product_title", "video_text"])) if "text" in domains else out
