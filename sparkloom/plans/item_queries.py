"""Queries of the question bank on the driver tables, and their SQL twins: every event also stands for an item, a proposal and a raw record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from ..sources.scans import table
from ..sources.sinks import cut
from . import graph_queries as graph
from . import items, pipelines
from .graph_oracles import BASE, choice, joined
from .graph_queries import TASKS, divides, name, pick

SUBTYPES = ("PRICE_AND_DISCOUNT", "PARTIAL_SUPPORT", "FEATURE_BENEFIT", "PRICE_UNCERTAINTY")
OPERATORS = ("EXTRACT_OFFER", "DECOMPOSE_CLAIM", "MAP_FEATURE_TO_BENEFIT", "TRACE_PRICE_CONCERN")
ANSWERS = ("it costs 9", "probably cheap if asked", "sales went up", "a cup " * 26, "The price is conditional", "抢")
TIERS = ("Gold-A", "Gold-B", "Silver", "Rejected")


def bank(spark, d, kept=lambda units: units) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Evidence, cues, relations and items; some items break a rule."""
    evidence = kept(graph.units(spark, d))
    cues = graph.cues(evidence)
    relations = graph.relations(cues)
    n = F.col("event_id")
    subtype = F.when(divides(19), "NOPE").otherwise(pick(SUBTYPES, n))
    answer = F.concat(F.lit('{"answer": "'), F.trim(pick(ANSWERS, n)), F.lit('"'), F.when(divides(10), ', "relation": "odd"').otherwise(""), F.when(divides(41), ', "gmv": "1"').otherwise(""), F.lit("}"))
    made = cues.select(
        name("i", n).alias("item_id"), "event_id", "video_id", pick(TASKS, n).alias("task_type"), subtype.alias("task_subtype"), F.when(divides(3), "").when(divides(23), "OTHER").otherwise(F.lower(subtype)).alias("capability"),
        F.when(divides(5), "X").otherwise(F.lower(pick(OPERATORS, n))).alias("reasoning_operator"), "evidence_ids", F.when(divides(7), F.array().cast("array<string>")).when(divides(11), F.array(F.lit("zz"))).otherwise(F.array("cue_id")).alias("commerce_cue_ids"),
        F.when(n % 3 == 1, F.array().cast("array<string>")).when(divides(8), F.array(name("r", n), F.lit("rr"))).otherwise(F.array(name("r", n))).alias("commercial_relation_ids"), F.when(divides(37), "see cue_id").otherwise("the cup").alias("target"),
        answer.alias("gold_value"), pick(TIERS, F.floor(n / 4)).alias("gold_tier"), F.when(n % 8 < 5, "human_accepted").otherwise("auto").alias("review_status"), F.when(divides(9), "问").otherwise("why").alias("question_intent"),
    )
    return evidence, cues, relations, made


def told(issues: str = "issues"):
    return F.array_join(F.transform(issues, lambda x: F.concat_ws(":", x["code"], x["severity"])), ",").alias("codes")


def item_checks(spark, d):
    evidence, cues, relations, made = bank(spark, d)
    return items.checked_items(made, evidence, cues, relations).select("item_id", told())


def proposal_checks(spark, d):
    evidence, cues, relations, made = bank(spark, d)
    return items.checked_items(made, evidence, cues, relations, accepted=False).select("item_id", told())


def built_specs(spark, d):
    """Items as annotations, all of them with what keeps them from being compiled."""
    made = bank(spark, d)[3].withColumnsRenamed({"item_id": "annotation_id", "evidence_ids": "evidence_refs"}).withColumn("quality_status", pick(("direct", "INFERRED", "NEEDS_REVIEW"), F.col("event_id")))
    out = items.question_specs(made, include_invalid=True)
    return out.select("annotation_id", "capability", "gold_answer", "answer_type", F.array_join("issues", ",").alias("codes"))


def bank_audit(spark, d):
    """The metrics of the bank, with translations that are current, stale or not audited."""
    evidence, cues, relations, made = bank(spark, d, lambda units: cut(units, "units"))  # the window of each user is written once; the rest are columns of it
    n = F.col("event_id")
    payload = F.when(F.pmod(F.col("video_id").cast("bigint"), F.lit(9)) == 0, '{"sales": 3}').otherwise("{}")
    videos = table(spark, d, "events").select(F.col("user_id").cast("string").alias("video_id")).distinct().select("video_id", F.pmod(F.col("video_id").cast("bigint"), F.lit(3)).alias("n_abstentions"), payload.alias("payload"))
    digest = F.when(divides(4), "old").otherwise(F.sha2("content_en", 256))
    translations = evidence.select(F.lit("evidence_unit").alias("object_type"), F.col("evidence_id").alias("object_id"), F.lit("content_en").alias("source_field"), digest.alias("source_sha256"), (n % 5 != 0).alias("audit_only"), n.alias("row_ord"))
    return items.audit_bank(videos, made, evidence, cues, relations, translations)


def normalized_units(spark, d):
    """Events as raw evidence of many forms: typed units, or why refused."""
    n, e = F.col("event_id"), table(spark, d, "events")
    raw = e.select(
        F.col("user_id").cast("string").alias("video_id"), n.alias("ordinal"), F.when(divides(6), F.concat(F.col("user_id").cast("string"), F.lit("_visual_1"))).when(divides(4), F.concat(F.lit("frame_"), (n % 50).cast("string"))).alias("evidence_id"),
        pick(("Image", "speech", "", "ocr", "text", "smell", "visual"), n).alias("modality"), pick(("OBSERVED", "SPOKEN_CLAIM", ""), n).alias("assertion_type"), pick(("", "observed-fact", "N/A", "conditional"), n).alias("assertion_scope"),
        pick(("", "background-handling", "strange"), n).alias("action_role"), F.when(divides(5), "full_video").alias("temporal_scope"), F.when(n % 3 == 0, F.array(F.lit(2))).alias("frame_indices"), F.when(n % 2 == 0, F.lit(" said  by asr ")).alias("source_text_native"),
        F.lit("user").alias("subject"), F.when(~divides(17), F.lit("did")).alias("predicate"), F.col("event_type").alias("value"), pick(("It lasts two days", "She holds the cup", "He measures it", "You should buy", "", "tears open the bag"), n).alias("content_en"),
        (n % 4).cast("double").alias("start_s"), F.lit(2.0).alias("end_s"), F.when(n % 2 == 0, "Aligned").alias("timestamp_status"), pick(("high", "0.4", "80", "none", "very low"), n).alias("confidence"),
    )
    units, refused = items.normalized_evidence(raw)
    shown = units.select("ordinal", "modality", F.col("evidence_id").startswith("ev_").alias("derived"), "start_s", "timestamp_status", F.array_join(F.transform("frame_indices", lambda x: x.cast("string")), ",").alias("frames"), "source_text_native", "confidence", "assertion_type", "temporal_scope", "assertion_scope", "action_role", F.lit("").alias("refused"))
    return shown.unionByName(refused.select("ordinal", "refused"), allowMissingColumns=True)


def capabilities_of_users(spark, d):
    e = graph.units(spark, d).withColumns({"timestamp_status": F.when(divides(50), "unavailable").otherwise("ok"), "start_s": F.lit(1.0), "end_s": F.when(~divides(70), F.lit(2.0))})
    return items.source_capabilities(e)


def subtype_names(spark, d):
    """Orders with a capability, an operator's name or neither: the capability."""
    o, n = table(spark, d, "orders"), F.col("o_orderkey")
    made = o.select("o_orderkey", pick(TASKS, n).alias("task_type"), F.when(n % 3 == 0, F.lower(pick(SUBTYPES, n))).when(n % 3 == 1, pick(OPERATORS, n)).otherwise(pick(SUBTYPES, n + 1)).alias("task_subtype"))
    return items.normalized_subtype(made).select("o_orderkey", "task_subtype")


def placeholder_flags(spark, d):
    t = table(spark, d, "conversations").withColumn("i", F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)))
    said = F.when(F.col("i") == 0, " Specific  supported claim").when(F.col("i") == 1, F.concat(F.lit("<"), "text", F.lit("> "))).otherwise(F.col("text"))
    return t.select("conv_id", "turn", items.is_placeholder(said).alias("placeholder"))


def score_slices(spark, d):
    """Labels as scores by language, sliced by each source's bands of events (count and mean; the interval is tested by itself)."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    details = docs.select(F.col("source").alias("video_id"), F.upper("lang").alias("task_type"), F.col("doc_id").alias("vqa_id"), F.when(F.col("doc_id") % 10 > 0, F.col("quality")).alias("score"))
    strata = docs.groupBy(F.col("source").alias("video_id")).agg(F.count(F.lit(1)).alias("n")).select("video_id", F.explode(F.array(F.lit("likes"), F.lit("shares"))).alias("metric"), F.when(F.col("n") % 2 == 0, "low").otherwise("high").alias("stratum"))
    return items.diagnostic_slices(details, strata).select("task_type", "metric", "stratum", "n", F.col("mean").alias("mean_score"))


RAW = {"时长": "video_duration_s", "点赞": "n_likes"}


def base(spark, d) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    raw = c.select(
        k.cast("string").alias("video_id"), F.col("c_name").alias("视频标题"), F.when(k % 3 > 0, F.col("c_mktsegment")).alias("视频文本"), F.when(k % 4 == 0, "12.5").alias("视频文本总字符数"), F.when(k % 5 > 0, (k % 150).cast("string")).alias("时长"), F.lit("1,200").alias("点赞"),
        pick(("女", "男", "1", "/0", "-", "x"), k).alias("性别"), pick(("已认证", "0", "未认证", "-", ""), k).alias("认证信息"), F.when(k % 7 == 0, "1").alias("food"), F.when(k % 2 == 0, "3").otherwise("9").alias("产品类型"), F.when(k % 11 == 0, "书").alias("商品分类"),
        F.when(k % 3 == 0, "5000").alias("粉丝总数"), F.when(k % 3 == 1, "2.5").alias("粉丝数/w"), F.when(k % 6 == 2, "0.1").alias("粉丝数/ml"),
    )
    assets = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("video_id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("video_paths"), F.array_sort(F.collect_set("o_orderstatus")).alias("sales_paths"))
    return items.base_records(raw, RAW, assets)


def base_records(spark, d):
    b = base(spark, d)
    return b.select("video_id", "title", "text_length", "n_likes", "gender_clean", "gender_code", "product_bucket", "is_verified", "followers_total", F.round("text_density", 6).alias("text_density"), "duration_bucket", F.size("video_paths").alias("n_videos"), "has_sales_asset")


def base_profile(spark, d):
    b = pipelines.follower_segments(base(spark, d), "followers_total")
    return items.profile(b)


def context_domains(spark, d):
    """Documents with five other domains; texts and titles fall back to the raw row."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    raw = docs.select(k.cast("string").alias("video_id"), F.col("source").alias("title"), F.col("lang").alias("product_title"), F.md5("text").alias("video_text"), F.lit(5).alias("Likes"))
    labels = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("video_id"), "quality", F.lit(1).alias("sales"))
    words = docs.select(k.cast("string").alias("video_id"), F.when(k % 2 == 0, "own").alias("title"), F.col("n_chars").alias("chars"))
    out = items.context_bundle(raw, {"visual": labels, "audio": words.select("video_id", "chars"), "text": words, "publish": labels.select("video_id"), "cross": words.select("video_id", "chars")})
    return out.select("video_id", "raw.product_title", "visual.quality", F.col("audio.video_text").alias("spoken"), "text.title", F.col("text.video_text").alias("body"), F.col("cross.chars").alias("n_cross"))


ALL = (item_checks, proposal_checks, built_specs, bank_audit, normalized_units, capabilities_of_users, subtype_names, placeholder_flags, score_slices, base_records, base_profile, context_domains)

ITEMS = f"""{BASE}, it AS (SELECT f.*, c.video_id, e % 4 AS q, CASE WHEN e % 19 = 0 THEN 'NOPE' ELSE {choice(SUBTYPES, "e")} END AS sub, {choice(tuple(a.strip() for a in ANSWERS), "e")} AS answer,
  {choice(TIERS, "(e // 4)")} AS tier, CASE WHEN e % 8 < 5 THEN 'human_accepted' ELSE 'auto' END AS review, CASE WHEN e % 7 = 0 THEN 0 WHEN e % 11 = 0 THEN 2 ELSE 1 END AS cues, CASE WHEN e % 3 = 1 THEN 0 WHEN e % 8 = 0 THEN 2 ELSE 1 END AS rels,
  coalesce(b.conditional, false) AS conditional
  FROM (SELECT *, event_id AS e FROM facts) f JOIN cu c USING (event_id) LEFT JOIN (SELECT r.event_id, bool_or(v.scope = 'CONDITIONAL') AS conditional FROM refs r JOIN ev v ON r.ref = v.evidence_id GROUP BY 1) b USING (event_id))"""
SHARED = (
    ("UNKNOWN_TASK_SUBTYPE:ERROR", "sub = 'NOPE'"),
    ("EVIDENCE_NOT_FOUND:ERROR", "n_missing > 0"),
    ("EVIDENCE_VIDEO_MISMATCH:ERROR", "n_foreign > 0"),
    ("CAPABILITY_SUBTYPE_MISMATCH:ERROR", "e % 3 <> 0 AND e % 23 = 0"),
    ("INVALID_REASONING_OPERATOR:ERROR", "sub <> 'NOPE' AND e % 5 = 0"),
    ("CUE_NOT_FOUND:ERROR", "cues = 2"),
    ("RELATION_NOT_FOUND:ERROR", "rels = 2"),
    ("MISSING_COMMERCE_CUE:ERROR", "sub <> 'NOPE' AND q = 0 AND cues = 0"),
    ("MISSING_COMMERCIAL_RELATION:ERROR", "sub <> 'NOPE' AND q IN (1, 2) AND rels = 0"),
    ("MISSING_COMMERCE_GRAPH_REF:ERROR", "sub <> 'NOPE' AND q = 3 AND cues = 0 AND rels = 0"),
)
FEW = "n_refs < CASE WHEN q = 0 THEN 1 ELSE 2 END"
CODES = joined(
    *SHARED,
    ("INTERNAL_ID_LEAKAGE:ERROR", "e % 37 = 0"),
    ("GOLD_ANSWER_TOO_LONG:ERROR", "e % 6 = 3"),
    ("CLAIM_SCOPE_PROMOTION:ERROR", "conditional AND e % 6 NOT IN (1, 4)"),
    ("INSUFFICIENT_EVIDENCE:ERROR", f"{FEW} AND tier IN ('Gold-A', 'Gold-B')"),
    ("INSUFFICIENT_EVIDENCE:WARNING", f"{FEW} AND tier NOT IN ('Gold-A', 'Gold-B')"),
    ("OBSERVATION_INFERENCE_MIXED:ERROR", "q = 0 AND e % 6 = 1"),
    ("CM_MODALITY_DIVERSITY:ERROR", "q = 1 AND n_modes < 2"),
    ("INVALID_GOLD_VALUE:ERROR", "q = 1 AND e % 10 = 0"),
    ("UNSUPPORTED_CAUSAL_CLAIM:ERROR", "e % 6 = 2"),
    ("PRIVATE_FIELD_LEAK:ERROR", "e % 41 = 0"),
    ("INVALID_TIER:ERROR", "tier = 'Gold-A' AND q IN (2, 3) AND review = 'auto'"),
)
SPEC_CODES = joined(
    ("LIFECYCLE_NOT_COMPILABLE", "review = 'auto'"),
    ("INSUFFICIENT_TASK_EVIDENCE", FEW),
    ("MISSING_COMMERCIAL_RELATION", "q IN (1, 2) AND rels = 0"),
    ("MISSING_COMMERCE_GRAPH_REF", "q = 3 AND rels = 0 AND cues = 0"),
)
UNIT = """
WITH r AS (SELECT event_id AS n, CAST(user_id AS VARCHAR) AS video, event_type AS value, ['Image', 'speech', '', 'ocr', 'text', 'smell', 'visual'][CAST(event_id % 7 + 1 AS INTEGER)] AS named, ['OBSERVED', 'SPOKEN_CLAIM', ''][CAST(event_id % 3 + 1 AS INTEGER)] AS said,
  event_id % 3 = 0 AS framed, event_id % 2 = 0 AS native, ['It lasts two days', 'She holds the cup', 'He measures it', 'You should buy', '', 'tears open the bag'][CAST(event_id % 6 + 1 AS INTEGER)] AS content FROM events),
m AS (SELECT *, CASE named WHEN 'Image' THEN 'visual' WHEN 'speech' THEN 'asr' WHEN 'ocr' THEN 'ocr' WHEN 'visual' THEN 'visual' WHEN 'smell' THEN 'metadata'
  WHEN 'text' THEN CASE WHEN native THEN 'asr' ELSE 'metadata' END ELSE CASE WHEN said = 'OBSERVED' AND framed THEN 'visual' WHEN said = 'SPOKEN_CLAIM' AND native AND NOT framed THEN 'asr' ELSE 'metadata' END END AS mode FROM r),
s AS (SELECT *, CASE WHEN mode = 'asr' AND NOT native THEN NULL ELSE CAST(n % 4 AS DOUBLE) END AS start, n % 6 = 0 AND mode = 'visual' AS own,
  CASE WHEN n % 17 = 0 THEN 'MISSING_FIELD' WHEN NOT (mode = 'asr' AND NOT native) AND n % 4 > 2 THEN 'START_AFTER_END' WHEN n % 5 = 3 THEN 'NO_CONFIDENCE' ELSE '' END AS refused FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY video, own, refused = '' ORDER BY n) AS k,
  CASE n % 6 WHEN 3 THEN 'INSTRUCTION' ELSE CASE WHEN mode = 'asr' THEN 'SPOKEN_CLAIM' ELSE 'OBSERVED_FACT' END END AS inferred,
  CASE n % 6 WHEN 1 THEN 'BACKGROUND_HANDLING' WHEN 2 THEN 'FUNCTIONAL_OPERATION' WHEN 5 THEN 'PRODUCT_INSPECTION' END AS role FROM s),
c AS (SELECT *, CASE n % 4 WHEN 1 THEN 'OBSERVED_FACT' WHEN 3 THEN 'CONDITIONAL' ELSE inferred END AS scope FROM o)
"""
ORACLES = {
    "item_checks": f"{ITEMS} SELECT 'i' || e AS item_id, {CODES} AS codes FROM it",
    "proposal_checks": f"""{ITEMS} SELECT 'i' || e AS item_id, {joined(*SHARED, ("INSUFFICIENT_EVIDENCE:WARNING", FEW), ("CM_MODALITY_DIVERSITY:ERROR", "q = 1 AND n_modes < 2"))} AS codes FROM it""",
    "built_specs": f"""{ITEMS} SELECT 'i' || e AS annotation_id, CASE WHEN e % 3 = 0 THEN sub WHEN e % 23 = 0 THEN 'OTHER' ELSE sub END AS capability, answer AS gold_answer,
  CASE q WHEN 0 THEN CASE WHEN e % 6 = 0 THEN 'numeric_fact' ELSE 'short_fact' END WHEN 1 THEN 'relation_explanation' WHEN 2 THEN 'commercial_reasoning' ELSE 'bounded_need_reasoning' END AS answer_type, {SPEC_CODES} AS codes FROM it WHERE e % 3 < 2""",
    "bank_audit": f"""{ITEMS}, z AS (SELECT *, 'k' || q || sub || (e % 37 = 0) AS target, answer || (e % 10 = 0) || (e % 41 = 0) AS gold FROM it),
w AS (SELECT *, n_refs > 0 AND n_missing = 0 AND n_foreign = 0 AS whole_refs, row_number() OVER (PARTITION BY video_id, target, gold ORDER BY 'i' || e) > 1 AS dup, first(gold) OVER (PARTITION BY video_id, target ORDER BY 'i' || e) <> gold AS clash FROM z),
i AS (SELECT count(*)::DOUBLE AS item_count, count(*) FILTER (WHERE q = 0)::DOUBLE AS "item_count_BP", count(*) FILTER (WHERE q = 1)::DOUBLE AS "item_count_CM", count(*) FILTER (WHERE q = 2)::DOUBLE AS "item_count_SS", count(*) FILTER (WHERE q = 3)::DOUBLE AS "item_count_AE",
  count(*) FILTER (WHERE tier = 'Gold-A')::DOUBLE AS "item_count_DIRECT", count(*) FILTER (WHERE tier = 'Gold-B')::DOUBLE AS "item_count_INFERRED", count(*) FILTER (WHERE tier = 'Silver')::DOUBLE AS "item_count_NEEDS_REVIEW", count(*) FILTER (WHERE tier = 'Rejected')::DOUBLE AS "item_count_REJECTED",
  avg(whole_refs::INT) AS evidence_coverage, count(*) FILTER (WHERE q = 1 AND n_refs >= 2) / count(*) FILTER (WHERE q = 1)::DOUBLE AS cross_modal_coverage, avg(dup::INT) AS duplicate_rate, avg(clash::INT) AS conflict_rate, avg((tier = 'Silver')::INT) AS needs_review_rate, avg((review = 'human_accepted')::INT) AS human_review_rate,
  avg((cues = 1)::INT) AS commerce_cue_coverage, avg((rels = 1)::INT) AS commercial_relation_coverage, avg((e % 3 <> 0)::INT) AS capability_operator_coverage FROM w),
v AS (SELECT count(*)::DOUBLE AS video_count, sum(user_id % 3)::DOUBLE AS abstention_count, count(*) FILTER (WHERE user_id % 9 = 0)::DOUBLE AS private_field_leakage, count(*) FILTER (WHERE kinds < 2)::DOUBLE AS videos_missing_required_tasks
  FROM (SELECT user_id, count(DISTINCT CASE WHEN event_id % 4 < 2 THEN event_id % 4 END) AS kinds FROM events GROUP BY 1)),
cc AS (SELECT count(*)::DOUBLE AS commerce_cue_count, avg((n_refs > 0 AND n_missing = 0 AND n_foreign = 0)::INT) AS commerce_cue_evidence_validity FROM facts),
rr AS (SELECT count(*)::DOUBLE AS commercial_relation_count, avg((t.cue_id IS NOT NULL AND t.video_id = r.video_id AND n_refs > 0 AND n_missing = 0 AND n_foreign = 0)::INT) AS commercial_relation_validity, 1.0::DOUBLE AS relation_provenance_validity,
  count(*) FILTER (WHERE r.event_id % 5 = 1)::DOUBLE AS causal_outcome_relation_count FROM rel r JOIN facts f USING (event_id) LEFT JOIN cu t ON r.target = t.cue_id),
zh AS (SELECT (SELECT count(*) FILTER (WHERE e % 6 = 5) + count(*) FILTER (WHERE e % 9 = 0) FROM it) + (SELECT count(*) FROM cu WHERE content = '网') + (SELECT count(*) FROM rel WHERE event_id % 5 = 2) AS n),
tr AS (SELECT (SELECT count(*) FROM ev) + (SELECT count(*) FROM cu WHERE content <> '') + (SELECT count(*) FROM rel WHERE event_id % 5 <> 3) AS wanted, (SELECT count(*) FROM ev WHERE event_id % 4 <> 0 AND event_id % 5 <> 0) AS current, (SELECT count(*) FROM ev) AS given),
l AS (UNPIVOT i ON COLUMNS(*) INTO NAME metric VALUE value UNION ALL UNPIVOT v ON COLUMNS(*) INTO NAME metric VALUE value UNION ALL UNPIVOT cc ON COLUMNS(*) INTO NAME metric VALUE value UNION ALL UNPIVOT rr ON COLUMNS(*) INTO NAME metric VALUE value)
SELECT metric, round(value, 6) AS value FROM l UNION ALL SELECT 'canonical_chinese_field_count', n::DOUBLE FROM zh UNION ALL SELECT 'audit_translation_coverage', round(current / wanted, 6) FROM tr UNION ALL SELECT 'audit_translation_stale_count', (given - current)::DOUBLE FROM tr""",
    "normalized_units": f"""{UNIT} SELECT n AS ordinal, mode AS modality, NOT (own AND k = 1) AS derived, start AS start_s, CASE WHEN native THEN 'aligned' ELSE 'unavailable' END AS timestamp_status,
  CASE WHEN framed THEN '2' WHEN n % 6 <> 0 AND n % 4 = 0 THEN CAST(n % 50 AS VARCHAR) ELSE '' END AS frames, CASE WHEN native THEN 'said by asr' WHEN mode IN ('asr', 'ocr') THEN value ELSE '' END AS source_text_native,
  CASE n % 5 WHEN 0 THEN 0.9 WHEN 1 THEN 0.4 WHEN 2 THEN 0.8 ELSE 0.25 END::DOUBLE AS confidence, CASE WHEN said <> '' THEN said WHEN mode = 'asr' THEN 'SPOKEN_CLAIM' WHEN mode = 'ocr' THEN 'OCR_TEXT' ELSE 'OBSERVED' END AS assertion_type,
  CASE WHEN mode = 'asr' AND n % 6 = 0 THEN 'LONG_TERM_CLAIM' WHEN n % 5 = 0 THEN 'FULL_VIDEO' WHEN mode IN ('visual', 'ocr') THEN 'FRAME' WHEN mode = 'asr' THEN 'SHORT_CLIP' ELSE 'UNSPECIFIED' END AS temporal_scope,
  CASE WHEN mode = 'asr' AND scope = 'OBSERVED_FACT' THEN inferred ELSE scope END AS assertion_scope, CASE WHEN mode = 'visual' THEN CASE WHEN role IN ('FUNCTIONAL_OPERATION', 'PRODUCT_INSPECTION') THEN role WHEN n % 3 = 1 THEN 'BACKGROUND_HANDLING' ELSE role END END AS action_role, '' AS refused FROM c WHERE refused = ''
UNION ALL SELECT n, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, refused FROM c WHERE refused <> ''""",
    "capabilities_of_users": """SELECT CAST(user_id AS VARCHAR) AS video_id, count(*) FILTER (WHERE asr) > 0 AS spoken_claim_extraction, count(*) FILTER (WHERE asr) > 0 AS cross_modal_semantics, count(*) FILTER (WHERE asr) > 0 AND count(*) FILTER (WHERE asr AND (event_id % 50 = 0 OR event_id % 70 = 0)) = 0 AS asr_temporal_order
FROM (SELECT *, event_type NOT IN ('view', 'click') AS asr FROM events) GROUP BY 1""",
    "subtype_names": f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN {choice(SUBTYPES, 'o_orderkey')} END AS task_subtype FROM orders",
    "placeholder_flags": "SELECT conv_id, turn, (conv_id + turn) % 4 < 2 OR (trim(text) LIKE '<%' AND trim(text) LIKE '%>') AS placeholder FROM conversations",
    "score_slices": """WITH j AS (SELECT * FROM documents JOIN labels USING (doc_id)), s AS (SELECT source, CASE WHEN count(*) % 2 = 0 THEN 'low' ELSE 'high' END AS stratum FROM j GROUP BY 1)
SELECT upper(lang) AS task_type, metric, stratum, count(*) AS n, round(avg(quality), 6) AS mean_score FROM j JOIN s USING (source), (SELECT unnest(['likes', 'shares']) AS metric) WHERE doc_id % 10 > 0 AND quality IS NOT NULL GROUP BY 1, 2, 3""",
    "base_records": """WITH c AS (SELECT c_custkey AS k, c_name, c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN 12.5 WHEN c_custkey % 3 > 0 THEN length(c_mktsegment) END::DOUBLE AS len, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 150 END::DOUBLE AS dur FROM customer),
o AS (SELECT o_custkey AS k, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1)
SELECT CAST(k AS VARCHAR) AS video_id, c_name AS title, len AS text_length, 1200.0::DOUBLE AS n_likes, CASE WHEN k % 6 IN (0, 2) THEN 'female' WHEN k % 6 IN (1, 3) THEN 'male' ELSE 'unknown' END AS gender_clean, CASE WHEN k % 6 IN (0, 2) THEN 1 WHEN k % 6 IN (1, 3) THEN 0 END AS gender_code,
  CASE WHEN k % 7 = 0 THEN '食品' WHEN k % 2 = 0 THEN '家居家电' WHEN k % 11 = 0 THEN '书' ELSE '未知' END AS product_bucket, k % 5 = 0 AS is_verified, CASE WHEN k % 3 = 0 THEN 5000.0 WHEN k % 3 = 1 THEN 25000.0 WHEN k % 6 = 2 THEN 100000.0 END::DOUBLE AS followers_total,
  round(len / nullif(dur, 0), 6) AS text_density, CASE WHEN dur IS NULL THEN 'unknown' WHEN dur <= 30 THEN '<=30' WHEN dur <= 60 THEN '<=60' WHEN dur <= 120 THEN '<=120' ELSE '>120' END AS duration_bucket, CAST(coalesce(n, 0) AS INTEGER) AS n_videos, CAST(n IS NOT NULL AS INTEGER) AS has_sales_asset FROM c LEFT JOIN o USING (k)""",
    "base_profile": """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN '食品' WHEN c_custkey % 2 = 0 THEN '家居家电' WHEN c_custkey % 11 = 0 THEN '书' ELSE '未知' END AS b, CASE WHEN c_custkey % 3 = 0 THEN 5000.0 WHEN c_custkey % 3 = 1 THEN 25000.0 WHEN c_custkey % 6 = 2 THEN 100000.0 END AS f, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has FROM customer),
q AS (SELECT quantile_cont(f, 0.25) AS a, quantile_cont(f, 0.5) AS m, quantile_cont(f, 0.75) AS z FROM c)
SELECT 'record_count' AS name, count(*) AS value FROM c UNION ALL SELECT 'records_with_video_asset', count(*) FILTER (WHERE has) FROM c UNION ALL SELECT 'records_with_sales_asset', count(*) FILTER (WHERE has) FROM c UNION ALL SELECT 'product_bucket=' || b, count(*) FROM c GROUP BY 1
UNION ALL SELECT 'fan_segment=' || CASE WHEN f IS NULL THEN 'unknown' WHEN f <= a THEN 'tail' WHEN f <= m THEN 'waist' WHEN f <= z THEN 'shoulder' ELSE 'head' END, count(*) FROM c, q GROUP BY 1""",
    "context_domains": """SELECT CAST(d.doc_id AS VARCHAR) AS video_id, lang AS product_title, quality, md5(text) AS spoken, CASE WHEN d.doc_id % 2 = 0 THEN 'own' ELSE source END AS title, md5(text) AS body, n_chars AS n_cross FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}
