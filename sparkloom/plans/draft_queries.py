"""Queries of raw drafts on the driver tables, and their SQL twins: every event stands for a raw cue, relation, proposal and annotation, every document for a record."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.scans import table
from ..sources.sinks import cut
from . import drafts
from . import graph_queries as graph
from .graph_oracles import BASE, choice
from .graph_queries import TASKS, divides, name, pick

GENERATORS = ("cm_proposer", "SS_Proposer ", "ae_proposer", "bp_proposer")
DRAFTED = ("CM", "SS", "ae", "BP")
SUBTYPES = ("DECOMPOSE_CLAIM", "feature_benefit", "TRACE_PRICE_CONCERN", "PRICE_AND_DISCOUNT")
TARGETS = ('{"claim": "it lasts"}', "{}", '{"b": {"c": "Specific  supported claim"}, "a": "x"}', '{"a": "网"}', '{"predicate": "the effect"}', '{"a": 1}', "no json")
REASONS = ("abstention", "BELOW_MIN_CONFIDENCE", "MODEL_PARSE_ERROR", "OTHER", "", "proposal_graph_validation_failed")


def drafted_cues(spark, d):
    """Typed cues or why refused; every fourth is said twice."""
    n, e = F.col("event_id"), graph.units(spark, d)
    raw = graph.cues(e).select(
        "video_id", n.alias("ordinal"), F.when(divides(23), "NOPE").otherwise(F.lower("cue_type")).alias("cue_type"), F.concat(F.lit("  "), "content_en").alias("content_en"), F.lit(None).cast("string").alias("source_text_native"), "evidence_ids",
        F.when(~divides(31), "Inferred").alias("directness"), F.lit(None).cast("string").alias("extractor"), F.when(divides(2), "high").otherwise("80").alias("confidence"),
        F.when(n % 5 < 3, "none").otherwise("spoken-claim").alias("assertion_scope"), F.lower("action_role").alias("action_role"),
    )
    good, refused = drafts.normalized_cues(raw.unionByName(raw.filter("ordinal % 4 = 0").withColumn("ordinal", F.col("ordinal") + 10**9)), e)
    shown = good.select("ordinal", "cue_type", "content_en", F.size("evidence_ids").alias("n_evidence"), "directness", "confidence", "assertion_scope", "action_role", F.lit("").alias("refused"))
    return shown.unionByName(refused.select("ordinal", "refused"), allowMissingColumns=True)


def drafted_relations(spark, d):
    """Typed relations of the graph's cues or why refused."""
    e = cut(graph.units(spark, d), "units")
    cues = cut(graph.cues(e), "cues")
    raw = graph.relations(cues).withColumns({
        "ordinal": F.substring("relation_id", 2, 20).cast("bigint"), "directness": F.lit(""), "extractor": F.lit(""), "confidence": F.lit("none"), "assertion_scope": F.lit(None).cast("string"), "evidence_ids": F.array(F.get("evidence_ids", F.lit(0)), F.lit(" ")),
    })
    good, refused = drafts.normalized_relations(raw, cues, e)
    shown = good.select("ordinal", "relation_type", F.size("evidence_ids").alias("n_evidence"), "provenance", "status", "directness", "confidence", "assertion_scope", F.lit("").alias("refused"))
    return shown.unionByName(refused.select("ordinal", "refused"), allowMissingColumns=True)


def drafted_proposals(spark, d):
    """Typed proposals, with the evidence and edges of the cues and relations they cite, or why refused."""
    n, e = F.col("event_id"), cut(graph.units(spark, d), "units")
    cues = cut(graph.cues(e), "cues")
    none = F.array().cast("array<string>")
    edges = F.array(F.array(F.lit("a"), F.lit(" b  c"), F.lit("d"), F.lit("e")), F.array(F.lit("a")))
    raw = e.select(
        "video_id", n.alias("ordinal"), pick(GENERATORS, n).alias("generator"), F.when(divides(27), "CM").otherwise(pick(DRAFTED, n)).alias("task_type"), F.when(divides(29), "NOPE").otherwise(pick(SUBTYPES, n)).alias("task_subtype"),
        pick(TARGETS, F.floor(n / 4)).alias("target"), F.when(divides(30), "{}").otherwise('{"answer": "yes"}').alias("proposed_gold"),
        F.when(divides(5), none).when(divides(26), F.array(F.lit("c0x"))).otherwise(F.array(name("c", n), name("c", n), F.lit(""))).alias("commerce_cue_ids"),
        F.when(divides(3), F.array(name("r", n))).otherwise(none).alias("commercial_relation_ids"), F.array(F.lit("zz"), F.col("evidence_id")).alias("evidence_ids"), edges.alias("reasoning_edges"),
        F.when(divides(2), "why  so").alias("question_intent"), F.when(divides(7), F.array(F.lit("none of it"))).alias("forbidden_inferences"), F.lit("").alias("assertion_scope"), F.when(divides(9), "own").otherwise("None").alias("proposal_id"),
    )
    relations = graph.relations(cues).withColumn("assertion_scope", F.lit("OBSERVED_FACT"))
    good, refused = drafts.normalized_proposals(raw, cues, relations, e)
    shown = good.select(
        "ordinal", (F.col("proposal_id") == "own").alias("own_id"), "source_agent", "task_type", "task_subtype", "reasoning_operator", F.size("evidence_ids").alias("n_evidence"), F.size("reasoning_edges").alias("n_edges"),
        F.get(F.get("reasoning_edges", F.lit(0)), F.lit(1)).alias("said"), "question_intent", F.size("forbidden_inferences").alias("n_forbidden"), "assertion_scope", F.lit("").alias("refused"),
    )
    return shown.unionByName(refused.select("ordinal", "refused"), allowMissingColumns=True)


def risky_annotations(spark, d):
    """Annotations with the codes of their risks."""
    n, e = F.col("event_id"), graph.units(spark, d)
    evidence = e.withColumns({"text_span": F.when(divides(12), "[3, 4]"), "timestamp_status": F.when(divides(2), "Unavailable").otherwise("ok"), "start_s": F.when(~divides(5), F.lit(1.0)), "end_s": F.lit(None).cast("double")})
    made = graph.cues(e).select(
        name("a", n).alias("annotation_id"), "video_id", pick(TASKS, n).alias("task_type"), pick(TARGETS, F.floor(n / 4)).alias("target"), F.when(divides(7), '{"relation": "r"}').alias("gold_value"), F.col("evidence_ids").alias("evidence_refs"),
        F.when(divides(10), F.array(F.lit("17"))).alias("source_proposal_ids"),
    )
    return drafts.annotation_risks(made, evidence).select("annotation_id", F.array_join("risks", ",").alias("codes"))


def review_buckets(spark, d):
    """Events as refused rows by their queue."""
    e = table(spark, d, "events")
    texts = lambda when, *values: F.when(when, F.array(*[F.lit(v) for v in values]))
    rows = e.withColumns({
        "audit_bucket": F.when(divides(41), "held"), "item_type": F.when(divides(13), "Abstention").otherwise(F.col("event_type")), "reason_code": pick(REASONS, F.col("event_id")), "stage": F.when(divides(11), "commerce_cue_extraction"),
        "resolution_status": F.when(divides(17), "Unresolved"), "issue_codes": texts(divides(19), "OTHER", "missing_commercial_relation"), "risk_codes": F.coalesce(texts(divides(14), "NUMERIC_PROPOSAL_ID"), texts(divides(7), "NUMERIC_PROPOSAL_ID", "LOW_JUDGE_SCORE")),
    })
    return rows.groupBy(drafts.review_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def localized(spark, d):
    n = F.col("doc_id")
    docs = table(spark, d, "documents")
    context = lambda prefix, key, words, value: F.struct(name(prefix, n).alias(key), value.alias(words))
    records = docs.select(
        n.cast("string").alias("vqa_id"), F.col("source").alias("question"), F.when(n % 6 > 0, F.col("lang")).alias("gold_answer"), F.array(context("e", "evidence_id", "content_en", F.col("text")), context("f", "evidence_id", "content_en", F.lit(" "))).alias("evidence"),
        F.when(n % 3 > 0, F.array(context("c", "cue_id", "content_en", F.col("source")))).alias("commerce_cues"), F.array(context("r", "relation_id", "rationale_en", F.lit("fits"))).alias("commercial_relations"),
    )
    told = lambda kind, key, field, words, old: docs.select(F.lit(kind).alias("object_type"), key.alias("object_id"), F.lit(field).alias("source_field"), F.when(n % old == 0, "old").otherwise(F.sha2(F.trim(words), 256)).alias("source_sha256"), F.concat(F.lit("zh "), name("", n)).alias("translated_text"), n.alias("row_ord"))
    given = told("qa", n.cast("string"), "question", F.col("source"), 4).unionByName(told("evidence_unit", F.when(n % 7 > 0, name("e", n)).otherwise(name("lost", n)), "content_en", F.col("text"), 5)).unionByName(told("commerce_cue", name("c", n), "content_en", F.col("source"), 2))
    return drafts.localized_records(records, given)


def localized_records(spark, d):
    """Documents as records with translations that are there, stale or missing."""
    first = lambda c, f: F.get(c, F.lit(0))[f]
    return localized(spark, d)[0].select(
        "vqa_id", "question_zh", "question_status", "answer_status", first("evidence_zh", "translated").alias("evidence_text"), F.array_join(F.transform("evidence_zh", lambda x: x["status"]), ",").alias("evidence_status"),
        F.array_join(F.transform("commerce_cues_zh", lambda x: x["status"]), ",").alias("cue_status"), first("commercial_relations_zh", "status").alias("relation_status"),
    )


def localized_counts(spark, d):
    return localized(spark, d)[1]


ALL = (drafted_cues, drafted_relations, drafted_proposals, risky_annotations, review_buckets, localized_records, localized_counts)

# every reference of a cue in order, with what it refers to
CITED = f"""{BASE}, cited AS (SELECT event_id, video_id, evidence_id AS ref, 1 AS at FROM ev UNION ALL SELECT event_id, video_id, 'e' || nxt, 2 FROM ev WHERE nxt IS NOT NULL
  UNION ALL SELECT event_id, video_id, 'e' || (event_id + 1), 4 FROM ev WHERE event_id % 17 = 0),
src AS (SELECT c.event_id, min_by(v.scope, c.at) FILTER (WHERE v.scope <> 'OBSERVED_FACT') AS scope,
  min(CASE v.role WHEN 'OUTCOME_DEMONSTRATION' THEN 1 WHEN 'FUNCTIONAL_OPERATION' THEN 2 WHEN 'PRODUCT_INSPECTION' THEN 3 WHEN 'BACKGROUND_HANDLING' THEN 4 END) AS role FROM cited c JOIN ev v ON c.ref = v.evidence_id GROUP BY 1)"""
BROKEN_REFS = "WHEN n_missing > 0 THEN 'EVIDENCE_NOT_FOUND' WHEN n_foreign > 0 THEN 'EVIDENCE_VIDEO_MISMATCH'"
RULES = "['OFFER_REQUIRES_CONDITION', 'FEATURE_FRAMED_AS_BENEFIT', 'CLAIM_SUPPORTED_BY_DEMONSTRATION']"
DOCS = """WITH t AS (SELECT doc_id AS n, CAST(doc_id AS VARCHAR) AS vqa_id, CASE WHEN trim(source) = '' OR source IS NULL THEN 'not_applicable' WHEN doc_id % 4 = 0 THEN 'stale' ELSE 'current' END AS q,
  CASE WHEN doc_id % 6 = 0 OR lang IS NULL THEN 'not_applicable' ELSE 'missing' END AS a, CASE WHEN text IS NULL OR regexp_matches(text, '^\\s*$') THEN 'not_applicable' WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'stale' ELSE 'current' END AS e,
  CASE WHEN doc_id % 3 > 0 THEN CASE WHEN source IS NULL THEN 'not_applicable' WHEN doc_id % 2 = 0 THEN 'stale' ELSE 'current' END END AS c FROM documents)"""

ORACLES = {
    "drafted_cues": f"""{CITED}, r AS (SELECT f.event_id AS n, cue_type, trim(content) AS content, n_refs, cu.role AS own, src.scope, src.role, CASE WHEN f.event_id % 23 = 0 THEN 'UNKNOWN_CUE_TYPE' WHEN content = '' THEN 'MISSING_CONTENT'
  WHEN content = '网' THEN 'NON_ENGLISH_CONTENT' {BROKEN_REFS} ELSE '' END AS refused FROM cu JOIN facts f USING (event_id) JOIN src USING (event_id))
SELECT n AS ordinal, cue_type, content AS content_en, CAST(n_refs AS INTEGER) AS n_evidence, CASE WHEN n % 31 = 0 THEN 'DIRECT' ELSE 'INFERRED' END AS directness, CASE WHEN n % 2 = 0 THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence,
  CASE WHEN n % 5 >= 3 THEN 'SPOKEN_CLAIM' ELSE coalesce(scope, 'OBSERVED_FACT') END AS assertion_scope,
  coalesce(own, CASE WHEN content LIKE '%holds the%' THEN 'BACKGROUND_HANDLING' ELSE ['OUTCOME_DEMONSTRATION', 'FUNCTIONAL_OPERATION', 'PRODUCT_INSPECTION', 'BACKGROUND_HANDLING'][role] END) AS action_role, '' AS refused FROM r WHERE refused = ''
UNION ALL SELECT n + k, NULL, NULL, NULL, NULL, NULL, NULL, NULL, refused FROM r, (SELECT unnest([0, 1000000000]) AS k) WHERE refused <> '' AND (k = 0 OR n % 4 = 0)""",
    "drafted_relations": f"""{BASE}, ends AS (SELECT r.event_id, ref FROM rel r JOIN refs f USING (event_id) UNION SELECT r.event_id, ref FROM rel r JOIN cu t ON r.target = t.cue_id JOIN refs f ON f.event_id = t.event_id),
g AS (SELECT s.event_id, count(*) AS n_refs, count(*) FILTER (WHERE v.event_id IS NULL) AS n_missing, count(*) FILTER (WHERE v.video_id <> r.video_id) AS n_foreign FROM ends s JOIN rel r USING (event_id) LEFT JOIN ev v ON s.ref = v.evidence_id GROUP BY 1),
o AS (SELECT r.event_id AS n, kind, status, n_refs, c.fact AND t.fact AS fact, CASE WHEN kind = 'NO_SUCH' THEN 'UNKNOWN_RELATION_TYPE' WHEN target IS NULL THEN 'MISSING_ENDPOINT' WHEN t.cue_id IS NULL THEN 'CUE_NOT_FOUND' WHEN t.video_id <> r.video_id THEN 'CUE_VIDEO_MISMATCH' {BROKEN_REFS}
  WHEN r.event_id % 5 IN (2, 3) THEN 'NON_ENGLISH_RATIONALE' ELSE '' END AS refused FROM rel r JOIN cu c USING (event_id) JOIN g USING (event_id) LEFT JOIN cu t ON r.target = t.cue_id)
SELECT n AS ordinal, kind AS relation_type, CAST(n_refs AS INTEGER) AS n_evidence, CASE WHEN kind IN {RULES.replace("[", "(").replace("]", ")")} THEN 'THEORY_OPERATIONALIZED' ELSE 'BENCHMARK_OPERATIONAL' END AS provenance, status, 'INFERRED' AS directness, 0.0::DOUBLE AS confidence,
  CASE WHEN fact THEN 'OBSERVED_FACT' ELSE 'SPOKEN_CLAIM' END AS assertion_scope, '' AS refused FROM o WHERE refused = '' UNION ALL SELECT n, NULL, NULL, NULL, NULL, NULL, NULL, NULL, refused FROM o WHERE refused <> ''""",
    "drafted_proposals": f"""{BASE}, o AS (SELECT c.event_id AS n, c.event_id % 4 AS q, (c.event_id // 4) % 7 AS g, c.event_id % 5 <> 0 AS cued, c.event_id % 3 = 0 AS tied, n_refs - n_missing - n_foreign AS good, content, fact FROM cu c JOIN facts USING (event_id)),
x AS (SELECT *, {choice(("ok", "it increases trust", "不", "", "fits"), "n")} AS rationale, CASE WHEN q = 3 THEN 'UNKNOWN_GENERATOR' WHEN n % 29 = 0 OR (n % 27 = 0 AND q <> 0) THEN 'UNKNOWN_TASK_SUBTYPE' WHEN g IN (1, 6) THEN 'MISSING_TARGET' WHEN n % 30 = 0 THEN 'MISSING_GOLD'
  WHEN cued AND n % 26 = 0 THEN 'CUE_NOT_FOUND' WHEN g = 2 THEN 'PLACEHOLDER_TEXT' WHEN g = 3 THEN 'NON_ENGLISH_TEXT' ELSE '' END AS refused FROM o)
SELECT n AS ordinal, n % 9 = 0 AS own_id, ['cm_proposer', 'ss_proposer', 'ae_proposer'][q + 1] AS source_agent, ['CM', 'SS', 'AE'][q + 1] AS task_type, ['PARTIAL_SUPPORT', 'FEATURE_BENEFIT', 'PRICE_UNCERTAINTY'][q + 1] AS task_subtype,
  ['DECOMPOSE_CLAIM', 'MAP_FEATURE_TO_BENEFIT', 'TRACE_PRICE_CONCERN'][q + 1] AS reasoning_operator, CAST(CASE WHEN cued OR tied THEN good ELSE 1 END AS INTEGER) AS n_evidence, CAST(CASE WHEN cued OR tied THEN good * (cued::INT + tied::INT) ELSE 1 END AS INTEGER) AS n_edges,
  CASE WHEN cued THEN content WHEN tied THEN rationale ELSE 'b c' END AS said, CASE WHEN n % 2 = 0 THEN 'why so' ELSE 'Ask a specific evidence-grounded question about ' || ['partial support', 'feature benefit', 'price uncertainty'][q + 1] || '.' END AS question_intent,
  CAST(CASE WHEN n % 7 = 0 OR q > 0 THEN 1 ELSE 2 END AS INTEGER) AS n_forbidden, CASE WHEN cued AND NOT fact THEN 'SPOKEN_CLAIM' ELSE 'OBSERVED_FACT' END AS assertion_scope, '' AS refused FROM x WHERE refused = ''
UNION ALL SELECT n, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, refused FROM x WHERE refused <> ''""",
    "risky_annotations": f"""{BASE}, s AS (SELECT r.event_id, coalesce(bool_or(v.event_id % 12 = 0), false) AS span, coalesce(bool_or(v.modality <> 'visual' AND (v.modality = 'ocr' OR v.event_id % 2 = 1) AND v.event_id % 5 = 0), false) AS untimed, coalesce(bool_or(v.modality <> 'visual'), false) AS said
  FROM refs r LEFT JOIN ev v ON r.ref = v.evidence_id GROUP BY 1)
SELECT 'a' || e AS annotation_id, array_to_string(list_filter([CASE WHEN e % 4 = 3 AND ((e // 4) % 7 = 0 OR e % 7 = 0) THEN 'AE_SCHEMA_MISMATCH' END, CASE WHEN e % 4 = 1 AND n_modes < 2 THEN 'CM_NOT_CROSS_MODAL' END, CASE WHEN n_refs < CASE WHEN e % 4 = 0 THEN 1 ELSE 2 END THEN 'INSUFFICIENT_EVIDENCE' END,
  CASE WHEN span THEN 'INVALID_TEXT_SPAN' END, CASE WHEN untimed THEN 'MISSING_TEMPORAL_LOCALIZATION' END, CASE WHEN e % 10 = 0 THEN 'NUMERIC_PROPOSAL_ID' END, CASE WHEN e % 4 = 0 AND (e // 4) % 7 = 4 AND said THEN 'SELLER_CLAIM_AS_FACT' END], lambda x: x IS NOT NULL), ',') AS codes
FROM (SELECT *, event_id AS e FROM facts JOIN s USING (event_id))""",
    "review_buckets": """SELECT CASE WHEN e % 41 = 0 THEN 'held' WHEN e % 13 = 0 OR e % 6 = 0 THEN 'abstention_resample' WHEN e % 6 = 1 THEN 'auto_rejected' WHEN e % 17 = 0 OR e % 11 = 0 OR e % 6 IN (2, 5) OR e % 19 = 0 OR e % 14 = 0 THEN 'pipeline_diagnostics' ELSE 'content_review' END AS bucket,
  count(*) AS n, min(e) AS first_event FROM (SELECT event_id AS e FROM events) GROUP BY 1""",
    "localized_records": f"""{DOCS} SELECT vqa_id, CASE WHEN q = 'current' THEN 'zh ' || n ELSE '' END AS question_zh, q AS question_status, a AS answer_status, CASE WHEN e = 'current' THEN 'zh ' || n ELSE '' END AS evidence_text, e || ',not_applicable' AS evidence_status,
  coalesce(c, '') AS cue_status, 'missing' AS relation_status FROM t""",
    "localized_counts": f"""{DOCS} SELECT status, count(*) AS n FROM (SELECT unnest([q, a, e, c, 'missing']) AS status FROM t) WHERE status <> 'not_applicable' GROUP BY 1""",
}
