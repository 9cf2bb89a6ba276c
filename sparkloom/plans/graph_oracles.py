"""SQL twins of the evidence graph's queries."""

from __future__ import annotations

def choice(values: tuple[str, ...], number: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({number} % {len(values)} + 1 AS INTEGER)]"


BASE = f"""
WITH ev AS (SELECT event_id, 'e' || event_id AS evidence_id, CAST(user_id AS VARCHAR) AS video_id, CASE event_type WHEN 'view' THEN 'visual' WHEN 'click' THEN 'ocr' ELSE 'asr' END AS modality,
  CASE WHEN event_type = 'view' THEN {choice(("BACKGROUND_HANDLING", "PRODUCT_INSPECTION", "FUNCTIONAL_OPERATION", "OUTCOME_DEMONSTRATION"), "event_id")} END AS role,
  {choice(("OBSERVED_FACT", "SPOKEN_CLAIM", "OBSERVED_FACT", "CONDITIONAL"), "event_id")} AS scope, {choice(("FRAME", "LONG_TERM_CLAIM", "SHORT_CLIP", "FULL_VIDEO", "FRAME"), "event_id")} AS span,
  lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events),
cu AS (SELECT event_id, 'c' || event_id AS cue_id, video_id, nxt, {choice(("PRICE", "OFFER_CONDITION", "PRODUCT_ATTRIBUTE", "BENEFIT", "PRICE_CLAIM", "BEFORE_AFTER", "PRODUCT_IDENTITY", "PROCESS_DEMONSTRATION", "EFFECT_CLAIM", "CTA"), "event_id")} AS cue_type,
  CASE WHEN event_id % 3 = 0 THEN 'price ' || event_id % 9 WHEN event_id % 29 = 0 THEN '网' ELSE {choice(("plain", "The presenter holds the product", "The speaker says it lasts", ""), "event_id")} END AS content,
  CASE WHEN event_id % 6 < 4 THEN {choice(("OUTCOME_DEMONSTRATION", "BACKGROUND_HANDLING", "PRODUCT_INSPECTION", "FUNCTIONAL_OPERATION"), "event_id")} END AS role, event_id % 5 < 3 AS fact FROM ev),
refs AS (SELECT event_id, video_id, evidence_id AS ref FROM ev UNION SELECT event_id, video_id, 'e' || nxt FROM ev WHERE nxt IS NOT NULL
  UNION SELECT event_id, video_id, 'x' || event_id FROM ev WHERE event_id % 13 = 0 UNION SELECT event_id, video_id, 'e' || (event_id + 1) FROM ev WHERE event_id % 17 = 0),
facts AS (SELECT r.event_id, count(*) AS n_refs, count(*) FILTER (WHERE e.event_id IS NULL) AS n_missing, count(*) FILTER (WHERE e.video_id <> r.video_id) AS n_foreign, count(DISTINCT e.modality) AS n_modes,
  coalesce(bool_or(e.modality = 'visual'), false) AS visual, coalesce(bool_and(e.modality = 'asr'), false) AS spoken, coalesce(bool_or(e.event_id % 7 = r.event_id % 9 OR e.event_id % 5 = r.event_id % 9), false) AS known,
  coalesce(bool_or(e.role = 'FUNCTIONAL_OPERATION'), false) AS operated, coalesce(bool_or(e.role = 'OUTCOME_DEMONSTRATION'), false) AS shown, coalesce(bool_or(e.scope <> 'OBSERVED_FACT'), false) AS claimed,
  coalesce(bool_or(e.span = 'LONG_TERM_CLAIM'), false) AS long, coalesce(bool_or(e.span = 'FULL_VIDEO'), false) AS whole
  FROM refs r LEFT JOIN ev e ON r.ref = e.evidence_id GROUP BY 1),
rel AS (SELECT event_id, 'r' || event_id AS relation_id, video_id, cue_id AS source, cue_type AS source_type, CASE WHEN event_id % 28 = 0 THEN 'z' || event_id WHEN event_id % 36 = 0 THEN 'c' || (event_id + 2) ELSE 'c' || nxt END AS target,
  {choice(("OFFER_REQUIRES_CONDITION", "FEATURE_FRAMED_AS_BENEFIT", "CLAIM_REPEATED_ACROSS_MODALITIES", "CLAIM_SUPPORTED_BY_DEMONSTRATION", "CLAIM_TEMPORALLY_MISALIGNED", "CONTENT_PRECEDES_CTA", "NO_SUCH"), "event_id")} AS kind,
  {choice(("SUPPORTED", "PARTIALLY_SUPPORTED", "TEMPORALLY_MISALIGNED", "UNCLEAR"), "event_id")} AS status,
  CASE WHEN event_id % 5 = 0 THEN 'THEORY_DIRECT' ELSE 'THEORY_OPERATIONALIZED' END AS provenance FROM cu)"""


def joined(*codes: tuple[str, str]) -> str:
    """The codes whose condition holds, in order, joined by commas."""
    return "coalesce(array_to_string(list_filter([" + ", ".join(f"CASE WHEN {when} THEN '{code}' END" for code, when in codes) + "], lambda x: x IS NOT NULL), ','), '')"


CLAIMS = "['FUNCTION_CLAIM', 'EFFECT_CLAIM', 'PRICE_CLAIM', 'FIT_CLAIM', 'EXPERIENCE_REVIEW']"

DEMONSTRATED = "cue_type IN ('BEFORE_AFTER', 'PROCESS_DEMONSTRATION')"
CUE_CODES = joined(
    ("INVALID_COMMERCE_CUE", "content = ''"),
    ("NON_ENGLISH_CANONICAL_TEXT", "content = '网'"),
    ("EVIDENCE_NOT_FOUND", "n_missing > 0"),
    ("EVIDENCE_VIDEO_MISMATCH", "n_foreign > 0"),
    ("ACTION_ONLY_PRODUCT_IDENTITY", "cue_type = 'PRODUCT_IDENTITY' AND (role = 'BACKGROUND_HANDLING' OR content LIKE '%presenter holds%')"),
    ("BACKGROUND_ACTION_AS_DEMONSTRATION", f"{DEMONSTRATED} AND role = 'BACKGROUND_HANDLING'"),
    ("INVALID_DEMONSTRATION_ACTION_ROLE", "(cue_type = 'BEFORE_AFTER' AND role IS DISTINCT FROM 'OUTCOME_DEMONSTRATION') OR (cue_type = 'PROCESS_DEMONSTRATION' AND role IS DISTINCT FROM 'FUNCTIONAL_OPERATION')"),
    ("DEMONSTRATION_ROLE_NOT_GROUNDED", "n_refs > n_missing AND ((cue_type = 'BEFORE_AFTER' AND NOT shown) OR (cue_type = 'PROCESS_DEMONSTRATION' AND NOT operated))"),
    ("CLAIM_SCOPE_PROMOTION", "fact AND claimed"),
    ("CLAIM_AS_PRODUCT_ATTRIBUTE", "cue_type = 'PRODUCT_ATTRIBUTE' AND spoken"),
    ("UNATTRIBUTED_PROMOTIONAL_CLAIM", "cue_type = 'BENEFIT' AND spoken AND NOT regexp_matches(lower(content), 'speaker|presenter')"),
    ("NUMERIC_VALUE_NOT_IN_EVIDENCE", "cue_type IN ('PRICE', 'OFFER_CONDITION') AND event_id % 3 = 0 AND NOT known"),
    ("DEMONSTRATION_REQUIRES_VISUAL_EVIDENCE", f"{DEMONSTRATED} AND NOT visual"),
    ("INVALID_DIRECTNESS", "event_id % 31 = 0"),
)
RELATION_CODES = joined(
    ("UNKNOWN_RELATION_TYPE", "least IS NULL"),
    ("MISSING_RELATION_ENDPOINT", "r.target IS NULL"),
    ("CUE_NOT_FOUND", "r.target IS NOT NULL AND t.cue_id IS NULL"),
    ("CUE_VIDEO_MISMATCH", "t.video_id <> r.video_id"),
    ("INVALID_RELATION_SOURCE_TYPE", "NOT list_contains(sources, source_type)"),
    ("INVALID_RELATION_TARGET_TYPE", "NOT list_contains(targets, t.cue_type)"),
    ("DEMONSTRATION_REQUIRES_VISUAL_EVIDENCE", "r.kind IN ('CLAIM_SUPPORTED_BY_DEMONSTRATION', 'CLAIM_TEMPORALLY_MISALIGNED') AND NOT coalesce(g.visual, false)"),
    ("RELATION_MODALITY_DIVERSITY", "r.kind = 'CLAIM_REPEATED_ACROSS_MODALITIES' AND f.n_modes < 2"),
    ("RELATION_STATUS_MISMATCH", "(r.kind = 'CLAIM_SUPPORTED_BY_DEMONSTRATION' AND status <> 'SUPPORTED') OR (r.kind = 'CLAIM_TEMPORALLY_MISALIGNED' AND status <> 'TEMPORALLY_MISALIGNED')"),
    ("UNSUPPORTED_CLAIM_SCOPE", "r.kind = 'CLAIM_SUPPORTED_BY_DEMONSTRATION' AND f.long AND NOT coalesce(g.whole, false)"),
    ("INSUFFICIENT_EVIDENCE", "f.n_refs < least"),
    ("EVIDENCE_NOT_FOUND", "f.n_missing > 0"),
    ("EVIDENCE_VIDEO_MISMATCH", "f.n_foreign > 0"),
    ("INVALID_RELATION_PROVENANCE", "r.provenance <> u.provenance"),
    ("NON_ENGLISH_CANONICAL_TEXT", "r.event_id % 5 IN (2, 3)"),
    ("CONSUMER_OUTCOME_LEAK", "r.event_id % 5 = 1"),
    ("INVALID_RELATION_STATUS", "status = 'UNCLEAR'"),
)
EVIDENCE_CODES = joined(
    ("INVALID_GOLD_VALUE", "event_id % 19 = 0"),
    ("INVALID_CONFIDENCE", "event_id % 8 = 0"),
    ("NON_DIRECT_EVIDENCE", "m = 'metadata'"),
    ("MISSING_FRAME_REFERENCE", "m = 'visual' AND event_id % 6 = 0"),
    ("MISSING_TEXT_SPAN", "m IN ('asr', 'ocr') AND event_id % 4 = 0"),
    ("MISSING_TEMPORAL_LOCALIZATION", "m IN ('asr', 'ocr') AND event_id % 5 = 0 AND NOT (m = 'asr' AND event_id % 10 = 0)"),
    ("ASSERTION_MODALITY_MISMATCH", "m = 'ocr'"),
    ("TEMPORAL_SCOPE_MODALITY_MISMATCH", "m = 'asr' AND event_id % 2 = 0"),
    ("NON_ENGLISH_NORMALIZED_TEXT", "event_id % 3 = 0"),
)
SPEC_CODES = joined(
    ("LIFECYCLE_NOT_COMPILABLE", "k % 5 < 2"),
    ("INSUFFICIENT_TASK_EVIDENCE", "task <> 'BP' AND k % 3 = 0"),
    ("MISSING_COMMERCIAL_RELATION", "task IN ('CM', 'SS') AND k % 7 = 0"),
    ("MISSING_COMMERCE_GRAPH_REF", "task = 'AE' AND k % 7 = 0 AND k % 2 = 0"),
    ("MISSING_GOLD_ANSWER", "k % 11 = 0"),
    ("ANSWER_TYPE_MISMATCH", "task <> 'BP' OR (k % 13 = 0 AND k % 11 <> 0)"),
)

ORACLES = {
    "cue_checks": f"{BASE} SELECT cue_id, {CUE_CODES} AS codes FROM cu JOIN facts USING (event_id)",
    "relation_checks": f"""{BASE}, rules AS (SELECT * FROM (VALUES
  ('OFFER_REQUIRES_CONDITION', ['PRICE', 'DISCOUNT', 'GIFT'], ['OFFER_CONDITION'], 'THEORY_OPERATIONALIZED', 2), ('FEATURE_FRAMED_AS_BENEFIT', ['PRODUCT_ATTRIBUTE', 'PRODUCT_DESCRIPTION'], ['BENEFIT'], 'THEORY_OPERATIONALIZED', 1),
  ('CLAIM_REPEATED_ACROSS_MODALITIES', {CLAIMS}, {CLAIMS}, 'BENCHMARK_OPERATIONAL', 2), ('CLAIM_SUPPORTED_BY_DEMONSTRATION', {CLAIMS}, ['PROCESS_DEMONSTRATION', 'BEFORE_AFTER'], 'THEORY_OPERATIONALIZED', 2),
  ('CLAIM_TEMPORALLY_MISALIGNED', {CLAIMS}, ['PROCESS_DEMONSTRATION', 'BEFORE_AFTER'], 'BENCHMARK_OPERATIONAL', 2), ('CONTENT_PRECEDES_CTA', ['BENEFIT', 'PRICE', 'OFFER_CONDITION', 'PROCESS_DEMONSTRATION', 'BEFORE_AFTER'], ['CTA'], 'BENCHMARK_OPERATIONAL', 2)) v(kind, sources, targets, provenance, least))
SELECT relation_id, {RELATION_CODES} AS codes FROM rel r JOIN facts f ON r.event_id = f.event_id LEFT JOIN cu t ON r.target = t.cue_id LEFT JOIN facts g ON t.event_id = g.event_id LEFT JOIN rules u ON r.kind = u.kind""",
    "basic_proposals": f"""{BASE}, tou AS (SELECT cue, string_agg(relation_id, ',' ORDER BY relation_id) AS relations FROM (SELECT source AS cue, relation_id FROM rel UNION SELECT target, relation_id FROM rel) GROUP BY 1),
p AS (SELECT *, CASE cue_type WHEN 'PRICE' THEN 'PRICE_AND_DISCOUNT' WHEN 'OFFER_CONDITION' THEN 'OFFER_CONDITION' WHEN 'PRODUCT_ATTRIBUTE' THEN 'ATTRIBUTE_AND_VARIANT' WHEN 'BEFORE_AFTER' THEN 'DEMONSTRATED_STATE_CHANGE' WHEN 'PRODUCT_IDENTITY' THEN 'PRODUCT_IDENTITY' WHEN 'PROCESS_DEMONSTRATION' THEN 'USAGE_STEP' END AS capability
  FROM cu JOIN facts USING (event_id) LEFT JOIN tou ON cue = cue_id)
SELECT cue_id, video_id, 'BP' AS task_type, capability, CASE WHEN NOT spoken OR content = '' OR content LIKE 'The speaker %' THEN content WHEN content LIKE 'The presenter%' THEN 'The speaker says: ' || content ELSE 'The speaker says: ' || content END AS gold_answer,
  CAST(1 + CAST(event_id % 17 = 0 AS INTEGER) + CAST(nxt IS NOT NULL AS INTEGER) AS INTEGER) AS n_evidence,
  coalesce(relations, '') AS relations, spoken AS speech_only FROM p WHERE capability IS NOT NULL AND n_missing = 0 AND role IS DISTINCT FROM 'BACKGROUND_HANDLING' AND (NOT {DEMONSTRATED} OR visual)""",
    "evidence_checks": f"SELECT event_id, {EVIDENCE_CODES} AS codes FROM (SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'metadata' WHEN event_type = 'view' THEN 'visual' WHEN event_type = 'click' THEN 'ocr' ELSE 'asr' END AS m FROM events)",
    "spec_checks": f"SELECT k AS o_orderkey, {SPEC_CODES} AS codes FROM (SELECT o_orderkey AS k, ['BP', 'CM', 'SS', 'AE'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS task FROM orders)",
    # the greedy choice row by row, in the order of videos, tasks, scores and ids
    "compiled_questions": r"""
WITH RECURSIVE t AS (SELECT CAST(conv_id % 50 AS VARCHAR) AS video, conv_id || ':' || turn AS vqa_id, turn % 4 AS p, turn % 3 AS k, text || '?' AS q, length(text) AS s FROM conversations WHERE role = 'user'),
j AS (SELECT *, trim(regexp_replace(regexp_replace(lower(q), '[0-9]+(\.[0-9]+)?', '<num>', 'g'), '[^a-z0-9<>]+', ' ', 'g')) AS stem,
  CASE WHEN regexp_matches(q, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]') THEN 'non_english_question' WHEN len(regexp_extract_all(q, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?')) NOT BETWEEN 5 AND 45 THEN 'question_length_out_of_range' END AS issue FROM t),
o AS (SELECT *, list_filter(string_split(stem, ' '), lambda x: x <> '') AS words, row_number() OVER (ORDER BY video, p, s DESC, vqa_id) AS i FROM j),
w AS (SELECT 0 AS i, '' AS video, '' AS vqa_id, '' AS outcome, CAST([] AS STRUCT(p BIGINT, k BIGINT, words VARCHAR[])[]) AS held, CAST([] AS VARCHAR[]) AS seen
  UNION ALL
  SELECT i, video, vqa_id, outcome, CASE WHEN outcome = 'KEPT' THEN list_append(held, {'p': CAST(p AS BIGINT), 'k': CAST(k AS BIGINT), 'words': words}) ELSE held END, CASE WHEN outcome = 'KEPT' THEN list_append(seen, stem) ELSE seen END
  FROM (SELECT *, CASE WHEN len(held) >= 8 THEN 'video_quota' WHEN len(list_filter(held, lambda x: x.p = p0)) >= 3 THEN 'task_quota' WHEN len(list_filter(held, lambda x: x.k = k0)) >= 2 THEN 'capability_quota' WHEN issue IS NOT NULL THEN issue
      WHEN list_contains(seen, stem) THEN 'exact_duplicate_question'
      WHEN len(list_filter(held, lambda x: len(list_intersect(x.words, words)) >= 0.92 * len(list_distinct(list_concat(x.words, words))))) > 0 THEN 'within_video_semantic_duplicate' ELSE 'KEPT' END AS outcome
    FROM (SELECT o.*, o.p AS p0, o.k AS k0, w.seen, CASE WHEN w.video = o.video THEN w.held ELSE [] END AS held FROM w JOIN o ON o.i = w.i + 1)))
SELECT vqa_id, outcome FROM w WHERE i > 0""",
    "merged_reviews": """
WITH l AS (SELECT o_custkey, max(o_orderkey) AS k, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS review_item_id, CASE WHEN status = 'O' THEN p ELSE c_mktsegment END AS gold_value, CASE WHEN status = 'O' AND k % 2 = 0 THEN 2 ELSE 1 END AS n_evidence, 'human_accepted' AS lifecycle_status
FROM customer JOIN l ON o_custkey = c_custkey WHERE status IN ('F', 'O')""",
    "redacted_json": """SELECT event_id, '{"a":' || event_id % 5 || ',"z":[{"p":{"k":' || json_extract_string(props, '$.k') || '}}]}' AS payload FROM events""",
    "translation_checks": f"""
WITH t AS (SELECT *, regexp_matches(text, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}]') AS cjk FROM conversations)
SELECT conv_id, turn, {joined(("NOT_TRANSLATED", "conv_id % 3 = 2 AND NOT cjk"), ("NUMBERS_DIFFER", "conv_id % 3 = 1 AND regexp_matches(text, '[0-9]')"), ("TOKENS_MISSING", "conv_id % 3 = 1 AND regexp_matches(text, '[A-Z][A-Z0-9]+')"))} AS codes FROM t""",
}
