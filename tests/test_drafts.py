"""Nulls, repeats and empty tables in drafts and review queues."""

from pyspark.sql import functions as F

from sparkloom.functions import nested
from sparkloom.plans import drafts, reviews

CUE = "video_id string, ordinal bigint, cue_type string, content_en string, source_text_native string, evidence_ids array<string>, directness string, extractor string, confidence string, assertion_scope string, action_role string"
UNIT = "evidence_id string, video_id string, assertion_scope string, action_role string"
RELATION = "video_id string, ordinal bigint, relation_type string, source_cue_ids array<string>, target_cue_ids array<string>, evidence_ids array<string>, rationale_en string, status string, directness string, extractor string, confidence string, assertion_scope string"


def cue(ordinal, kind="price", content="it costs 9", ids=("e1", None, " e1 ", ""), role=None):
    return ("v", ordinal, kind, content, None, None if ids is None else list(ids), None, None, None, None, role)


def test_cues_with_nulls_repeats_and_no_rows(spark):
    units = spark.createDataFrame([("e1", "v", "CONDITIONAL", None), ("e2", "w", None, None), ("e3", "v", None, "PRODUCT_INSPECTION")], UNIT)
    rows = [cue(0), cue(1), cue(2, None), cue(3, content=None), cue(4, ids=None), cue(5, ids=("e9",)), cue(6, ids=("e2",)), cue(7, ids=("e3", "e1")), cue(8, content="网")]
    good, refused = drafts.normalized_cues(spark.createDataFrame(rows, CUE), units)
    kept = {r["ordinal"]: r for r in good.collect()}
    assert sorted(kept) == [0, 7] and kept[0]["evidence_ids"] == ["e1"] and kept[0]["assertion_scope"] == "CONDITIONAL" and kept[0]["action_role"] is None and kept[0]["confidence"] == 0.0
    assert kept[7]["action_role"] == "PRODUCT_INSPECTION" and kept[0]["cue_id"].startswith("v_cue_price_")
    want = {2: "UNKNOWN_CUE_TYPE", 3: "MISSING_CONTENT", 4: "MISSING_EVIDENCE", 5: "EVIDENCE_NOT_FOUND", 6: "EVIDENCE_VIDEO_MISMATCH", 8: "NON_ENGLISH_CONTENT"}
    assert {r["ordinal"]: r["refused"] for r in refused.collect()} == want
    for df in drafts.normalized_cues(spark.createDataFrame([], CUE), units.limit(0)):
        assert df.count() == 0


def test_relations_take_the_evidence_of_their_ends_in_order(spark):
    units = spark.createDataFrame([(f"e{i}", "v", None, None) for i in range(4)], UNIT)
    cues = spark.createDataFrame([("c1", "v", ["e1", "e2"], "OBSERVED_FACT"), ("c2", "v", ["e2", "e3"], "HYPOTHETICAL"), ("c3", "v", None, None)], "cue_id string, video_id string, evidence_ids array<string>, assertion_scope string")
    rows = [
        ("v", 0, "offer_requires_condition", ["c1"], ["c2"], ["e0", None], "fits", None, None, None, "high", None), ("v", 1, "OFFER_REQUIRES_CONDITION", ["c1"], ["c2"], None, "fits", None, None, None, "high", None),
        ("v", 2, "OFFER_REQUIRES_CONDITION", None, ["c2"], None, "fits", None, None, None, None, None), ("v", 3, None, ["c3"], ["c2"], None, "fits", None, None, None, None, None), ("v", 4, "OFFER_REQUIRES_CONDITION", ["c3"], ["c2"], None, None, None, None, None, None, None),
    ]
    good, refused = drafts.normalized_relations(spark.createDataFrame(rows, RELATION), cues, units)
    (only,) = good.collect()
    assert only["ordinal"] == 0 and only["evidence_ids"] == ["e0", "e1", "e2", "e3"] and only["assertion_scope"] == "HYPOTHETICAL" and only["confidence"] == 0.9 and only["provenance"] == "THEORY_OPERATIONALIZED"
    assert {r["ordinal"]: r["refused"] for r in refused.collect()} == {2: "MISSING_ENDPOINT", 3: "UNKNOWN_RELATION_TYPE", 4: "NON_ENGLISH_RATIONALE"}


PROPOSAL = "video_id string, ordinal bigint, generator string, task_type string, task_subtype string, target string, proposed_gold string, commerce_cue_ids array<string>, commercial_relation_ids array<string>, evidence_ids array<string>, reasoning_edges array<array<string>>, question_intent string, forbidden_inferences array<string>, assertion_scope string, proposal_id string"


def proposal(ordinal, cues=(), relations=(), ids=("e9", None, "e3"), target='{"a": "x"}', video="v", generator=" CM_proposer", edges=None):
    as_list = lambda x: None if x is None else list(x)
    return (video, ordinal, generator, "cm", "PARTIAL_SUPPORT", target, '{"b": 1}', as_list(cues), as_list(relations), as_list(ids), edges, None, None, None, None)


def test_proposals_with_lost_foreign_and_null_references(spark):
    units = spark.createDataFrame([("e1", "v"), ("e2", "v"), ("e3", "v"), ("e4", "w"), (None, "v")], "evidence_id string, video_id string")
    cues = spark.createDataFrame([("c1", "v", ["e2", None, "e4", "e1"], None, "said"), ("c2", "v", None, "HYPOTHETICAL", None), ("c3", "w", ["e4"], None, "x")], "cue_id string, video_id string, evidence_ids array<string>, assertion_scope string, content_en string")
    relations = spark.createDataFrame([("r1", "v", ["e1", "e3"], "CONDITIONAL", "so", "UNCLEAR"), ("c1", "w", [], None, "x", None)], "relation_id string, video_id string, evidence_ids array<string>, assertion_scope string, rationale_en string, status string")
    rows = [
        proposal(0, ["c1", " c1", None, "c2"], ["r1"]), proposal(1, None, None, None, edges=[["a", "b  c", "d", "e"], ["a"]]), proposal(2, ["c7"]), proposal(3, ["c3"], ["r1"]), proposal(4, ["c1"], ["c1"]), proposal(5, ["c7"], target='{"a": "<x>"}'), proposal(6, target='{"a": ["<x>"]}'),
        proposal(7, target='{"网": "网"}'), proposal(8, ["c7"], target="{}"), proposal(9, ["c7"], target=None), proposal(10, ["c7"], generator=None), proposal(11, ["c1"], video=None), proposal(12, ["c2"]),
    ]
    good, refused = drafts.normalized_proposals(spark.createDataFrame(rows, PROPOSAL), cues, relations, units)
    kept = {r["ordinal"]: r for r in good.collect()}
    assert {k: r["evidence_ids"] for k, r in kept.items()} == {0: ["e3", "e2", "e1"], 1: [], 11: [], 12: ["e3"]}
    assert kept[0]["reasoning_edges"] == [["e2", "said", "SUPPORTED"], ["e1", "said", "SUPPORTED"], ["e1", "so", "UNCLEAR"], ["e3", "so", "UNCLEAR"]] and kept[1]["reasoning_edges"] == [["a", "b c", "d"]]
    assert [kept[i]["assertion_scope"] for i in (0, 1, 12)] == ["HYPOTHETICAL", "OBSERVED_FACT", "HYPOTHETICAL"] and kept[0]["proposal_id"].startswith("v_cm_proposer_cm_000_")
    want = {2: "CUE_NOT_FOUND", 3: "CUE_NOT_FOUND", 4: "RELATION_NOT_FOUND", 5: "CUE_NOT_FOUND", 6: "PLACEHOLDER_TEXT", 7: "NON_ENGLISH_TEXT", 8: "MISSING_TARGET", 9: "MISSING_TARGET", 10: "UNKNOWN_GENERATOR"}
    assert {r["ordinal"]: r["refused"] for r in refused.collect()} == want
    for df in drafts.normalized_proposals(spark.createDataFrame([], PROPOSAL), cues, relations, units):
        assert df.count() == 0


def test_reasons_of_proposals_are_worked_out_once(spark):
    units = spark.createDataFrame([("e1", "v")], "evidence_id string, video_id string")
    cues = spark.createDataFrame([], "cue_id string, video_id string, evidence_ids array<string>, assertion_scope string, content_en string")
    relations = spark.createDataFrame([], "relation_id string, video_id string, evidence_ids array<string>, assertion_scope string, rationale_en string, status string")
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in drafts.normalized_proposals(spark.createDataFrame([proposal(0)], PROPOSAL), cues, relations, units)]
    assert not any("parse_json" in p.lower() or "parsejson" in p.lower() or "to_json" in p.lower() for p in plans) and "Join" not in plans[1]


def test_leaves_of_odd_json(spark):
    texts = [None, "", "no json", "[]", '"one"', '{"a:": ":", "b": ["", "x\\\\"], "c": {"d": "\\u7f51"}}', '{"k": "' + "y" * 200_000 + '"}']
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(nested.leaves(F.col("t")).alias("l")).collect()
    assert [sorted(r["l"]) for r in got] == [[], [], [], [], ["one"], ["", ":", "x\\\\", "网"], ["y" * 200_000]]


def test_buckets_and_codes_of_null_rows(spark):
    columns = "audit_bucket string, item_type string, reason_code string, stage string, resolution_status string, issue_codes array<string>, risk_codes array<string>"
    assert spark.createDataFrame([(None,) * 7], columns).select(drafts.review_bucket().alias("b")).first()["b"] == "content_review"
    said = spark.createDataFrame([(None, None), ("bad value: x", None), ("网: x", None), ("x", " low ")], "r string, e string")
    assert [r[0] for r in said.select(reviews.reason_code(F.col("r"), F.col("e"))).collect()] == ["REVIEW_REQUIRED", "BAD_VALUE", "REVIEW_REQUIRED", "LOW"]


def test_translation_faults_of_null_keys(spark):
    rows = spark.createDataFrame([(1, None, "o", "f", "h", "t", True), (2, None, "o", "f", "h", "t", True), (3, "k", "o", "f", "h", None, None)], "row_ord int, object_type string, object_id string, source_field string, source_sha256 string, translated_text string, audit_only boolean")
    got = {r["row_ord"]: r["faults"] for r in reviews.translation_faults(rows).collect()}
    assert got == {1: ["INCOMPLETE"], 2: ["INCOMPLETE", "DUPLICATE_KEY"], 3: ["NOT_AUDIT_ONLY", "INCOMPLETE"]}
