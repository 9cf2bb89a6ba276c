"""Composite plans on inline fixtures."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.plans import evidence, pipelines

UNIT = "evidence_id string, video_id string, modality string, start_s double, end_s double, frame_indices array<int>, content_en string, source_text_native string, subject string, predicate string, value string, confidence double, timestamp_status string, assertion_type string, temporal_scope string"
GOOD = ("e1", "v1", "visual", 0.0, 1.0, [1], "a cup", "", "cup", "is", "red", 0.9, "", "OBSERVED", "FRAME")


def changed(**new):
    names = [f.split()[0] for f in UNIT.split(", ")]
    return tuple(new.get(n, v) for n, v in zip(names, GOOD))


@pytest.mark.parametrize(
    "new,codes",
    [
        ({}, []),
        ({"evidence_id": ""}, ["INVALID_GOLD_VALUE"]),
        ({"start_s": 2.0}, ["INVALID_GOLD_VALUE"]),
        ({"confidence": 0.0}, ["INVALID_CONFIDENCE"]),
        ({"frame_indices": []}, ["MISSING_FRAME_REFERENCE"]),
        ({"modality": "metadata"}, ["NON_DIRECT_EVIDENCE"]),
        ({"modality": "asr", "start_s": None, "assertion_type": "SPOKEN_CLAIM", "temporal_scope": "SHORT_CLIP", "source_text_native": "hi"}, ["MISSING_TEMPORAL_LOCALIZATION"]),
        ({"modality": "asr", "start_s": None, "assertion_type": "SPOKEN_CLAIM", "temporal_scope": "SHORT_CLIP", "source_text_native": "hi", "timestamp_status": "unavailable"}, []),
        ({"assertion_type": "OCR_TEXT"}, ["ASSERTION_MODALITY_MISMATCH"]),
        ({"temporal_scope": "FULL_VIDEO"}, ["TEMPORAL_SCOPE_MODALITY_MISMATCH"]),
        ({"value": "红色"}, ["NON_ENGLISH_NORMALIZED_TEXT"]),
        ({"content_en": "the creator handle x"}, ["CREATOR_METADATA_LEAK"]),
    ],
)
def test_evidence_rules(spark, new, codes):
    assert spark.createDataFrame([changed(**new)], UNIT).select(evidence.evidence_issues()).first()[0] == codes


@pytest.mark.parametrize(
    "task,question,answer,codes",
    [
        ("BP", "What colour is the cup on the table?", "red", []),
        ("BP", "Which cup", "red", ["MISSING_QUESTION_MARK", "QUESTION_LENGTH_OUT_OF_RANGE"]),
        ("CM", "Does the voice say that a blue cup is sold?", "blue cup", ["ANSWER_LEAKAGE"]),
        ("BP", "Who holds up the large cup in the first scene?", "a man", ["BACKGROUND_HANDLING_QUESTION"]),
        ("SS", "What does the video show?", "much", ["GENERIC_QUESTION"]),
        ("AE", "Which evidence unit names the need of the viewer?", "x", ["BENCHMARK_META_LEAKAGE"]),
    ],
)
def test_question_rules(spark, task, question, answer, codes):
    df = spark.createDataFrame([(task, question, answer)], "t string, q string, a string")
    assert df.select(evidence.question_issues(F.col("t"), F.col("q"), F.col("a"))).first()[0] == codes


def test_candidate_score(spark):
    df = spark.createDataFrame([(0.9, 1, 1, "CM", "X", "it matches", 3), (0.8, 0, 0, "BP", "PRODUCT_IDENTITY", "she holds up a cup", 0)], "c double, n int, r int, t string, k string, a string, f int")
    got = [r[0] for r in df.select(evidence.candidate_score(*map(F.col, "cnrtkaf"))).collect()]
    assert got == [45 + 11 + 10 + 6, 40 + 8 - 45]


def chosen_in_turn(rows, priority, most, per_task, per_capability):
    """The greedy choice, one candidate after another."""
    def stem(q):
        return " ".join(re.sub(r"[^a-z0-9<>]+", " ", re.sub(r"\d+(?:\.\d+)?", "<num>", q.lower())).split())

    out, everywhere, held = {}, set(), {}
    for video, i, task, capability, question, _, score in sorted(rows, key=lambda r: (r[0], priority.get(r[2], len(priority)), -r[6], r[1])):
        mine = held.setdefault(video, [])
        words = set(stem(question).split())
        if len(mine) >= most:
            out[i] = "video_quota"
        elif sum(t == task for t, _, _ in mine) >= per_task:
            out[i] = "task_quota"
        elif sum(c == capability for _, c, _ in mine) >= per_capability:
            out[i] = "capability_quota"
        elif not question.endswith("?"):
            out[i] = "missing_question_mark"
        elif stem(question) in everywhere:
            out[i] = "exact_duplicate_question"
        elif any(len(words & w) / len(words | w) >= 0.92 for _, _, w in mine):
            out[i] = "within_video_semantic_duplicate"
        else:
            out[i] = ""
            everywhere.add(stem(question))
            mine.append((task, capability, words))
    return out


def test_compiled_questions_against_a_loop(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(26)]
    bases = [[rnd.choice(words) for _ in range(rnd.randint(5, 26))] for _ in range(12)]
    rows = []
    for i in range(500):
        text = list(rnd.choice(bases))
        if rnd.random() < 0.5:
            text[rnd.randrange(len(text))] = rnd.choice(["7", "8.5", "other"])
        rows.append((f"v{rnd.randint(0, 40)}", f"q{i:03}", rnd.choice(["BP", "CM", "SS"]), f"k{rnd.randint(0, 5)}", " ".join(text) + rnd.choice(["?", "?", "?", "? ", "."]).strip(), "no", float(rnd.randint(0, 9))))
    df = spark.createDataFrame(rows, "video_id string, vqa_id string, task_type string, capability string, question string, gold_answer string, score double")
    chosen, rejected = evidence.compile_questions(df, {"CM": 0, "BP": 1}, most=3, per_task=2, per_capability=2)
    got = {r["vqa_id"]: "" for r in chosen.collect()} | {r["vqa_id"]: r["reason"] for r in rejected.collect()}
    want = chosen_in_turn(rows, {"CM": 0, "BP": 1}, 3, 2, 2)
    assert got == want and len(set(want.values())) >= 6
    assert chosen.columns == df.columns and rejected.columns == [*df.columns, "reason"]
    none, _ = evidence.compile_questions(df.limit(0), {"CM": 0})
    assert none.count() == 0


def test_review_merge(spark):
    queue = spark.createDataFrame([("r1", "old", ["e1"]), ("r2", "old", ["e1"]), ("r3", "old", ["e1"])], "review_item_id string, gold_value string, evidence_ids array<string>")
    rows = [("r1", "REVISE", "new", ["e2"], "2"), ("r1", "REJECT", None, None, "1"), ("r2", "REJECT", None, None, "1"), ("r3", "ACCEPT", None, None, "1")]
    schema = "review_item_id string, decision string, revised_value string, revised_evidence_ids array<string>, reviewed_at string"
    got = {r["review_item_id"]: (r["gold_value"], r["evidence_ids"]) for r in evidence.merge_reviews(queue, spark.createDataFrame(rows, schema)).collect()}
    assert got == {"r1": ("new", ["e2"]), "r3": ("old", ["e1"])}
    with pytest.raises(Exception, match="unknown review item"):
        evidence.merge_reviews(queue, spark.createDataFrame([("zz", "ACCEPT", None, None, "1")], schema)).collect()


def test_features(spark):
    df = spark.createDataFrame([("1", "冲冲冲 现在下单!", "冲冲冲现在下单。好用?", "好用的杯子", "家居/杯子", 4.0), ("2", None, "", None, None, None)], "id string, title string, body string, product string, category string, rate double")
    flags = pipelines.language_features(df, "id", "title", "body").orderBy("id").collect()
    assert flags[0]["title_has_cta"] == 1 and flags[0]["text_has_benefit"] == 1 and flags[0]["title_has_benefit"] == 0 and flags[1]["title_has_cta"] == 0
    speech = pipelines.speech_features(df, "id", "body", "rate").orderBy("id").collect()
    assert speech[0]["cta_keyword_count_in_text"] == 4 and speech[0]["transcript_sentence_count"] == 2 and speech[1]["speech_rate_bucket"] == "unknown"
    cross = pipelines.cross_modal_features(df, "id", "title", "body", "product", "category").orderBy("id").collect()
    assert cross[0]["category_in_text"] == 0 and cross[0]["title_text_jaccard"] > 0.5 and cross[1]["consistency_score"] == 0.0


def test_cohort_prefers_new_creators(spark):
    df = spark.createDataFrame([(str(i), "ab"[i % 2], f"c{i // 4}") for i in range(24)], "id string, stratum string, creator string")
    got = pipelines.cohort(df, "id", ["stratum"], "creator", ["3"], 7).orderBy("turn").collect()
    assert got[0]["id"] == "3" and len({r["creator"] for r in got[:6]}) == 6 and len(got) == 7
    again = pipelines.cohort(df.orderBy(F.desc("id")), "id", ["stratum"], "creator", ["3"], 7).orderBy("turn").collect()
    assert [r["id"] for r in got] == [r["id"] for r in again]


def test_evaluate_scores_missing_answers_zero(spark):
    gold = spark.createDataFrame([("a", "BP"), ("b", "CM"), ("c", "CM")], "vqa_id string, task_type string")
    answers = spark.createDataFrame([("a", "yes"), ("c", "?"), ("zz", "extra")], "vqa_id string, answer string")

    def judge(rows):
        return [{"vqa_id": r["vqa_id"], "correctness": 1.0, "grounding": 1.0, "completeness": 0.5, "judge_success": r["model_output"] == "yes"} for r in rows]

    details, report = pipelines.evaluate(gold, answers, "vqa_id", judge)
    got = {r["vqa_id"]: (r["score"], r["missing"]) for r in details.collect()}
    assert got == {"a": (1.0, False), "b": (0.0, True), "c": (None, False)}
    micro = {r["block"]: r for r in report.collect()}["micro"]
    assert micro["count"] == 2 and micro["failed"] == 1 and micro["relaxed"] == 0.5


def test_translation_jobs_and_fingerprints(spark):
    df = spark.createDataFrame([("q1", "hello", "a"), ("q1", "hello", "a"), ("q2", None, " ")], "id string, question string, answer string")
    jobs = pipelines.translation_jobs([(df, "vqa", "id", ["question", "answer"])], "v1")
    assert jobs.count() == 2 and jobs.select("translation_id").distinct().count() == 2
    a, b = (pipelines.stage_fingerprint(x, "id", "up").first()["fingerprint"] for x in (df, df.orderBy(F.desc("id")).repartition(3)))
    assert a == b != pipelines.stage_fingerprint(df.limit(1), "id", "up").first()["fingerprint"]


def test_audit(spark):
    units = spark.createDataFrame([("e1", "v1", "asr"), ("e2", "v1", "visual"), ("e3", "v2", "asr")], "evidence_id string, video_id string, modality string")
    notes = spark.createDataFrame([("a1", "v1", "CM", ["e1", "e2"]), ("a2", "v1", "BP", ["e1"]), ("a3", "v2", "CM", ["e3", "e9"])], "annotation_id string, video_id string, task_type string, evidence_ids array<string>")
    got = {r["metric"]: r["value"] for r in pipelines.audit(notes, units, ["BP", "CM"]).collect()}
    assert got == {"count_CM": 2.0, "count_BP": 1.0, "evidence_coverage": 0.666667, "cross_modal_coverage": 0.5, "videos_missing_a_task": 1.0}


def test_token_cost(spark):
    prices = spark.createDataFrame([("m", 2.0, 4.0)], "model string, input_price double, output_price double")
    df = spark.createDataFrame([("m", 1000, 500), ("other", 1000, 500)], "model string, input_tokens int, output_tokens int")
    assert [r["cost_usd"] for r in pipelines.token_cost(df, prices, "m").collect()] == [0.004, 0.004]
