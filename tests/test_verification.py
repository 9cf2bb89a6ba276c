"""Relations in bounded calls and their verdicts."""

import json

from pyspark.sql import functions as F

from oracle import rows_of, tables
from sparkloom.plans import run_queries, verification

RELATIONS = "relation_id string, video_id string, relation_type string, rationale_en string, source_cue_ids array<string>, target_cue_ids array<string>, evidence_ids array<string>, extra int"


def contexts(spark, relations, frames=None):
    frames = frames or {}
    cues = spark.createDataFrame([("c1", "v", "cue one"), ("c2", "v", None)], "cue_id string, video_id string, content_en string")
    evidence = spark.createDataFrame([(f"e{i}", "v", f"unit {i}", frames.get(i, [i])) for i in range(40)], "evidence_id string, video_id string, content_en string, frame_indices array<int>")
    return verification.relation_contexts(spark.createDataFrame([(i, v, "T", "r", s, t, e, 0) for i, v, s, t, e in relations], RELATIONS), cues, evidence)


def test_contexts_are_in_order_and_whole(spark):
    got = {r["relation_id"]: r for r in contexts(spark, [("r1", "v", ["c1", "zz"], ["c2"], ["e3", "e1"]), ("r2", "v", None, [], None)]).collect()}
    assert got["r1"]["claim"].asDict(True) == {"relation_type": "T", "rationale_en": "r", "source": ["cue one"], "target": [], "evidence": ["unit 3", "unit 1"]} and got["r1"]["frames"] == [1, 3]
    assert got["r2"]["frames"] == [] and got["r2"]["claim"]["evidence"] == []


def test_calls_are_bounded_and_a_hot_video_is_split(spark, monkeypatch):
    monkeypatch.setattr(verification, "BUCKET_RELATIONS", 50)
    rows = [(f"r{i:03d}", "hot", ["c1"], ["c1"], [f"e{i % 40}", f"e{(i + 1) % 40}"]) for i in range(300)] + [("s1", "w", [], [], ["e1"]), ("s2", "w", [], [], ["e39"])]
    calls = verification.verification_calls(contexts(spark, rows, {39: list(range(100, 130))}), most_relations=10, most_frames=8).collect()
    assert sorted(r["relation_id"] for c in calls for r in c["relations"]) == sorted(r[0] for r in rows)
    big = [c for c in calls if len(c["frames"]) > 16]
    assert all(len(c["relations"]) <= 11 for c in calls) and all(any(f >= 100 for f in c["frames"]) for c in big) and len(calls) > 40
    assert all(c["video_id"] in ("hot", "w") for c in calls)


def test_every_relation_comes_back_once(spark):
    rows = [(f"r{i}", f"v{i % 4}", ["c1"], ["c1"], [f"e{i}"]) for i in range(12)] + [("x", "v9", [], [], [])]
    told = contexts(spark, rows)

    def ask(calls):
        def reply(relations, video):
            rows = [{"relation_id": r["relation_id"], "verdict": "PASS", "reason": "ok"} for r in relations]
            return {"v0": json.dumps({"verifications": rows}), "v1": json.dumps({"verifications": rows[:-1]}), "v2": json.dumps({"verifications": [*rows, {"relation_id": "other", "verdict": "PASS", "reason": "ok"}]}), "v3": "no json", "v9": None}[video]

        made = [(c["call"], c["video_id"] != "v9", reply(c["relations"], c["video_id"])) for c in calls.collect()]
        return calls.sparkSession.createDataFrame(made, "call string, success boolean, reply string")

    got = {r["relation_id"]: (r["verdict"], r["reason"]) for r in verification.verified_relations(told, ask).collect()}
    assert len(got) == 13 and {got[f"r{i}"] for i in (0, 4, 8)} == {("PASS", "ok")}
    assert {got[f"r{i}"] for i in (1, 5, 9)} == {("UNVERIFIED", "OMITTED_RELATION")} and got["r2"] == ("UNVERIFIED", "UNKNOWN_RELATION") and got["r3"] == ("UNVERIFIED", "NO_LIST") and got["x"] == ("UNVERIFIED", "CALL_FAILED")
    assert verification.verified_relations(told.limit(0), lambda calls: calls.select("call", F.lit(True).alias("success"), F.lit("").alias("reply"))).count() == 0


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    df = run_queries.verified_relations(spark, sf)
    found = tables(sf).sql(run_queries.ORACLES["verified_relations"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(list(found.columns), found.fetchall())
