"""Runs: changed rows of tables, resampled means, translations asked once, publishing, and the evidence run."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import rows_of, tables
from sparkloom.operators import aggregates
from sparkloom.plans import integrity, run_queries, staged, staged_queries, translations
from sparkloom.sources import sinks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(run_queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    query = next(q for q in run_queries.ALL if q.__name__ == name)
    df = query(spark, SF)
    found = tables(SF).sql(run_queries.ORACLES[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(list(found.columns), found.fetchall())


def test_changed_rows_equal_a_full_join(spark):
    rnd = random.Random(3)
    old = [(i, rnd.choice(["a", None]), float(i % 7)) for i in range(400)] + [(5, "a", 1.0), (None, "n", 0.0), (None, "n", 0.0)]
    new = [r for r in old if r[0] not in (17, 200)] + [(900, "x", 1.0), (901, None, None)]
    new = [(k, "changed", v) if k in (3, 399) else (k, a, v) for k, a, v in new]
    new.remove((None, "n", 0.0))  # one of two equal rows
    schema = "k bigint, a string, v double"
    rnd.shuffle(new)
    got = integrity.changed_rows(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema).repartition(5), "k", 2)
    assert {(r["k"], r["change"]) for r in got.collect()} == {(17, "removed"), (200, "removed"), (900, "added"), (901, "added"), (3, "changed"), (399, "changed"), (None, "changed")}


def test_trees_of_equal_and_empty_tables(spark):
    df = spark.range(50).withColumn("x", F.lit("y"))
    a, b = integrity.digest_tree(df, "id", 2), integrity.digest_tree(df.repartition(3), "id", 2)
    assert integrity.changed_ranges(a, b, 2).count() == 0
    assert integrity.fingerprint_of(a).first() == integrity.fingerprint_of(b).first() != integrity.fingerprint_of(a, "other").first()
    none = integrity.digest_tree(df.limit(0), "id", 2)
    assert none.count() == 0 and integrity.fingerprint_of(none).first()["n_rows"] == 0
    assert integrity.changed_ranges(none, a, 2).agg(F.sum("n_old"), F.sum("n_new")).first()[:] == (0, 50)
    assert [integrity.depth_for(n) for n in (0, 10, 1_600_000, 1_600_001, 10**12)] == [1, 1, 1, 2, 6]


def test_resampled_intervals_equal_numpy(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    groups = {"scores": rnd.choice([0, 0.25, 0.5, 0.75, 1.0], 900, p=[0.1, 0.1, 0.2, 0.2, 0.4]), "many": rnd.normal(5, 2, 700), "one": np.array([2.0]), None: np.array([1.0, 3.0] * 50)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("scores", None), ("scores", float("nan")), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    monkeypatch.setattr(aggregates, "CHUNK_VALUES", 50)  # so that groups are dealt over chunks
    got = {r["g"]: r for r in aggregates.bootstrap_interval(df, ["g"], "v").collect()}
    assert set(got) == set(groups) and aggregates.bootstrap_interval(df.limit(0), ["g"], "v").count() == 0
    for g, values in groups.items():
        means = np.sort(rnd.choice(values, (4000, len(values))).mean(1))
        width = means[-1] - means[0]
        assert got[g]["n"] == len(values) and got[g]["mean"] == pytest.approx(values.mean(), abs=1e-6)
        assert abs(got[g]["low"] - means[99]) <= 0.06 * width + 1e-9 and abs(got[g]["high"] - means[3899]) <= 0.06 * width + 1e-9
    again = {r["g"]: r for r in aggregates.bootstrap_interval(df.repartition(7), ["g"], "v").collect()}
    assert again == got


def test_chunks_of_a_resample_add_up():
    rnd = np.random.default_rng(3)
    chunks = {0: rnd.normal(5, 2, 50), 1: rnd.normal(9, 1, 30), 3: rnd.normal(1, 1, 70)}  # the third leaf has no value
    below = [{0: 150}, {0: 80, 1: 70}, {0: 50, 1: 30, 3: 70}]
    for most in (0, 16):  # draws of counts, draws of rows
        aggregates.ROWS_A_VALUE, kept = most, aggregates.ROWS_A_VALUE
        sums = sum(np.array(aggregates.resampled_sums(v, np.ones(len(v), int), [below[0][0], below[1][c >> 1], below[2][c]], 7, c, 4000)) for c, v in chunks.items())
        aggregates.ROWS_A_VALUE = kept
        values = np.concatenate(list(chunks.values()))
        assert sums.mean() == pytest.approx(150 * values.mean(), rel=0.01) and sums.std() == pytest.approx(values.std() * 150**0.5, rel=0.05)
        assert aggregates.resampled_sums(np.ones(50), np.ones(50, int), [150, 80, 50], 7, 0, 9) != aggregates.resampled_sums(np.ones(50), np.ones(50, int), [150, 80, 50], 8, 0, 9)
        whole = [np.array(aggregates.resampled_sums(np.ones(len(v)), np.ones(len(v), int), [150, below[1][c >> 1], below[2][c]], 7, c, 9)) for c, v in chunks.items()]
        assert list(sum(whole)) == [150.0] * 9  # no row is drawn twice or not at all


def jobs_of(spark, rows):
    df = spark.createDataFrame(rows, "object_type string, object_id string, source_field string, source_text string, extra int")
    return df.withColumn("source_sha256", F.sha2("source_text", 256)).withColumn("translation_id", F.concat_ws("-", "object_type", "object_id", "source_field"))


CACHED = "object_type string, object_id string, source_field string, source_sha256 string, translated_text string, translation_method string, prompt_version string, audit_only boolean"


def test_each_text_is_asked_once_and_spread_back(spark, tmp_path):
    rows = [("t", str(i), "f", f"same text {i % 3}", i) for i in range(30)] + [("t", "c", "f", "machine_code_1", 0), ("t", "d", "f", '{"a": ["x1", "y:2"]}', 0), ("t", "n", "f", None, 0), ("t", "k", "f", "USB and 5 kg", 0), ("t", "x", "f", "broken call", 0)]
    jobs, asked = jobs_of(spark, rows), []

    def ask(calls):
        asked.append([r["texts"] for r in calls.collect()])
        bad = F.exists("texts", lambda t: t["source_text"] == "broken call")
        reply = F.to_json(F.struct(F.transform("texts", lambda t: F.struct(t["source_sha256"].alias("source_sha256"), F.concat(F.lit("好 "), F.replace(t["source_text"], F.lit("USB"), F.lit(""))).alias("translated_text"))).alias("translations")))
        return calls.select("batch", (~bad).alias("success"), reply.alias("reply"), F.when(bad, "down").alias("error"), F.lit("m").alias("model"))

    folder, none = f"file://{tmp_path}/run", spark.createDataFrame([], CACHED)
    done = translations.run_translations(jobs, none, ask, folder, "v1", budget=1)
    got = {r["object_id"]: r for r in done.collect()}
    assert len(got) == 35 and sorted(t["source_text"] for call in asked[0] for t in call) == ["USB and 5 kg", "broken call", "same text 0", "same text 1", "same text 2"]
    assert all(got[str(i)]["translated_text"] == f"好 same text {i % 3}" for i in range(30))
    assert got["c"]["translated_text"] == "审计代码：machine_code_1" and got["d"]["translation_method"] == "deterministic-machine-diagnostic-v1"
    assert (got["n"]["status"], got["n"]["error"]) == ("failed", "NO_TEXT") and (got["x"]["status"], got["x"]["error"]) == ("failed", "down")
    assert got["k"]["translated_text"].endswith("（保留标记：USB）")
    translations.run_translations(jobs, none, ask, folder, "v1", budget=1).count()
    assert len(asked) == 1  # the replies are there
    cache = translations.next_cache(done)
    second = translations.run_translations(jobs, cache, ask, f"file://{tmp_path}/next", "v1")
    assert {r["status"] for r in second.filter("object_id NOT IN ('n', 'x')").collect()} == {"reused"} and [[t["source_text"] for t in call] for call in asked[1]] == [["broken call"]]
    assert translations.run_translations(jobs.limit(0), none, ask, f"file://{tmp_path}/empty", "v1").count() == 0


def test_publishing_is_atomic_and_repeats_change_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/bank"
    one = {"a": (spark.createDataFrame([(2, None), (1, "x")], "k int, v string"), ["k"]), "b": (spark.createDataFrame([], "k int"), ["k"])}
    first = sinks.publish(one, path, "f1", {"run_id": "r"})
    assert first == {"fingerprint": "f1", "tables": {"a": 2, "b": 0}, "run_id": "r"}
    held = {f: os.stat(f).st_mtime_ns for d, _, fs in os.walk(tmp_path) for f in (os.path.join(d, x) for x in fs)}
    assert sinks.publish(one, path, "f1") == first
    assert {f: os.stat(f).st_mtime_ns for d, _, fs in os.walk(tmp_path) for f in (os.path.join(d, x) for x in fs)} == held
    two = one | {"a": (spark.createDataFrame([(3, "y")], "k int, v string"), ["k"])}
    sinks.write_jsonl(two["a"][0], f"{path}/versions/f2/a", ["k"])  # a run that was killed before its manifest
    assert [r["k"] for r in sinks.published(spark, path, "a", "k int, v string").collect()] == [1, 2]
    sinks.publish(two, path, "f2")
    assert [r["k"] for r in sinks.published(spark, path, "a").collect()] == [3] and sinks.published(spark, path, "b", "k int").count() == 0
    assert not [x for x in os.listdir(tmp_path / "bank") if x.startswith("manifest.json.")]
    assert sinks.required_fingerprint(spark, f"{path}/manifest.json") == "f2"
    for where, name in ((f"{path}/manifest.json", "evidence_fingerprint"), (f"{path}/nothing.json", "fingerprint")):
        with pytest.raises(ValueError, match="has no"):
            sinks.required_fingerprint(spark, where, name)
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, f"file://{tmp_path}/nowhere", "a")


def test_tables_are_written_once_and_parts_are_not_doubled(spark, tmp_path):
    path, made = f"file://{tmp_path}/t", []

    def make():
        made.append(1)
        return spark.range(3)

    assert sinks.written_once(spark, path, make).count() == sinks.written_once(spark, path, make).count() == 3 and len(made) == 1
    os.remove(tmp_path / "t" / "_SUCCESS")  # half-written
    assert sinks.written_once(spark, path, make).count() == 3 and len(made) == 2
    df, parts = spark.createDataFrame([(1, "a"), (2, "b")], "e int, v string"), f"file://{tmp_path}/parts"
    assert sinks.read_parts(df, parts, "f").count() == 0
    sinks.write_parts(df, parts, "e", "f")
    sinks.write_parts(df.union(spark.createDataFrame([(3, "c")], df.schema)), parts, "e", "f")
    sinks.write_parts(df, parts, "e", "g")
    assert sorted(r["e"] for r in sinks.read_parts(df, parts, "f").collect()) == [1, 2, 3] and sinks.cached_parts(df, sinks.read_parts(df, parts, "g"), ["e"]).count() == 0


def lines_below(folder):
    out = {}
    for d, _, files in os.walk(folder):
        for f in sorted(files):
            if f.endswith(".json") and "versions" in d:
                out.setdefault(os.path.basename(d), []).append(open(os.path.join(d, f)).read())
    return {k: "".join(v) for k, v in out.items()}


def test_a_killed_run_goes_on_and_publishes_the_same(spark, tmp_path):
    events = staged_queries.weeks(spark, SF)
    parts, client, calls = staged_queries.parts(events), staged_queries.scripted(events), []

    def failing(step, requests):
        calls.append(step)
        if step == "challenge" and calls.count("challenge") == 1:
            raise RuntimeError("killed")
        return client(step, requests)

    with pytest.raises(RuntimeError, match="killed"):
        staged.run_videos(parts, failing, f"file://{tmp_path}/stages")
    run = staged.run_videos(parts, failing, f"file://{tmp_path}/stages")
    assert [calls.count(s) for s in ("evidence_1", "cues_1", "proposals", "challenge", "adjudication")] == [1, 1, 1, 2, 1]
    assert run.states.count() == parts.select("video_id").distinct().count() == run.states.select("video_id").distinct().count()
    manifest = sinks.publish(run.tables(), f"file://{tmp_path}/one", "f")
    again = staged.run_videos(parts, failing, f"file://{tmp_path}/stages")  # all stages are there
    sinks.publish(again.tables(), f"file://{tmp_path}/two", "f")
    assert lines_below(tmp_path / "one") == lines_below(tmp_path / "two") and manifest["tables"]["video_states"] == run.states.count()
    routed = sum(manifest["tables"][t] for t in ("human_review_queue", "rejected_candidates", "pipeline_diagnostics"))
    assert routed == run.queue.count() == manifest["tables"]["quality_decisions"]
    assert all(json.loads(x)["video_id"] for x in lines_below(tmp_path / "one")["grounded_annotations"].splitlines())


def test_model_client_gives_a_reply_for_each_request(spark):
    def client(rows):
        if any(r["item"] == "bad" for r in rows):
            raise ValueError("down")
        return [{k: r[k] for k in staged.CALL} | {"success": True, "reply": f"{len(r['rows'])} rows"} for r in rows if r["item"] != "none"]

    rows = [("v", "s", 1, i, [("1", "k", "w")]) for i in ("a", "none")] + [("v", "s", 1, "bad", [])]
    df = spark.createDataFrame(rows, f"video_id string, stage string, attempt int, item string, rows {staged.ROWS}")
    got = {r["item"]: (r["success"], r["reply"], r["error"]) for r in staged.model_client(client, 1)("x", df).collect()}
    assert got == {"a": (True, "1 rows", None), "none": (False, None, "no reply"), "bad": (False, None, "down")}
