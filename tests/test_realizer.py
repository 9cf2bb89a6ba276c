"""Parts of written questions."""

from pyspark.sql import functions as F

from sparkloom.plans import realizer

SPEC = "spec_id string, video_id string, task_type string, evidence_refs array<string>, note string"


def clients(log):
    def write(asked):
        log.append(sorted(r["spec_id"] for r in asked.collect()))
        reply = F.when(F.col("spec_id") == "s3", "no json").otherwise(F.to_json(F.struct(F.concat(F.lit("What is "), F.col("note"), F.lit("?")).alias("question"), F.lit("blue").alias("answer"))))
        return asked.filter("spec_id <> 's4'").select("part_key", F.lit(True).alias("success"), reply.alias("reply"))

    def check(asked):
        log.append(sorted(r["spec_id"] for r in asked.collect()))
        return asked.select("part_key", (F.col("spec_id") != "s5").alias("success"), realizer.verdict_json(F.col("spec_id"), F.when(F.col("spec_id") == "s2", "HUMAN_REVIEW").otherwise("PASS")).alias("reply"))

    return write, check


def run(spark, specs, evidence, cache, folder, log, version="v1"):
    write, check = clients(log)
    return realizer.realized(spark.createDataFrame(specs, SPEC), spark.createDataFrame(evidence, "evidence_id string, words string"), cache, write, check, version, folder)


def test_only_specs_of_changed_evidence_are_made_anew(spark, tmp_path):
    specs = [(f"s{i}", "v", "BP", [f"e{i}", "e0"] if i < 6 else None, f"it {i}") for i in range(1, 8)] + [(None, "v", "BP", None, "x")]
    evidence, log = [(f"e{i}", "w") for i in range(6)], []
    first = run(spark, specs, evidence, None, f"file://{tmp_path}/a", log)
    got = {r["spec_id"]: (r["route"], r["reasons"], r["reused"]) for r in first.collect()}
    assert got["s1"] == got["s7"] == ("accepted", [], False) and got["s2"][:2] == ("human_review", []) and len(got) == 7
    assert got["s3"][:2] == ("rejected", ["WRITER_PARSE_ERROR"]) and got["s4"][:2] == ("rejected", ["WRITER_FAILED"]) and got["s5"][:2] == ("rejected", ["CHECK_FAILED"])
    assert log == [[f"s{i}" for i in range(1, 8)], ["s1", "s2", "s5", "s6", "s7"]]
    run(spark, specs, evidence, None, f"file://{tmp_path}/a", log).count()
    assert len(log) == 2  # all replies are there
    cache = first.select(*realizer.PARTS)
    changed = [("e1", "other"), *evidence[2:], evidence[0]]
    second = run(spark, specs, changed, cache.unionByName(cache), f"file://{tmp_path}/b", log)
    assert {r["spec_id"] for r in second.filter("NOT reused").collect()} == {"s1"} and log[2:] == [["s1"], ["s1"]] and second.count() == 7
    third = run(spark, specs, evidence, cache, f"file://{tmp_path}/c", log, "v2")
    assert third.filter("reused").count() == 0
    assert run(spark, specs[:0], evidence, cache, f"file://{tmp_path}/d", log).count() == 0


def test_each_version_has_a_sample_of_its_own(spark):
    parts = spark.createDataFrame([(f"k{i}", f"s{i}", "v", "BP" if i % 2 else "CM", "q", "a", "accepted" if i < 180 else "rejected", []) for i in range(200)], "part_key string, spec_id string, video_id string, task_type string, question string, answer string, route string, reasons array<string>")
    one, two = ({r["spec_id"] for r in realizer.monitoring_sample(parts, 0.1, v).collect()} for v in ("v1", "v2"))
    assert len(one) == len(two) == 18 and one != two and one == {r["spec_id"] for r in realizer.monitoring_sample(parts.repartition(5), 0.1, "v1").collect()}
    assert not any(int(s[1:]) >= 180 for s in one)
