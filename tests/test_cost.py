"""What an expression costs a row: how often it works its input out."""

from pyspark.sql import functions as F

from sparkloom.functions import numbers, text
from sparkloom.operators import joins, windows
from sparkloom.plans import item_queries, items, pipelines, queries, replies, staged, verification
from sparkloom.sources import sinks


def uses(column) -> int:
    return str(column(F.col("told"))).count("told")


def test_numbers_read_their_text_once(spark):
    assert uses(numbers.parse_number) == 1 and uses(numbers.confidence) == 2


def test_dates_and_times_read_their_text_once(spark):
    assert uses(numbers.parse_date) == 2 and uses(numbers.parse_time) == 2


def test_parts_of_a_span_are_worked_out_once(spark):
    assert str(numbers.parse_number(F.col("told"))).count("split(") == 1


def parsed_at(query) -> list[str]:
    """The nodes of the plan that look for numbers in text."""
    lines = query._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [line.lstrip(" :+-").split(" ")[0] for line in lines if "RLIKE(" in line and line.lstrip(" :")[:1] in "+P"]


def test_days_and_shares_of_a_day_are_parsed_once_each(spark):
    assert parsed_at(queries.order_dates(spark, "/root/testdata/sf0.001")) == ["Aggregate", "Aggregate"]


def test_what_sizes_are_written_as_is_parsed_once_each(spark):
    assert parsed_at(queries.parsed_numbers(spark, "/root/testdata/sf0.001")) == ["Project", "Aggregate"]  # prices are the row's own


def test_columns_by_distinct_are_made_once_a_value(spark):
    df = spark.createDataFrame([(i, [None, "a", "b"][i % 3]) for i in range(30)], "id int, k string").repartition(5)
    rows = joins.by_distinct(df, ["k"], [F.coalesce("k", F.lit("none")).alias("shown"), F.uuid().alias("made")]).collect()
    assert len(rows) == 30 and {(r["k"], r["shown"]) for r in rows} == {(None, "none"), ("a", "a"), ("b", "b")} and len({r["made"] for r in rows}) == 3


def test_odd_dates_and_numbers_mean_the_same(spark):
    dates = {"2024-02-30": "2024-02-30", "2024/02/29": "2024-02-29", "2024.01-01": "2024.01-01", "+12024-01-01": "+12024-01-01", "0000-01-01": "0000-01-01", " 2024/04/05\n": "2024-04-05", "1,0 0": "1900-04-09", "20240101x": "20240101x", "": ""}
    numbers_ = {"12\n": 12.0, "5%\u2028": 0.05, "1~": 1.0, "~": None, "1d": None, "1e3": None, "..5": None, "+.5": 0.5, "x~5%~1": 0.525, "- 3 ，0 k": -30_000.0}
    weeks = {"0000-01-01": "-001-W52", "2024/01/01": "unknown", "99-01-01\n1": "unknown", "2024-12-30 12:00": "2025-W01"}
    for make, cases in ((numbers.parse_date, dates), (numbers.parse_number, numbers_), (numbers.iso_week, weeks)):
        df = spark.createDataFrame([(x,) for x in cases], "told string")
        assert {r[0]: r[1] for r in df.select("told", make(F.col("told"))).collect()} == cases


def test_units_of_replies_are_parsed_once(spark, tmp_path, monkeypatch):
    plans, plain = {}, sinks.written_once

    def watched(spark, path, make):
        def seen():
            df = make()
            plans[path.rpartition("/")[2]] = df._jdf.queryExecution().optimizedPlan().toString()
            return df

        return plain(spark, path, seen)

    monkeypatch.setattr(sinks, "written_once", watched)
    unit = '{"evidence_id": "v_asr_1", "modality": "asr", "subject": "s", "predicate": "p", "value": "x", "content_en": "c", "source_text_native": "t", "confidence": "high"}'
    given = spark.createDataFrame([("v", "language_evidence_extraction", 1, "w", True, f'{{"evidence_units": [{unit}]}}', None)], staged.REPLIES)
    found = staged.Stages(spark, None, str(tmp_path), 0.7, 200).units("evidence_1", given)
    assert [r["evidence_id"] for r in found.collect()] == ["v_asr_1"]
    assert "from_json" not in plans["evidence_1_units"] and plans["evidence_1_objects"].count("from_json") == 1


def test_quality_verdicts_are_read_once(spark):
    asked = spark.createDataFrame([("s1", "{}")], "spec_id string, reply string")
    plan = replies.quality_reply(asked, "reply", "spec_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "get_json_object" not in plan


def test_patterns_of_texts_test_no_ascii_ranges_and_mean_the_same(spark):
    assert "-" not in text.NOT_BARE.replace(r"\x{4e00}-\x{9fff}", "")
    odd = ["", " ", "a", "A_b-c!d", "一二。三 ！ ? \n\n x", "。 　; x …é;\u0085", "\U00020000丂a豈㐀﫿\U0001f600", "ab\x00\x7f\x80! é… é", "é" * 30_000 + "a" * 9 + "…" + "éa" * 30_000]
    df = spark.createDataFrame([(x,) for x in odd], "told string")
    t = F.col("told")
    old_cjk = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
    pairs = {
        "bare": (text.bare(t), F.lower(F.regexp_replace(t, r"[^\x{4e00}-\x{9fff}A-Za-z0-9]+", ""))), "cjk": (text.contains_cjk(t), t.rlike(old_cjk)),
        "sentences": (F.regexp_count(t, F.lit(text.SENTENCE)), F.regexp_count(t, F.lit(r"(?U)[^。！？!?；;…\n\s][^。！？!?；;…\n]*"))),
    }
    for name, (new, old) in pairs.items():
        for row in df.select("told", new.alias("new"), old.alias("old")).collect():
            assert row["new"] == row["old"], (name, row["told"][:40])


def test_cross_modal_features_make_bare_texts_once(spark):
    docs = spark.createDataFrame([(1, "a b", "A-b c", "c", "b/cc")], "id bigint, title string, body string, product string, category string")
    plan = pipelines.cross_modal_features(docs, "id", "title", "body", "product", "category")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 5  # three texts, and pieces of the category: to choose them and to look for them


def test_audit_meets_all_references_in_one_join(spark):
    plan = item_queries.bank_audit(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2 and "Window" not in plan  # references, and videos with their tasks


def test_counts_of_conflicts_are_those_of_marked_rows(spark):
    rows = [("a", "x", 2), ("a", "x", 1), ("a", "y", 3), ("a", None, 4), ("b", None, 1), ("b", "x", 2), ("b", None, None), (None, "x", 1), (None, "x", 1), (None, "z", 2), ("c", "x", 1)]
    df = spark.createDataFrame(rows, "t string, v string, i int")
    marked = windows.marked_conflicts(df, ["t"], "v", ["i"]).collect()
    for part, want in ((df, (11, sum(r["duplicate"] for r in marked), sum(r["conflict"] for r in marked))), (df.limit(0), (0, 0, 0))):
        assert tuple(windows.conflict_counts(part, ["t"], "v", ["i"]).first()) == want


def test_an_entity_is_broken_once_however_many_references_are(spark):
    refs = spark.createDataFrame([("v", ["e1", "e1"], ["c1"]), ("v", ["e9", "e8"], ["c9"]), ("v", ["e2"], []), ("w", None, ["c1", "c1"])], "video_id string, units array<string>, cues array<string>")
    there = lambda name: spark.createDataFrame([(f"{name}1", "v"), (f"{name}2", "w")], "id string, video_id string")
    broken = items.broken_references([("r", refs, {"unit": refs.units, "cue": refs.cues}), ("s", refs, {"unit": refs.units})], {"unit": (there("e"), "id"), "cue": (there("c"), "id")}).collect()
    assert sorted((r["owner"], r["kind"]) for r in broken) == [("r", "cue"), ("r", "cue"), *[("r", "unit")] * 3, *[("s", "unit")] * 3] and len({r["row"] for r in broken if r["owner"] == "r"}) == 3


def test_calls_and_replies_are_made_once(spark):
    contexts = spark.createDataFrame([(f"r{i}", "v", "c", [i]) for i in range(30)], "relation_id string, video_id string, claim string, frames array<int>")
    seen = spark.sparkContext.accumulator(0)

    def ask(calls):
        def answered(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch

        reply = F.to_json(F.struct(F.transform("relations", lambda r: F.struct(r["relation_id"], F.lit("PASS").alias("verdict"), F.lit("seen").alias("reason"))).alias("verifications")))
        return calls.select("call", F.lit(True).alias("success"), reply.alias("reply")).mapInPandas(answered, "call string, success boolean, reply string")

    done = verification.verified_relations(contexts, ask).collect()
    assert {r["verdict"] for r in done} == {"PASS"} and len(done) == 30 and seen.value == verification.verification_calls(contexts).count()


def test_resampled_rows_carry_their_value_only(spark):
    plan = queries.bootstrap_means(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    drawn = plan.toString().partition("FlatMapCoGroupsInPandas")[2].splitlines()[1]
    assert drawn.lstrip(" :+-").startswith("Project [_key") and [c.strip().split("#")[0] for c in drawn.partition("[")[2].rstrip("]").split(", ")][-2:] == ["value", "n"] and "_sizes" not in plan.toString()


def test_units_keep_their_call_without_a_join(spark, tmp_path, monkeypatch):
    plans, plain = {}, sinks.written_once

    def watched(spark, path, make):
        def seen():
            df = make()
            plans[path.rpartition("/")[2]] = df._jdf.queryExecution().optimizedPlan().toString()
            return df

        return plain(spark, path, seen)

    monkeypatch.setattr(sinks, "written_once", watched)
    unit = '{"evidence_id": "v_asr_1", "modality": "asr", "subject": "s", "predicate": "p", "value": "x", "content_en": "c", "source_text_native": "t", "confidence": "high"}'
    given = spark.createDataFrame([("v", "language_evidence_extraction", 1, w, True, f'{{"evidence_units": [{unit}]}}', None) for w in ("w1", "w2")], staged.REPLIES)
    found = staged.Stages(spark, None, str(tmp_path), 0.7, 200).units("evidence_1", given).collect()
    assert sorted((r["stage"], r["attempt"], r["item"]) for r in found) == [("language_evidence_extraction", 1, "w1"), ("language_evidence_extraction", 1, "w2")]
    assert len({r["evidence_id"] for r in found}) == 2 and "v_asr_1" in {r["evidence_id"] for r in found} and "Join" not in plans["evidence_1_units"]
