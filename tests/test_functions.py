"""Inline cases with expected values."""

import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import nested, numbers, text
from sparkloom.operators import aggregates, joins, rules, windows
from sparkloom.sources import scans, sinks


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_parse_number(spark):
    cases = {"1,234": 1234.0, "3.5w": 35000.0, "2亿": 2e8, "12k": 12000.0, "1 w": 10000.0, "45%": 0.45, "1~3": 2.0, "1w~3w": 20000.0, "1~x": 1.0, "x~y": None, ".5": 0.5, "5.": 5.0, "-4": -4.0, "-": None, "—": None, "N/A": None, "NaN": None, "1e3": None, "万": None, "": None}
    assert values(spark, list(cases), numbers.parse_number) == pytest.approx(list(cases.values()))
    assert values(spark, [None], numbers.parse_number) == [None]


def test_dates_and_times(spark):
    assert values(spark, ["45387", "2024/04/05", "soon"], numbers.parse_date) == ["2024-04-05", "2024-04-05", "soon"]
    assert values(spark, ["0.5", "0.999999", "x"], numbers.parse_time) == ["12:00:00", "00:00:00", ""]
    assert values(spark, ["2024-12-30", "2021-01-03", "no"], numbers.iso_week) == ["2025-W01", "2020-W53", "unknown"]


def test_text(spark):
    df = spark.createDataFrame([("abcd", "bcde"), ("", ""), ("ab", "ab")], "a string, b string")
    got = df.select(text.jaccard(text.char_ngrams(F.col("a")), text.char_ngrams(F.col("b"))), text.char_ngrams(F.col("a"))).collect()
    assert [r[0] for r in got] == [0.5, 0.0, 1.0] and got[2][1] == ["ab"]
    assert values(spark, ["a。b!!c", "。", "", None], text.sentence_count) == [3, 1, 0, 0]
    assert values(spark, [" a　 b ", None], text.normalize_blanks) == ["a b", ""]
    assert values(spark, ["x <ANSWER> y\n</answer>", " z "], text.tagged_answer) == ["y", "z"]
    empty = spark.createDataFrame([("", "")], "a string, b string").select(text.jaccard(text.token_set(F.col("a")), text.token_set(F.col("b")), 1.0)).first()[0]
    assert empty == 1.0


def test_judge_score(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.5), (0.75, 0.5, 0.25), (1.0, 0.0, 1.0), (0.25, 1.0, 1.0)], "c double, g double, k double")
    assert [r[0] for r in df.select(numbers.judge_score(F.col("c"), F.col("g"), F.col("k"))).collect()] == [1.0, 0.5, 0.25, 0.5]


def test_frame_grid(spark):
    got = values(spark, [29.0, 2.0, 0.0], numbers.frame_grid, "double")
    assert got[0][:5] == [0.5, 1.5, 2.5, 4.0, 6.0] and got[0][-1] == 28.0 and got[1] == [0.33, 1.0, 1.67] and got[2] == [0.0]


def test_quantiles(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (9,)], "x int")
    assert aggregates.quantiles(df, "x", [0.25, 1 / 3], ["a", "b"]).first()[:] == pytest.approx((1.75, 2.0))
    assert aggregates.quantiles(df.limit(0), "x", [0.25], ["a"]).first()[0] is None


def test_score_report(spark):
    df = spark.createDataFrame([("BP", 1.0, True), ("CM", 0.75, True), ("AE", 0.25, True), ("SS", None, False)], "task string, score double, ok boolean")
    got = {r["block"]: r for r in aggregates.score_report(df, "task", "score", "ok").collect()}
    assert got["micro"]["strict"] == pytest.approx(1 / 3, abs=1e-6) and got["micro"]["relaxed"] == pytest.approx(2 / 3, abs=1e-6)
    assert got["macro"]["count"] == 3 and got["macro"]["relaxed"] == pytest.approx(2 / 3, abs=1e-6) and got["micro"]["failed"] == 1


def test_closure(spark):
    refs = spark.createDataFrame([("a", "v1"), ("b", "v1"), (None, "v1")], "id string, owner string")
    there = spark.createDataFrame([("a", "v1"), ("b", "v2")], "tid string, towner string")
    good = joins.closure(refs.filter("id = 'a'"), "id", "owner", there, "tid", "towner", "k")
    assert good.first()["closure_percent"] == 100.0
    bad = joins.closure(refs, "id", "owner", there, "tid", "towner", "k")
    assert bad.first()["n_cross_owner"] == 1
    with pytest.raises(ValueError):
        joins.assert_closed(bad)
    assert joins.closure(refs.limit(0), "id", "owner", there, "tid", "towner", "k").first()["closure_percent"] == 100.0


def test_duplicates_and_conflicts(spark):
    df = spark.createDataFrame([(1, "t", "a"), (2, "t", "a"), (3, "t", "b"), (4, "t", "a")], "i int, t string, v string")
    got = windows.marked_conflicts(df, ["t"], "v", ["i"]).orderBy("i").collect()
    assert [r["duplicate"] for r in got] == [False, True, False, True] and [r["conflict"] for r in got] == [False, False, True, False]


@pytest.mark.parametrize("n,sizes", [(1, (1, 0, 0)), (2, (1, 0, 1)), (3, (1, 1, 1)), (5, (3, 1, 1)), (10, (8, 1, 1)), (100, (80, 10, 10))])
def test_group_split(spark, n, sizes):
    df = spark.range(n).select(F.concat(F.lit("g"), "id").alias("g"))
    got = {r["split"]: r["n"] for r in windows.group_split(df.union(df), "g").groupBy("split").agg(F.countDistinct("g").alias("n")).collect()}
    assert tuple(got.get(k, 0) for k in ("train", "val", "test")) == sizes


@pytest.mark.parametrize("n,size", [(9, 1), (11, 2), (0, 0)])
def test_hash_sample_size_and_order(spark, n, size):
    df = spark.range(n).select("id", F.lit("s").alias("s"))
    got = sorted(r["id"] for r in windows.hash_sample(df, "s", "id", 0.1).collect())
    assert len(got) == size and got == sorted(r["id"] for r in windows.hash_sample(df.orderBy(F.desc("id")), "s", "id", 0.1).collect())


def test_quota_select_is_greedy(spark):
    import itertools
    import random

    rnd = random.Random(3)
    rows = [(e, rnd.randint(0, 2), rnd.randint(0, 2), i) for i, e in enumerate(rnd.randint(0, 4) for _ in range(120))]
    want = []
    for e, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        taken, tasks, caps = 0, {}, {}
        for _, t, c, i in sorted(group, key=lambda r: r[3]):
            if taken < 4 and tasks.get(t, 0) < 2 and caps.get((t, c), 0) < 1:
                taken, tasks[t], caps[t, c] = taken + 1, tasks.get(t, 0) + 1, 1
                want.append(i)
    df = spark.createDataFrame(rows, "e int, t int, c int, i int")
    assert sorted(r["i"] for r in windows.quota_select(df, "e", "t", "c", ["i"], most=4).collect()) == sorted(want)


def test_routing(spark):
    codes = ["ABSTENTION", "CHALLENGER_REVISE", "BELOW_MIN_CONFIDENCE", "SEMANTIC_VERIFIER_AMBIGUOUS", "ADJUDICATOR_OMITTED", "SOMETHING", None]
    got = values(spark, codes, rules.disposition)
    assert [tuple(r) for r in got] == [("REJECT", "diagnostics"), ("REPAIR", "diagnostics"), ("REJECT", "rejected"), ("HUMAN_REVIEW", "queue"), ("REJECT", "diagnostics"), ("HUMAN_REVIEW", "queue"), ("ACCEPT", "accepted")]


def test_private_fields(spark):
    df = spark.createDataFrame([(1, 2, (3,))], "id int, Likes int, s struct<followers: int>")
    with pytest.raises(ValueError):
        nested.assert_public(df)
    assert nested.public(df).columns == ["id", "s"]


def test_degenerate_statistics(spark):
    flat = spark.createDataFrame([("g", 1.0, 2.0)] * 4, "g string, x double, y double")
    assert aggregates.spearman(flat, ["g"], "x", "y").first()["rho"] is None
    one = spark.createDataFrame([("g", 1.0, 1)] * 3, "g string, s double, l int")
    assert aggregates.roc_auc(one, ["g"], "s", "l").first()["auc"] is None


def test_range_join_falls_back_to_nearest(spark):
    ranges = spark.createDataFrame([("k", 0.0, 2.0), ("k", 10.0, 11.0)], "k string, a double, b double")
    points = spark.createDataFrame([("k", 1.0, 1), ("k", 8.0, 2), ("k", 13.0, 3)], "k string, t double, i int")
    got = {(r["a"], r["i"], r["link"]) for r in joins.in_range_or_nearest(ranges, points, ["k"], "a", "b", "t", "i", 3.0).collect()}
    assert got == {(0.0, 1, "direct"), (10.0, 2, "nearest")}


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "a")], "id int, x string")
    sinks.write_jsonl(df, str(tmp_path / "o.jsonl"), ["id"])
    assert [r["id"] for r in scans.scan(spark, str(tmp_path / "o.jsonl"), "id int, x string").collect()] == [1, 2]
    assert scans.scan_or_empty(spark, str(tmp_path / "none.jsonl"), "id int").count() == 0
    with pytest.raises(ValueError):
        scans.scan(spark, "x.txt")
    assert scans.clean_headers(["a", "", "A", "a"]) == ["a", "unnamed_2", "A__2", "a__3"]
    assert scans.column_index("AA1") == 26


def test_workbook(spark, tmp_path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    path = tmp_path / "b.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>id</t></si><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="C2" t="inlineStr"><is><t>x</t></is></c></row><row><c r="A3"><v> </v></c></row></sheetData></worksheet>')
    got = scans.read_workbook(spark, str(path))
    assert got.columns == ["id", "unnamed_2", "name"] and [tuple(r) for r in got.collect()] == [("", "", "x")]
    with pytest.raises(ValueError):
        next(scans.Workbook(path.read_bytes()).rows("T"))


def test_streams(spark):
    from sparkloom.streaming import events

    stream = events.windowed_counts(events.event_stream(spark, "/root/testdata/sf0.001"))
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_headers_never_repeat_and_workbooks_are_read_by_uri(spark, tmp_path):
    assert scans.clean_headers(["a", "a", "a__2", "A", " "]) == ["a", "a__2", "a__2__2", "A__3", "unnamed_5"]
    test_workbook(spark, tmp_path)
    assert scans.sheet_names(f"file://{tmp_path}/b.xlsx") == scans.sheet_names(str(tmp_path / "b.xlsx")) == ["S"]
    assert scans.read_workbook(spark, f"file://{tmp_path}/b.xlsx").count() == 1


def test_first_rows_are_folds_with_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "y"), (None, 5, "z"), (None, None, "w"), ("b", 1, None), ("b", 2, "q")], "k string, o int, v string")
    first, later = windows.keep_first(df, ["k"], ["o"])
    assert sorted(map(tuple, first.collect()), key=repr) == sorted([("a", 1, "y"), ("b", 1, None), (None, None, "w")], key=repr)
    assert sorted(map(tuple, later.collect()), key=repr) == sorted([("a", 1, "y", "DUPLICATE"), ("a", 2, "x", "DUPLICATE"), ("b", 2, "q", "DUPLICATE"), (None, 5, "z", "DUPLICATE")], key=repr)
    marked = sorted(((r["k"], r["o"], r["duplicate"], r["conflict"]) for r in windows.marked_conflicts(df, ["k"], "v", ["o"]).collect()), key=repr)
    assert marked == sorted([("a", 1, False, False), ("a", 1, True, False), ("a", 2, False, True), (None, None, False, False), (None, 5, False, True), ("b", 1, False, False), ("b", 2, False, True)], key=repr)
    assert windows.keep_first(df.limit(0), ["k"], ["o"])[0].count() == 0
