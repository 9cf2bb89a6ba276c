"""Every query with SQL against DuckDB on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from oracle import assert_same, tables
from sparkloom.operators import aggregates, joins, windows
from sparkloom.plans import oracles, pipelines, queries

SF = "/root/testdata/sf0.001"
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert_same(queries.queries()[name](spark, SF), con, SQL[name])


def test_similar_turns_against_a_loop(spark):
    rows = [(c, t, " ".join(f"w{(c * 7 + t * t) % 5 + i}" for i in range(14)) if t % 4 else None) for c in range(9) for t in range(12)]
    found = windows.greedy_distinct(spark.createDataFrame(rows, "conv_id int, turn int, stem string"), "conv_id", ["turn"], "stem").collect()
    want, kept = {}, {}
    for c, t, stem in sorted(rows, key=lambda r: r[:2]):
        words = set((stem or "").split())
        want[c, t] = all((len(words & k) / len(words | k) if words | k else 1.0) < 0.92 for k in kept.setdefault(c, []))
        if want[c, t]:
            kept[c].append(words)
    assert {(r["conv_id"], r["turn"]): r["accepted"] for r in found} == want and len(set(want.values())) == 2
    rows = queries.similar_turns(spark, SF).collect()
    assert rows and all(r["accepted"] for r in rows if r["turn"] == min(x["turn"] for x in rows if x["conv_id"] == r["conv_id"]))


def test_fingerprint_follows_rows_and_not_their_order(spark):
    of = lambda df, up="u": pipelines.stage_fingerprint(df, "k", up).first()["fingerprint"]
    df = spark.createDataFrame([(i, f"v{i}", None if i % 3 else 1.5) for i in range(50)], "k int, v string, x double")
    assert of(df) == of(df.orderBy("v").select("x", "k", "v")) == of(df.repartition(3))
    assert len({of(df), of(df, "other"), of(df.filter("k > 0")), of(df.union(df.limit(1))), of(df.withColumn("v", F.upper("v")))}) == 5


def test_quantiles_and_ranks_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    kinds = {"even": rng.uniform(-5, 9, 700), "tail": np.exp(rng.normal(0, 4, 700)), "ties": rng.integers(0, 4, 700).astype(float), "one": np.full(5, 3.0)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in kinds.items() for v in vs] + [("even", None), ("none", None)], "k string, v double")
    points = [0.0, 1 / 3, 0.5, 0.9, 1.0]
    got = {r["k"]: [r[f"q{i}"] for i in range(5)] for r in aggregates.group_quantiles(df, ["k"], "v", points, [f"q{i}" for i in range(5)]).collect()}
    assert set(got) == set(kinds) and all(np.allclose(got[k], np.quantile(v, points)) for k, v in kinds.items())
    assert aggregates.quantiles(df.limit(0), "v", [0.5], ["q"]).first()["q"] is None
    ranks = aggregates.tie_ranks(df, ["k"], "v", "r").filter("v IS NOT NULL").collect()
    for k, values in kinds.items():
        want = {v: (values < v).sum() + ((values == v).sum() + 1) / 2 for v in values}
        assert all(r["r"] == want[r["v"]] for r in ranks if r["k"] == k)


def test_nearest_points_against_a_loop(spark):
    import random

    rnd = random.Random(7)
    points = [(u, float(rnd.randint(0, 2000)), i) for i, u in enumerate(rnd.choices("abc", k=150))] + [("d", 5.0, 900)]
    ranges = [(u, i, float(s), float(s + rnd.randint(0, 6))) for i, (u, s) in enumerate((rnd.choice("abde"), rnd.randint(-500, 3000)) for _ in range(200))]
    found = joins.in_range_or_nearest(spark.createDataFrame(ranges, "u string, rid int, s double, e double"), spark.createDataFrame(points, "u string, at double, pid int"), ["u"], "s", "e", "at", "pid", 6.0).collect()
    want = set()
    for u, rid, s, e in ranges:
        mine = [(t, i) for v, t, i in points if v == u]
        inside = [i for t, i in mine if s <= t <= e]
        want |= {(rid, i, "direct") for i in inside}
        if mine and not inside:
            want.add((rid, min((abs(t - (s + e) / 2), i) for t, i in mine)[1], "nearest"))
    assert {(r["rid"], r["pid"], r["link"]) for r in found} == want and len(found) == len(want)


def test_weighted_nearest_points_against_a_loop(spark):
    import random

    rnd = random.Random(8)
    points = [(u, float(rnd.randint(0, 100)), i * 97_003 % 7_000_000) for i, u in enumerate(rnd.choices("abc", k=90))]
    ranges = [(u, i, float(s), float(s + rnd.randint(0, 3))) for i, (u, s) in enumerate((rnd.choice("abce"), rnd.randint(-20, 120)) for _ in range(200))]
    found = joins.in_range_or_nearest(spark.createDataFrame(ranges, "u string, rid int, s double, e double"), spark.createDataFrame(points, "u string, at double, pid bigint"), ["u"], "s", "e", "at", "pid", 5.0, 1_000_000).collect()
    want, plain = set(), 0
    for u, rid, s, e in ranges:
        mine = [(t, i) for v, t, i in points if v == u]
        inside = [i for t, i in mine if s <= t <= e]
        want |= {(rid, i, "direct") for i in inside}
        if mine and not inside:
            best = min((abs(t - (s + e) / 2) * 1_000_000 + i, abs(t - (s + e) / 2), i) for t, i in mine)[2]
            want.add((rid, best, "nearest"))
            plain += best == min((abs(t - (s + e) / 2), i) for t, i in mine)[1]
    assert {(r["rid"], r["pid"], r["link"]) for r in found} == want and len(found) == len(want) and 0 < plain < sum(w[2] == "nearest" for w in want)


def test_illustrated_where_ids_of_a_user_lie_far_apart(spark, tmp_path):
    whole = spark.read.parquet(f"{SF}/events.parquet")
    n = F.col("event_id")
    whole.withColumn("event_id", n + (F.xxhash64("event_id") % 30 + 30) * 100_000).write.parquet(f"{tmp_path}/events.parquet")
    assert_same(queries.queries()["illustrated"](spark, str(tmp_path)), tables(str(tmp_path)), SQL["illustrated"])


def test_strict_members_refuse_unknown_ids(spark):
    asked, members = spark.createDataFrame([(1, ["a", "z"])], "k int, ids array<string>"), spark.createDataFrame([("a", 1)], "m string, v int")
    assert joins.ordered_members(asked, "ids", members, "m", ["v"], "rows", "k").first()["rows"][0]["v"] == 1
    with pytest.raises(Exception, match="unknown id: z"):
        joins.ordered_members(asked, "ids", members, "m", ["v"], "rows", "k", strict=True).collect()


def test_bootstrap_interval_holds_the_mean(spark):
    for r in queries.bootstrap_means(spark, SF).collect():
        assert r["low"] <= r["mean"] <= r["high"]


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_benchmark_leaks_next_to_punctuation_and_short_items(spark, tmp_path):
    whole = "The cat sat on the mat today."
    items = [(0, whole), (1, "one two three four five"), (2, "word"), (3, "two words"), (4, " led by a blank, and ended by one "), (5, "never to be seen in any of the texts"), (6, None), (7, "six of them in a row"), (8, "")]
    texts = [f'He said: "{whole}"', f"({whole})", f"dash\u2014{whole}x", whole, "one two three four five, six", "zone two three four fives", "sword words", "is led by a blank, and ended by one too", "(six of them in a row)", "The cat sat  on the mat today.", "", None, whole]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None if i == 12 else i // 2, t) for i, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert_same(queries.benchmark_leaks(spark, str(tmp_path)), tables(str(tmp_path)), SQL["benchmark_leaks"])
