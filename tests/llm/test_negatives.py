"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import assert_same, tables
from sparkloom.llm import negatives, queries

SCHEMA = "source string, vec_id bigint, embedding array<float>, label int, score double, block int"


def frame(spark, rows):
    return spark.createDataFrame([("s", i, v, y, 0.5, 9) for i, v, y in rows], SCHEMA)


def brute(rows, every, k, window=(80, 100)):
    fine = {(i, y, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, y, a in fine:
        if i % every:
            continue
        scored = sorted((-dot(a, b), j, z) for j, z, b in fine)
        for s, j, _ in [x for x in scored if x[1] != i and x[2] == y][:k]:
            found = [x for x in scored if x[2] != y and window[0] * -s <= 100 * -x[0] <= window[1] * -s][:k]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(found)]
    return sorted(out)


def mined(df, every, k, window=(80, 100)):
    out = negatives.mine(negatives.integer_vectors(df), F.col("vec_id") % every == 0, k, k, window)
    return sorted(tuple(r) for r in out.collect())


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(queries.op13_hard_negatives(spark, sf), tables(sf), queries.OP13_SQL)


@pytest.mark.parametrize("dims", [1, 5, 16])
def test_equals_brute_force_with_ties_repeats_and_hot_vectors(spark, dims):
    rnd = random.Random(dims)
    rows = [(i, [rnd.choice([-1.0, -0.25, 0.0, 0.3, 0.7, 1.5]) + (rnd.random() if i % 3 else 0) for _ in range(dims)], rnd.randint(0, 3)) for i in range(300)]
    rows += [(1000 + i, rows[4][1], i % 2) for i in range(120)]  # one very common vector
    rows += rows[:40]  # repeated rows
    rows += [(7, rows[9][1], 2), (20, rows[10][1], rows[20][2]), (20, rows[11][1], 3)]  # ids with several vectors
    assert mined(frame(spark, rows), 5, 4) == brute(rows, 5, 4)


def test_rows_that_take_no_part(spark):
    good = [(i, [0.5 + i / 100, 1.0 - i / 90], i % 2) for i in range(20)]
    bad = [(None, [1.0, 1.0], 0), (31, None, 0), (32, [1.0, None], 1), (33, [float("nan"), 1.0], 0), (34, [float("inf"), 1.0], 1), (35, [1.0, 1.0], None), (36, [], 1)]
    assert mined(frame(spark, good + bad), 5, 5) == brute(good + [(36, [0.0, 0.0], 1)], 5, 5)


def test_shorter_vectors_are_filled_up_with_zeros(spark):
    rows = [(i, [0.5] * (1 + i % 3), i % 2) for i in range(12)]
    assert mined(frame(spark, rows), 4, 3) == brute([(i, v + [0.0] * (3 - len(v)), y) for i, v, y in rows], 4, 3)


def test_empty_tables_single_rows_and_scores_beyond_a_long(spark):
    assert mined(frame(spark, []), 5, 5) == []
    assert mined(frame(spark, [(0, [1.0], 1)]), 5, 5) == []
    assert mined(frame(spark, [(0, [1.0, 2.0], 1), (5, [1.0, 2.0], 1)]), 5, 5) == []
    with pytest.raises(ValueError, match="do not fit"):
        mined(frame(spark, [(0, [3e8], 1), (1, [3e8], 1)]), 5, 5)


def test_bounds_hold_for_every_pair():
    rnd = np.random.default_rng(3)
    for scale in (3, 300, 30000):
        q = rnd.integers(-scale, scale, (400, 10))
        books = negatives.Codebooks(q[:50])
        codes = books.encode(q)
        est, off = books.estimates(q, codes).astype(float), books.off(q, codes)
        assert (np.abs(q @ q.T - est) <= np.linalg.norm(q, axis=1)[:, None] * off[None, :]).all()
