"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, least_chars=6, every=199):
    out = []
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least_chars:
                out.append(run)
    return Counter(out)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(counts, ratio=5):
    by_hole = {}
    for w in counts:
        for i in range(len(w)):
            by_hole.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    partners = {w: set() for w in counts}
    for w in counts:
        for i in range(len(w)):
            partners[w] |= by_hole[w[:i], w[i + 1 :]]
            if (shorter := w[:i] + w[i + 1 :]) in counts:
                partners[w].add(shorter)
                partners[shorter].add(w)
        partners[w].discard(w)
    form = {}
    for w, found in partners.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), counts[w], len(partners[w]), None if form[w] is None else counts[form[w]]) for w in counts)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def sure(rows):
    return sorted(rows, key=lambda r: r[0])


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    counts = {w: n for w, n in brute_words(docs).items() if n >= 5}
    got = sure(as_rows(queries.op11_spelling_variants(spark, sf)))
    assert got == sure(brute_forms(counts))
    assert any(r[1] for r in got)


def test_words_of_odd_texts(spark):
    texts = [(1, None), (2, ""), (3, "short"), (4, "ÀÉÎÖüß Straße×÷ABCdef"), (5, "x" * 70000 + "1" + "abcdefg_hijklmno"), (None, "nobody knows")] + [(i, f"wonderful Wonderful{'e' * (i % 4)} naïveté") for i in range(600)]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in texts], "doc_id bigint, text string, word string, n int")
    got = Counter(r[0] for r in spelling.damaged_words(docs).collect())
    assert got == brute_words(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_forms_of_random_vocabularies(spark, seed, monkeypatch):
    monkeypatch.setattr(spelling, "STEP", 50)
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("abÿ") for _ in range(rnd.randint(1, 9))) for _ in range(700)}
    counts = {w: rnd.choice([5, 5, 6, 26, 130, 700, 4000]) for w in words}
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n bigint, form string")
    assert sure(as_rows(spelling.spelling_forms(df))) == sure(brute_forms(counts))


def test_long_chain_hot_block_repeats_nulls_and_empty(spark):
    chain = {"a" * (6 + k): 5**k for k in range(1, 20)}
    hot = {f"common{a}{b}ending": 10 for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"}
    counts = chain | hot
    rows = [(w, n) for w, n in counts.items()] + [(None, 9), ("", 9), ("commonaaending", 5), ("b" * 3000, 7), ("b" * 3001, 70)]
    counts = counts | {"commonaaending": 15, "b" * 3000: 7, "b" * 3001: 70}
    assert sure(as_rows(spelling.spelling_forms(spark.createDataFrame(rows, "word string, n bigint")))) == sure(brute_forms(counts))
    assert as_rows(spelling.spelling_forms(spark.createDataFrame([], "word string, n bigint"))) == []


def test_grid_reports_rectangles():
    rnd = random.Random(4)
    words = np.unique(np.array(["".join(rnd.choice("abc") for _ in range(6)) for _ in range(300)]))
    grid = spelling.Grid(words)
    place = {w: i for i, w in enumerate(grid.by_end)}
    for _ in range(50):
        a, b = sorted(rnd.sample(range(len(words) + 1), 2))
        c, d = sorted(rnd.sample(range(len(words) + 1), 2))
        query, found = grid.reported(*(np.array([x]) for x in (a, b, c, d)))
        assert sorted(found) == sorted(place[w] for w in words[a:b] if c <= place[w] < d) and not query.any()


def test_plan_keeps_words_in_the_jvm_until_the_pairs(spark):
    docs = spark.createDataFrame([(1, "wonderful")], "doc_id bigint, text string")
    plan = spelling.vocabulary(spelling.damaged_words(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and F is not None
