"""The pipeline's stages against plain Python on the smallest documents."""

from collections import defaultdict

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from sparkloom.llm import toxicity
from test_operators import brute_components, brute_rules, check_packing

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    lexicon = toxicity.fit(docs, labels)
    matcher = lexicon.automaton()
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    def toxic(text):
        import numpy as np

        words = toxicity.fold(text)
        weight = toxicity.weights_in(matcher, words)[0] if lexicon.entries else 0.0
        x = lexicon.bias + toxicity.features(np.array([weight]), np.array([len(words)])) @ np.array(lexicon.slopes)
        return 1 / (1 + np.exp(-x[0])) >= pipeline.TOXIC_FROM

    def passes(text):
        n, chars, symbols, dup, repeat = brute_rules(text)
        lines = sum(1 for x in text.split("\n") if x.strip(" \t\r\x0b\x0c"))
        return not (n < 10 or 100 * repeat > 20 * n or 50 * symbols > len(text) or 10 * dup > 3 * lines or chars < 2 * n or chars > 25 * n)

    last = {}
    want = [{i: t for i, t in rows.items() if not toxic(t)}]
    want.append({i: t for i, t in want[-1].items() if passes(t)})
    groups = defaultdict(list)
    for i, t in want[-1].items():
        groups[t].append(i)
    want.append({max(g): t for t, g in groups.items()})
    found = brute_components(list(want[-1].items()))
    want.append({i: t for i, t in want[-1].items() if found[i][1] == i})
    for n, ((name, stage), expected) in enumerate(zip(pipeline.STAGES, want)):
        path = str(tmp_path / str(n))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        last = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert last == expected, name
    packed = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == set(last)
    check_packing(packed, 4096)
    assert P.path("word_bpe_49k.json")


def test_run_equals_its_stages(spark):
    out = pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
