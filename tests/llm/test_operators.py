"""Each operator against brute force or exact round trips, with edge cases."""

import base64
import gzip
import hashlib
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import assert_same, tables
from sparkloom.llm import byte_bpe, exact_dedup, langid, licenses, ngram_join, packing, quality_rules, queries, tokens, toxicity, warc, wavelet

SF = "/root/testdata/sf0.001"
RND = random.Random(5)
VOCAB = ["the", "of", "a", "b", "c", "über", "x1", "y,", "z."]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def random_text(n):
    return "".join(RND.choice(VOCAB) + RND.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(n))


def near_copies():
    """Bases with edited copies, exact copies, short and empty texts, a hot group and a shared passage."""
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [None, "", "  ", "one", "ONE", "one two", "a b c d e", "A B c d e", "a b c d f"]
    for b in range(25):
        words = [f"w{b}_{RND.randint(0, 400)}" for _ in range(RND.randint(8, 120))]
        for _ in range(RND.randint(1, 5)):
            edited = list(words)
            for _ in range(RND.randint(0, 5)):
                edited[RND.randrange(len(edited))] = f"e{RND.randint(0, 9)}"
            texts.append(" ".join(edited))
        texts.append(" ".join(words) + " " + passage)
    hot = [f"h{i}" for i in range(80)]
    for i in range(60):
        edited = list(hot)
        edited[RND.randrange(80)] = f"q{i}"
        texts.append(" ".join(edited))
    texts += ["same text for many"] * 40
    return texts


def brute_components(rows, n=5, percent=75):
    sets = {}
    for i, t in rows:
        words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both) and find(x) != find(y):
                    parent[max(find(x), find(y))] = min(find(x), find(y))
    least = defaultdict(lambda: 1 << 60)
    for i in ids:
        least[find(i)] = min(least[find(i)], i)
    return {i: (len(sets[i]), least[find(i)]) for i in ids}


@pytest.mark.parametrize("unit", [4_000_000, 4_000, 400, 60])
def test_ngram_join_against_brute_force(docs_of, unit):
    rows = list(enumerate(near_copies()))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(docs_of(rows).repartition(3), unit_postings=unit).collect()}
    assert got == brute_components(rows)


def test_ngram_join_edges(docs_of):
    assert ngram_join.ngram_join(docs_of([])).count() == 0
    got = ngram_join.ngram_join(docs_of([(7, "a b c d e f"), (7, "a b c d e f"), (3, "a b c d e f"), (None, "a b c"), (9, "x")]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(7, 2, 3), (7, 2, 3), (3, 2, 3), (None, 1, None), (9, 1, 9)], key=str)
    kept = ngram_join.keep_one(docs_of([(7, "a b c d e f"), (3, "a b c d e f"), (9, None)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 9] and kept.columns == docs_of([]).columns
    two = ngram_join.keep_one(docs_of([(5, "u v w x y z"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f")]))
    assert sorted(((r["doc_id"], r["text"][0]) for r in two.collect()), key=str) == [(3, "a"), (5, "a"), (5, "u"), (None, "a")]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), tables(SF), queries.oracle_sql()[name])


def brute_rules(text):
    text = text or ""
    words = WORDS.findall(text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = set()
    for i in range(len(words) - 4):
        if seen[tuple(words[i : i + 5])] > 1:
            repeated.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_quality_rules_against_brute_force(docs_of):
    texts = [None, "", " \n\t", "one", "a b c d e", "a a a a a a", "a b c d e a b c d e", "# | x\n# | x\n\n\n", "é ü\x0b\x0cß", "  x"] + [random_text(RND.randint(1, 60)) for _ in range(120)]
    got = {r["doc_id"]: r for r in quality_rules.ledger(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_rules(t), t


def test_quality_policies_and_ablations(docs_of):
    docs = docs_of(["one two", " ".join(f"w{i}" for i in range(30)), " ".join(f"w{i} $$$" for i in range(30)), None])
    entries = quality_rules.apply_policy(quality_rules.ledger(docs))
    assert [r["kept"] for r in entries.orderBy("doc_id").collect()] == [False, True, False, False]
    got = {r["rule"]: r for r in quality_rules.ablations(entries).collect()}
    assert got["few_words"]["n_failed"] == 2 and got["symbols"]["n_only"] == 1 and got["symbols"]["n_kept_without"] == 2
    assert quality_rules.mask_of(("base", 1)) == 3 and quality_rules.ledger(docs_of([])).count() == 0
    assert [r["doc_id"] for r in quality_rules.keep_passing(docs).collect()] == [1]


def test_exact_dedup(docs_of):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (2, "a"), (6, "A  b"), (7, "a b")] + [(100 + i, "hot") for i in range(500)]
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs_of(rows)).collect())
    texts = defaultdict(list)
    for i, t in rows:
        texts[t or ""].append(i)
    assert got == sorted((i, max(texts[t or ""]), len(texts[t or ""]), i == max(texts[t or ""])) for i, t in rows)
    docs = docs_of(rows)
    level = exact_dedup.merge_level(exact_dedup.sorted_runs(exact_dedup.digest_runs(docs), 8, "largest"), 4, "largest")
    plan = level._jdf.queryExecution().executedPlan().toString()
    assert "Sort [_range" in plan and "Window" in plan and plan.index("Window") < plan.index("Sort [_range") < plan.index("REPARTITION_BY_NUM")
    assert exact_dedup.sorted_runs(exact_dedup.digest_runs(docs), 8, "largest")._jdf.queryExecution().executedPlan().toString().count("Sort [_range") == 1
    small = exact_dedup.exact_dedup(docs_of(rows), keep="smallest", how="words", runs=3, fan_in=2)
    assert {r["doc_id"]: r["keep_id"] for r in small.collect()}[7] == 6
    assert exact_dedup.exact_dedup(docs_of([])).count() == 0
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(docs_of([(1, "a"), (2, "a"), (3, None)])).collect()) == [2, 3]
    two = exact_dedup.drop_copies(docs_of([(5, "A"), (5, "B"), (9, "B"), (None, "B")]))
    assert sorted(((r["doc_id"], r["text"]) for r in two.collect()), key=str) == [(5, "A"), (9, "B"), (None, "B")]


def test_toxicity_learns_folded_words_and_stems(spark, docs_of):
    rows, labels = [], []
    for i in range(400):
        words = [f"w{RND.randint(0, 300)}" for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            words.insert(RND.randrange(40), RND.choice(["grumble", "zorkel" + RND.choice(["en", "um", "ab", "st"])]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    lexicon = toxicity.fit(docs_of(rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert " grumble " in lexicon.entries and any(e.startswith(" zorkel") for e in lexicon.entries)
    probe = docs_of([None, "", "w1 w2 w3", "w1 GRUMBL3 w2", "w1 grumbӏe zorkelung " + "w4 " * 200, "grumbles"])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(probe, lexicon).collect()}
    assert got[3] >= 0.7 and got[4] >= 0.7 and max(got[0], got[1], got[2], got[5]) < 0.3
    assert sorted(r["doc_id"] for r in toxicity.reject(probe, lexicon).collect()) == [0, 1, 2, 5]
    hidden = toxicity.Lexicon(lexicon.entries, lexicon.bias, lexicon.slopes, ("grumble bee",))
    assert {r["doc_id"]: r["n_matches"] for r in toxicity.score(docs_of(["a grumble bee", "a grumble b"]), hidden).collect()} == {0: 0, 1: 1}
    assert toxicity.fit(docs_of([]), spark.createDataFrame([], "doc_id bigint, toxic int")).entries == {}


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = queries.op3_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out")
    hit = got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0]
    assert hit > 0.95


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.97


def test_language_id_edges(spark, docs_of):
    model = langid.fit(docs_of([(i, "the cat sat on the mat " * 3) for i in range(5)]))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs_of([None, "", "12 34 !?", "the mat", "ъ"]), model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3] == ("en", 1.0) and got[4][0] == "en"
    empty = langid.fit(docs_of([]))
    assert langid.identify(docs_of(["abc"]), empty).first()["lang_pred"] == "und"


ALPHABET = list("ab Z9.,'\n\t  -_é×÷ñÜß  　́中ΣİſK😀\x85\x1c#$<|>") + ["'s", " the", "\n\n", ". ", " ,", "<|endoftext|>", "<|startoftext|>", " <|endoftext|>", "<|endoftext|> "]


def odd_texts(n):
    return [None, "", " ", "\n"] + ["".join(RND.choice(ALPHABET) for _ in range(RND.randint(0, 50))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_piece_encoder_equals_the_library(name):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path(name))
    texts = odd_texts(1500)
    ids, counts = tokens.tokenizers_encoder(P.path(name))(pa.array(texts, pa.string()))
    at = np.r_[0, np.cumsum(counts)]
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == model.encode(t or "", add_special_tokens=False).ids, t


def test_piece_encoder_over_slices(monkeypatch):
    """Slices in turn, with pieces that come once, come again, share a mark, and more than are remembered."""
    from tokenizers import Tokenizer

    for name, value in (("LEARNED", 5), ("MARKS", 64), ("REMEMBERED", 90)):
        monkeypatch.setattr(tokens, name, value)
    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    encoder = tokens.PieceEncoder(lambda xs: [x.ids for x in model.encode_batch_fast(xs, add_special_tokens=False)])
    texts = odd_texts(300)
    most = 0
    for a in (*range(0, 300, 20), 0, 40):
        ids, counts = encoder(pa.array(texts[a : a + 20], pa.string()))
        most = max(most, len(encoder.known))
        at = np.r_[0, np.cumsum(counts)]
        for i, t in enumerate(texts[a : a + 20]):
            assert ids[at[i] : at[i + 1]].tolist() == model.encode(t or "", add_special_tokens=False).ids, t
    assert most > 90 and len(encoder.known) < most


def test_byte_bpe_round_trip(docs_of):
    import tiktoken

    ranks = P.path("byte_bpe_50k.tiktoken")
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    model = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})
    texts = odd_texts(400)
    encoded = byte_bpe.encode_documents(docs_of(texts).repartition(3), ranks, P.PATTERN)
    got = {r["doc_id"]: r for r in byte_bpe.decode_ids(encoded.withColumn("n", F.size("ids")), ranks).collect()}
    want = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    for i, t in enumerate(texts):
        assert want[i] == model.encode_ordinary(t or "") and bytes(got[i]["decoded"]) == (t or "").encode()
    assert byte_bpe.encode_documents(docs_of([]), ranks, P.PATTERN).count() == 0
    assert byte_bpe.encode_documents(docs_of([(None, "a b"), (1, "a b"), (1, "a b")]), ranks, P.PATTERN).count() == 3


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    for n, top in ((1, 5), (5000, 50_000), (12_345, 3)):
        ids = rng.integers(0, top, n)
        file = wavelet.WaveletMatrix.build(ids, 16).to_bytes([3, None], np.array([1, n - 1]))
        matrix, names, lengths = wavelet.WaveletMatrix.from_bytes(file)
        assert (matrix.ids() == ids).all() and names.to_pylist() == [3, None] and lengths.tolist() == [1, n - 1]
        for i in {0, n - 1, n // 2, min(4096, n - 1)}:
            t = int(ids[i])
            places = np.flatnonzero(ids == t)
            assert matrix.access(i) == t and matrix.rank(t, i) == (ids[:i] == t).sum() and matrix.count(t) == len(places)
            assert [matrix.select(t, k) for k in range(min(5, len(places)))] == places[:5].tolist()
        with pytest.raises(IndexError):
            matrix.select(60_000, 0)


def test_token_shards_round_trip(spark, docs_of, tmp_path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(int(i), t) for i, t in zip(RND.sample(range(10_000), 304), odd_texts(300))]
    path = str(tmp_path / "shards")
    wavelet.write_shards(docs_of(rows), P.path("byte_bpe_50k.json"), path, end_id=2, shard_tokens=500)
    got = {r["doc_id"]: r for r in wavelet.read_shards(spark, path).collect()}
    start, n_two = 0, 0
    for i, t in sorted(rows):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start, n_two = start + len(ids), n_two + ids.count(2)
    assert wavelet.lookup(spark, path, [2]).agg(F.sum("n")).first()[0] == n_two
    assert wavelet.round_trip(docs_of([]), P.path("byte_bpe_50k.json"), 2).count() == 0


def check_packing(rows, room):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    return len(by)


@pytest.mark.parametrize("kind", ["mixed", "hot", "tiny", "full", "none"])
def test_packing_plans(spark, kind):
    rng = np.random.default_rng(4)
    lengths = {"mixed": np.minimum(256, rng.lognormal(4, 1, 3000).astype(int) + 1), "hot": np.full(2000, 100), "tiny": np.ones(500, int), "full": np.full(300, 256), "none": np.zeros(0, int)}[kind]
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, packing.PIECES)
    got = packing.pack_pieces(df, 256, bins=32).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(lengths)))
    n = check_packing(got, 256)
    bound = {"hot": 1000}.get(kind, -(-int(lengths.sum()) // 256))
    assert n <= bound * 1.02 + 1


def test_packed_documents_hold_their_ids(docs_of):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [None, "", "hello world", "a b c " * 40, "x " * 300, "a <|endoftext|> b", "<|startoftext|>x<|endoftext|>. y " * 40]
    docs = docs_of(texts)
    packed = packing.pack_documents(docs, P.path("word_bpe_49k.json"), end_id=1, room=64)
    rows = packed.collect()
    check_packing(rows, 64)
    want = {i: [*model.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    for r in rows:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and r["start"] == 64 * r["piece"]
    made = packing.sequences(docs, packed, P.path("word_bpe_49k.json"), 1, 64).collect()
    assert sum(len(r["ids"]) for r in made) == sum(map(len, want.values()))


def test_nnls_solves_and_stays_positive():
    rng = np.random.default_rng(0)
    a, x = rng.random((30, 12)), np.maximum(rng.random(12) - 0.4, 0)
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    assert (packing.nnls(a, -np.ones(30)) == 0).all()


def test_license_scan(docs_of):
    mit = licenses.TEMPLATES["MIT"]
    edited = mit.replace("free of charge", "free of any charge").replace("deal in", "work with")
    docs = docs_of([None, "", "no terms here", f"x y {mit} z", f"intro. {edited}", "Licensed under the Apache License, Version 2.0.", "licensed under nothing at all"])
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan(docs).collect()}
    assert got[3, "MIT"]["coverage"] == 1.0 and got[4, "MIT"]["coverage"] > 0.9 and got[5, "Apache-2.0 line"]["coverage"] == 1.0
    assert {i for i, _ in got} == {3, 4, 5}
    text = f"x y {mit} z"
    assert text[got[3, "MIT"]["start_char"] : got[3, "MIT"]["end_char"]] == mit.rstrip(".")
    assert licenses.scan(docs_of([])).count() == 0


def full_alignment(words, template, needed=frozenset()):
    """Longest common subsequence of whole sequences in which the needed places of the template match; -1 if they cannot."""
    lost = -len(template) - 1
    best = [0] * (len(words) + 1)
    for i, x in enumerate(template):
        row = [lost if i in needed else best[0]]
        for j, y in enumerate(words):
            row.append(max(row[j], lost if i in needed else best[j + 1], best[j] + 1 if x == y else lost))
        best = row
    return max(best[-1], -1)


def test_license_alignment_against_full_table():
    rnd = random.Random(1)
    for _ in range(300):
        template = [rnd.choice("abcd") for _ in range(rnd.randint(1, 12))]
        words = [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))]
        needed = frozenset(i for i in range(len(template)) if rnd.random() < 0.15)
        n, first, last = licenses.align(np.array(words), np.array(template), 0, 13, 0, None, needed)
        assert n == max(0, full_alignment(words, template, needed))
        if n:
            assert full_alignment(words[first : last + 1], template, needed) == n


def words_of(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text)]


def edited_notices(name, n, seed):
    """Copies of a notice with random words replaced, dropped and put in, between other words."""
    rnd = random.Random(f"{seed} {name}")
    words = words_of(licenses.TEMPLATES[name])
    for _ in range(n):
        out = list(words)
        for _ in range(rnd.randint(1, max(1, len(words) // 6))):
            at, kind = rnd.randrange(len(out)), rnd.choice("rdi")
            if kind == "i":
                out[at:at] = [f"zz{rnd.randint(0, 99)}"]
            else:
                out[at : at + 1] = [f"zz{rnd.randint(0, 99)}"] if kind == "r" else []
        yield " ".join([f"q{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 20))] + out + [f"q{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 20))])


def pushed_apart(name, n, seed):
    """Whole notices with 9 to 14 other words put in at one place."""
    rnd = random.Random(f"{seed} {name}")
    words = words_of(licenses.TEMPLATES[name])
    for _ in range(n):
        at = rnd.randrange(1, len(words))
        yield " ".join(words[:at] + [f"zz{i}" for i in range(rnd.randint(9, 14))] + words[at:])


def found_by(texts, batch=4):
    run = licenses.scanner(licenses.TEMPLATES, licenses.Settings())
    rows = defaultdict(set)
    for a in range(0, len(texts), batch):
        part = texts[a : a + batch]
        for out in run(iter([pa.RecordBatch.from_arrays([pa.array(range(a, a + len(part)), pa.int64()), pa.array(part, pa.string())], ["doc_id", "text"])])):
            for r in out.to_pylist():
                rows[r["doc_id"]].add(tuple(r.values()))
    return rows


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_license_recall_against_brute_force(name):
    """Of edited notices whose best alignment with the template covers 0.75, at least 0.95 are reported (as it, or as a better-covering neighbour)."""
    template = words_of(licenses.TEMPLATES[name])
    telling = licenses.REQUIRED & set(template)
    texts = list(edited_notices(name, 200, 3))
    # plain alignment of the whole; a text that lost a telling word altogether tells no license from its neighbours
    true = [i for i, t in enumerate(texts) if telling <= set(words_of(t)) and full_alignment(words_of(t), template, frozenset()) >= 0.75 * len(template)]
    found = found_by(texts)
    assert len(true) >= 40 and sum(bool(found[i]) for i in true) >= 0.95 * len(true)
    if len(template) > 60:
        found = found_by(list(pushed_apart(name, 60, 5)))
        assert sum(bool(found[i]) for i in range(60)) >= 57


def test_license_scan_does_not_depend_on_neighbours():
    texts = [t for name in ("MIT line", "Apache-2.0 line", "CC-BY-4.0") for t in edited_notices(name, 60, 8)]
    random.Random(2).shuffle(texts)
    alone, together = found_by(texts, 1), found_by(texts, 60)
    assert {i: x for i, x in alone.items() if x} == {i: x for i, x in together.items() if x}


def test_license_lines_repeated_back_to_back(docs_of):
    lines = {k: v for k, v in licenses.TEMPLATES.items() if len(v.split()) <= 16}
    docs = docs_of([" ".join([v] * n) for v in lines.values() for n in (1, 2, 5, 40)])
    got = Counter((r["doc_id"], r["license"]) for r in licenses.scan(docs).collect())
    assert {(i, k): got[i, k] for i, k in enumerate(k for k in lines for _ in range(4))} == {(i * 4 + j, k): n for i, k in enumerate(lines) for j, n in enumerate((1, 2, 5, 40))}
    damaged = "Released under the MIT notice. Released under the MIT License. Released, as it was told, under the MIT License."
    assert licenses.scan(docs_of([damaged])).filter("license = 'MIT line'").count() == 3


def test_whole_notices_and_their_neighbours(docs_of):
    names = list(licenses.TEMPLATES)
    rows = licenses.scan(docs_of([f"x {licenses.TEMPLATES[k]} y" for k in names])).collect()
    assert sorted((r["doc_id"], r["license"], r["coverage"]) for r in rows) == [(i, k, 1.0) for i, k in enumerate(names)]
    mit, bsd = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["BSD-3-Clause"]
    assert mit.endswith("OTHER DEALINGS IN THE SOFTWARE.") and bsd.endswith("POSSIBILITY OF SUCH DAMAGE.")
    assert licenses.scan(docs_of([licenses.TEMPLATES["GPL-3.0 line"].replace("3", "9"), licenses.TEMPLATES["CC-BY-4.0"].replace("4", "2")])).count() == 0
    edited = licenses.TEMPLATES["Apache-2.0 notice"].replace("agreed to in writing", "agreed")
    assert [r["license"] for r in licenses.scan(docs_of([edited])).collect()] == ["Apache-2.0 notice"]


def test_warc_derivatives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.b/", "<html lang='en'><head><title>T &amp; t</title><style>p{}</style></head><body><p>One<br>two &lt;3</p><script>x()</script><a href='/q'>l</a></body></html>"), (2, None, None), (3, "u", "<p>open <b>bold")], "page_id bigint, url string, html string")
    records = warc.derivatives(warc.responses_of_pages(pages))
    rows = {(r["page_id"], r["record_type"]): r for r in records.collect()}
    assert len(rows) == 6 and len({r["record_id"] for r in rows.values()}) == 6
    fields, block = next(warc.parse_records(bytes(rows[1, "conversion"]["record"])))
    assert block.decode() == "One\ntwo <3\nl" and fields["warc-refers-to"] == rows[1, "conversion"]["refers_to"] == rows[1, "metadata"]["refers_to"]
    assert fields["warc-block-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    meta = next(warc.parse_records(bytes(rows[1, "metadata"]["record"])))[1].decode()
    assert "title: T & t" in meta and "outlinks: 1" in meta and "httpStatus: HTTP/1.1 200 OK" in meta and rows[1, "metadata"]["source_digest"] in meta
    assert rows[2, "conversion"]["n_bytes"] == 0 and rows[2, "conversion"]["target_uri"] is None
    path = str(tmp_path / "w")
    warc.write_warc(records.repartition(2), path)
    want = {(r["record_id"], next(warc.parse_records(bytes(r["record"])))[1]) for r in rows.values()}
    for split in (64 << 20, 300, 7):  # whole files, some members, parts of a member
        back = warc.read_warc(spark, path, split).collect()
        assert len(back) == 6 and {(r["record_id"], bytes(r["block"])) for r in back} == want
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.warc").write_bytes(b"".join(bytes(r["record"]) for r in rows.values()))
    assert {(r["record_id"], bytes(r["block"])) for r in warc.read_warc(spark, str(tmp_path / "f")).collect()} == want
    assert warc.derivatives(warc.responses_of_pages(pages.limit(0))).count() == 0
    assert uuid.UUID(rows[1, "metadata"]["record_id"][10:-1])


def test_derivatives_of_archived_responses(spark, tmp_path):
    import zstandard

    page = "<html><head><title>Zürich</title></head><body><p>Grüße</p></body></html>"
    body, head = page.encode(), "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=%s\r\n%s\r\n"
    chunks = lambda x: b"".join(f"{len(x[a : a + 20]):x}\r\n".encode() + x[a : a + 20] + b"\r\n" for a in range(0, len(x), 20)) + b"0\r\n\r\n"
    blocks = [
        (head % ("utf-8", "")).encode() + body,
        (head % ("latin-1", "")).encode() + page.encode("latin-1"),
        (head % ("utf-8", "Content-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n")).encode() + chunks(gzip.compress(body)),
        (head % ("utf-8", "Content-Encoding: deflate\r\n")).encode() + zlib.compress(body)[2:-4],
        (head % ("utf-8", "Content-Encoding: zstd\r\n")).encode() + zstandard.ZstdCompressor().compress(body),
        (head % ("no-such-set", "Transfer-Encoding: chunked\r\n")).encode() + body,  # says chunked and is not
        (head % ("utf-8", "Content-Encoding: gzip\r\n")).encode() + body,  # says gzip and is not
        (head % ("utf-8", "")).replace("\r\n", "\n").encode() + body,
    ]
    record = lambda i, kind, block: warc.record_bytes([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:x:{i}>"), ("WARC-Target-URI", f"http://a/{i}"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response")], block)
    data = [record(0, "warcinfo", b"software: x\r\n"), *(record(i, "response", b) for i, b in enumerate(blocks, 1)), record(98, "request", b"GET / HTTP/1.1\r\n\r\n"), record(99, "response", b"")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    responses = warc.responses_of_records(warc.read_warc(spark, str(tmp_path), 100))
    got = {r["refers_to"]: r for r in warc.derivatives(responses).filter("record_type = 'conversion'").collect()}
    texts = {k: next(warc.parse_records(bytes(r["record"])))[1].decode() for k, r in got.items()}
    assert texts == {f"<urn:x:{i}>": "Grüße" for i in range(1, 9)} | {"<urn:x:99>": ""}
    meta = warc.derivatives(responses).filter("record_type = 'metadata' AND target_uri = 'http://a/3'").first()
    assert "title: Zürich" in bytes(meta["record"]).decode() and "httpHeader: Content-Encoding: gzip" in bytes(meta["record"]).decode()
    with pytest.raises(Exception, match="no WARC record"):
        (tmp_path / "b.warc").write_bytes(b"no records here")
        warc.read_warc(spark, str(tmp_path / "b.warc")).count()


@pytest.mark.parametrize(
    "page, text",
    [
        ("<head><meta charset='u'><title>T</title><h1>One</h1><p>Two", "One\nTwo"),
        ("<html><head><title>T</title>Bare text<p>Two", "Bare text\nTwo"),
        ("<head><noscript><img src='x'>no</noscript><style>p{}</style></head><p>One", "One"),
        ("<body><p>One</p><noscript>two<p>three", "One\ntwo\nthree"),
        ("<body><div>One<noscript>no</div><p>Two</p>", "One\nTwo"),
        ("<body><template><p>no</div></template><p>One", "One"),
        ("<body><div><template>no</div><p>One", "One"),
        ("<body><svg><path d=''><p>One</p><div>Two</div>", "One\nTwo"),
        ("<body><svg><text>no</text></svg>One<svg/><br>Two<script>no</script>", "One\nTwo"),
    ],
)
def test_text_of_pages_with_omitted_tags(page, text):
    assert warc.page_text(page).text() == text


def test_extra_columns_with_clashing_names(docs_of):
    docs = docs_of(["a b c d e f", "a b c d e f"]).withColumn("keep_id", F.lit("x")).withColumn("_run", F.lit(1)).withColumn("component_id", F.lit(2)).withColumn("failures", F.lit(3)).withColumn("_kept", F.lit(True)).withColumn("ids", F.lit("z"))
    assert exact_dedup.drop_copies(docs).columns == docs.columns
    assert ngram_join.keep_one(docs).count() == 1
    assert quality_rules.ledger(docs).count() == 2
    assert quality_rules.keep_passing(docs, ("web", 1)).columns == docs.columns
    assert byte_bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 2


def test_null_ids_repeated_rows_and_ties(spark, docs_of):
    """Each operator returns a defined row for null ids, null texts and repeated rows."""
    rows = [(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, "")]
    docs = docs_of(rows)
    json, ranks = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
    shards = wavelet.round_trip(docs, json, 2).orderBy("start").collect()
    assert [r["doc_id"] for r in shards] == [None, None, 1, 1, 2, 3] and shards[-1]["n_tokens"] == 1
    packed = packing.pack_documents(docs, P.path("word_bpe_49k.json"), 1, 64).collect()
    assert sum(r["doc_id"] is None for r in packed) == 2 and len(packed) == 6
    check_packing(packed, 64)
    assert byte_bpe.encode_documents(docs, ranks, P.PATTERN).filter("doc_id IS NULL").count() == 2
    dedup = exact_dedup.exact_dedup(docs).collect()
    assert len(dedup) == 6 and all(r["kept"] for r in dedup if r["doc_id"] is None) and {r["keep_id"] for r in dedup} == {1, 3}
    assert exact_dedup.drop_copies(docs).count() == 5
    joined = ngram_join.ngram_join(docs).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in joined if r["doc_id"]) == [(1, 1), (1, 1), (2, 2), (3, 3)] and len(joined) == 6
    assert quality_rules.ledger(docs).count() == 6
    assert licenses.scan(docs_of([(None, licenses.TEMPLATES["MIT line"])])).first()["doc_id"] is None
    model = langid.fit(docs_of([(1, "some words"), (None, "other"), (2, None)]))
    assert langid.identify(docs, model).count() == 6
    lexicon = toxicity.fit(docs, spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id bigint, toxic int"))
    assert toxicity.score(docs, lexicon).count() == 6 and toxicity.reject(docs, lexicon).count() == 6


def brute_score(lexicon, text):
    """Every entry is looked for at every place, without an automaton."""
    words = toxicity.fold(text)
    line = f" {' '.join(words)} "
    places = lambda p: {i for i in range(len(line)) if line.startswith(p, i)}
    hidden = [(i, i + len(p)) for p in (f" {' '.join(toxicity.fold(x))} " for x in lexicon.exceptions) for i in places(p)]
    best = {}
    for entry, weight in lexicon.entries.items():
        for i in places(entry):
            if i not in best or best[i][0] < weight:
                best[i] = (weight, i + len(entry))
    weight = sum(w for i, (w, end) in best.items() if not any(a <= i and end <= b for a, b in hidden))
    x = lexicon.bias + lexicon.slopes[0] * np.log1p(weight) + lexicon.slopes[1] * np.log1p(100 * weight / max(len(words), 1))
    return 1 / (1 + np.exp(-x))


def test_toxicity_scores_against_brute_force(spark, docs_of):
    entries = {" mud ": 2.0, " mudd": 1.0, " grum": 1.5, " grumble ": 3.0, " a ": 0.2}
    lexicon = toxicity.Lexicon(entries, exceptions=("mud pie", "a grumble"))
    pool = ["mud", "MUD", "muddy", "grumble", "grumbling", "pie", "a", "m\u0443d", "gr\u00fcmble", "6rumble", "gru8le", "muḍ", "other", ",", "mud,pie", "m-u-d"]
    texts = [None, ""] + [" ".join(RND.choice(pool) for _ in range(RND.randint(1, 25))) for _ in range(300)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of(texts), lexicon).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], [brute_score(lexicon, t) for t in texts])
    folded = {"Ｇｒｕｍｂｌｅ": ["grumble"], "gr\u00fcmbl3 5ix 66": ["grumble", "six", "66"], "a\u0301b c\u200bd": ["ab", "cd"], "\u0430\u0435\u043e": ["aeo"], "sh!t $o": ["shit", "o"]}
    assert {t: toxicity.fold(t) for t in folded} == folded


def test_language_id_against_exact_sets(spark):
    """The filters' answers against sets of n-grams without false positives, by the same rule."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    letter = lambda c: c.isalpha()

    def grams(text):
        line = "".join(c if letter(c) else " " for c in f" {(text or '').lower()} ")
        return [(n, line[i : i + n]) for n in (2, 3, 4) for i in range(len(line) - n + 1) if line[i : i + n].strip()]

    shares, totals = defaultdict(Counter), Counter(lang for _, t, lang in rows if lang and t is not None)
    for _, text, lang in rows:
        if lang and text is not None:
            for g in set(grams(text)):
                shares[g][lang] += 1
    known = {g: {lang for lang, n in c.items() if n / totals[lang] >= 0.5 * max(m / totals[x] for x, m in c.items())} for g, c in shares.items()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, langid.fit(docs)).collect()}
    same = close = 0
    for i, text, _ in rows:
        hits = Counter(lang for g in grams(text) for lang in known.get(g, ()))
        top = max(hits.values(), default=0)
        want = min((lang for lang, n in hits.items() if n == top), default="und")
        same += got[i][0] == want
        close += abs(got[i][1] - (top / sum(hits.values()) if hits else 0.0)) < 0.01
    assert same >= 0.99 * len(rows) and close >= 0.99 * len(rows)
    # equal counts: the first language by name
    tied = langid.fit(spark.createDataFrame([(1, "abab", "zz"), (2, "abab", "aa")], "doc_id bigint, text string, lang string"))
    assert langid.identify(docs.limit(1).withColumn("text", F.lit("abab")), tied).first()["lang_pred"] == "aa"


def test_block_with_ids_of_other_words_is_an_error():
    block = byte_bpe.Block(__import__("regex").compile(P.PATTERN))
    block.add(pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array(["a b c"])], ["doc_id", "text"]))
    rows = block.rows(0, 4)
    encode = byte_bpe.encode_words(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 4)
    table = lambda rows, names, types: pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*rows), types)})
    back = [r for route in {r[0] for r in rows if r[0] < 4} for r in zip(*encode(table([r for r in rows if r[0] == route], ("route", "block", "blob"), (pa.int64(), pa.int64(), pa.binary()))).to_pydict().values())]
    top = table([r for r in rows if r[0] >= 4], ("route", "block", "blob"), (pa.int64(), pa.int64(), pa.binary()))
    join = lambda parts: byte_bpe.reassemble(top, table(parts, ("route", "bucket", "blob"), (pa.int64(), pa.int32(), pa.binary())))
    assert len(join(back).column("ids")[0]) == 3
    for wrong in (back[:-1], [*back[:-1], (back[-1][0], back[-1][1] + 9, back[-1][2])]):
        with pytest.raises(RuntimeError, match="other words"):
            join(wrong)


def test_derivatives_with_null_ids_and_repeated_rows(spark):
    rows = [(None, None, None, None, None, None), (1, "<urn:x>", "u", "d", "HTTP/1.1 200 OK", "<p>a"), (1, "<urn:x>", "u", "d", "HTTP/1.1 200 OK", "<p>a")]
    got = warc.derivatives(spark.createDataFrame(rows, warc.RESPONSE).withColumn("record", F.lit("clash"))).collect()
    assert len(got) == 6 and sum(r["page_id"] is None for r in got) == 2 and len({bytes(r["record"]) for r in got}) == 4
    assert all(r["refers_to"] is None for r in got if r["page_id"] is None)


def test_clashing_columns_in_every_operator(spark, docs_of):
    docs = docs_of(["a b c d e f", "a b c d e f", None])
    for c in ("score", "weight", "n_matches", "lang_pred", "license", "part", "start", "n_tokens", "ids", "piece", "length", "rank", "sequence_id", "block", "digest", "unit", "node", "key", "word", "toxic"):
        docs = docs.withColumn(c, F.lit("x"))
    lexicon = toxicity.Lexicon({" a ": 9.0})
    assert toxicity.score(docs, lexicon).columns == ["doc_id", "score", "weight", "n_matches"] and toxicity.reject(docs, lexicon).columns == docs.columns
    labels = spark.createDataFrame([(0, 1, "x"), (1, 0, "x")], "doc_id bigint, toxic int, text string")
    assert toxicity.fit(docs, labels) is not None
    assert langid.identify(docs, langid.fit(docs)).count() == 3 and licenses.scan(docs).count() == 0
    assert wavelet.round_trip(docs, P.path("byte_bpe_50k.json"), 2).count() == 3
    assert packing.pack_documents(docs, P.path("word_bpe_49k.json"), 1).count() == 3
    assert ngram_join.ngram_join(docs).columns == ["doc_id", "n_shingles", "component_id"] and exact_dedup.exact_dedup(docs).count() == 3
    pages = spark.createDataFrame([(1, "u", "<p>a", "x", "y")], "page_id bigint, url string, html string, record string, payload string")
    assert warc.derivatives(warc.responses_of_pages(pages)).count() == 2


def test_very_long_text(spark, docs_of):
    """One text of half a million words goes through every operator whole."""
    text = " ".join(f"w{i % 9973}" for i in range(500_000))
    docs = docs_of([text, "short one"])
    ledger = {r["doc_id"]: r for r in quality_rules.ledger(docs).collect()}
    assert ledger[0]["n_words"] == ledger[0]["n_repeat_words"] == 500_000
    poisoned = docs_of([text + " zorkel", "short one"])
    assert {r["doc_id"]: r["n_matches"] for r in toxicity.score(poisoned, toxicity.Lexicon({" zorkel ": 9.0})).collect()} == {0: 1, 1: 0}
    model = langid.fit(docs_of(["short one"]))
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs_of([text + " short", "12"]), model).collect()} == {0: "en", 1: "und"}
    notice = licenses.TEMPLATES["MIT line"]
    found = licenses.scan(docs_of([f"{text} {notice}"])).first()
    assert found["license"] == "MIT line" and found["start_char"] == len(text) + 1
    page = spark.createDataFrame([(1, "u", f"<body><p>{text}</p><p>end")], "page_id bigint, url string, html string")
    assert [r["n_bytes"] for r in warc.derivatives(warc.responses_of_pages(page)).filter("record_type = 'conversion'").collect()] == [len(text) + 4]
    assert {r["doc_id"]: r["text_sha256"] for r in exact_dedup.exact_dedup(docs).collect()}[0] == hashlib.sha256(text.encode()).hexdigest()
    shards = {r["doc_id"]: r["n_tokens"] for r in wavelet.round_trip(docs, P.path("byte_bpe_50k.json"), 2).collect()}
    assert shards[1] == 3 and shards[0] > 500_000
    sizes = {r["doc_id"]: r["n_shingles"] for r in ngram_join.ngram_join(docs).collect()}
    assert sizes == {0: 9973, 1: 1}
    encoded = byte_bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    decoded = {r["doc_id"]: bytes(r["decoded"]).decode() for r in byte_bpe.decode_ids(encoded, P.path("byte_bpe_50k.tiktoken")).collect()}
    assert decoded == {0: text, 1: "short one"}
    rows = packing.pack_documents(docs, P.path("word_bpe_49k.json"), 1).collect()
    assert check_packing(rows, 4096) == -(-sum(r["length"] for r in rows) // 4096)
