"""Hash ranges and word ranges of any number."""

import numpy as np

from sparkloom.llm import ngram_join


def test_ranges_are_even_for_any_number():
    h = np.random.default_rng(1).integers(0, 1 << 64, 400_000, np.uint64)
    for buckets in (1, 7, 64, 100_000, 3_000_000):
        to = ngram_join.range_of(h, buckets)
        assert to.max() < buckets
        counts = np.bincount(to, minlength=buckets)
        assert counts.max() <= len(h) / buckets + 6 * (len(h) / buckets) ** 0.5 + 8
    assert len(np.unique(ngram_join.range_of(h, 3_000_000))) > 350_000  # more than 16 bits of ranges


def test_results_do_not_depend_on_the_number_of_ranges(docs_of, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    docs = docs_of([" ".join(words), " ".join(words[:39] + ["x"]), " ".join(words[::-1]), None, "one two", "one two", " ".join(words[10:] + words[:10])])
    want = sorted(tuple(r) for r in ngram_join.ngram_join(docs).collect())
    monkeypatch.setattr(ngram_join, "planned_bytes", lambda df: 200_000)
    monkeypatch.setattr(ngram_join, "RANGE_BYTES", 1)
    assert sorted(tuple(r) for r in ngram_join.ngram_join(docs).collect()) == want and want[1][2] == 0
