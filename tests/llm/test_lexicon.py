"""The choice of lexicon entries against a plain search over all pairs."""

import math
import random
import time

import pytest

from sparkloom.llm import toxicity


def plain(chosen):
    entries = {}
    for entry in sorted(chosen, key=lambda e: (len(e), e)):
        covered = any(entry.startswith(d.rstrip()) for d in entries if not d.endswith(" ") or d == entry)
        if covered or any(f" {entry.strip()[:n]}" in chosen for n in toxicity.STEMS if n < len(entry.strip())):
            continue
        best = max((e for e in chosen if e.startswith(entry) and chosen[e][0] >= toxicity.EXPLAINED * chosen[entry][0]), key=lambda e: (len(e), e))
        rest = [] if best == entry else [e for e in chosen if e.startswith(entry) and e.endswith(" ") and not e.startswith(best.rstrip())]
        for e in [best, *rest]:
            entries[e] = math.log((chosen[e][0] + 0.5) / (chosen[e][1] + 0.5))
    return entries


def some(rnd, n, letters="abe", longest=11):
    return {f" {''.join(rnd.choice(letters) for _ in range(rnd.randint(2, longest)))}{rnd.choice(['', ' '])}": (rnd.randint(1, 40), rnd.randint(0, 9)) for _ in range(n)}


@pytest.mark.parametrize("seed", range(8))
def test_entries_equal_the_plain_search(seed):
    chosen = some(random.Random(seed), 300)
    got, want = toxicity.narrowed(chosen), plain(chosen)
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in want)


def test_no_entries_and_many():
    assert toxicity.narrowed({}) == {}
    chosen = some(random.Random(1), 30_000, "abcdefghij", 12)
    start = time.perf_counter()
    toxicity.narrowed(chosen)
    assert time.perf_counter() - start < 3
