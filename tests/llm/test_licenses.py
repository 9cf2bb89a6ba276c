"""License scans: telling words at any place, and texts full of notice words."""

import random
import time

from sparkloom.llm import licenses


def found(texts):
    index = licenses.Index(licenses.TEMPLATES, licenses.Settings())
    import pyarrow as pa

    run = licenses.scanner(licenses.TEMPLATES, licenses.Settings())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    assert index.templates
    return [r for out in run(iter([batch])) for r in out.to_pylist()]


def test_a_telling_word_counts_at_any_place():
    notice = licenses.TEMPLATES["Apache-2.0 notice"]
    lost = notice.replace("Apache License", "XX License", 1)
    assert "apache" in lost.lower()
    assert [(r["license"], r["coverage"] >= 0.95) for r in found([lost])] == [("Apache-2.0 notice", True)]
    assert not [r for r in found([notice.replace("Apache", "XX").replace("apache", "xx")]) if r["license"].startswith("Apache")]


def test_text_of_repeated_notice_words_is_fast():
    text = "the software is provided as is without warranty of any kind " * 5000  # 300 KB
    start = time.perf_counter()
    assert found([text]) == []
    assert time.perf_counter() - start < 3
    start = time.perf_counter()
    rows = found([text + licenses.TEMPLATES["MIT"] + " " + text])
    assert [(r["license"], r["coverage"]) for r in rows] == [("MIT", 1.0)] and rows[0]["start_char"] >= len(text)
    assert time.perf_counter() - start < 8


def test_the_bound_loses_no_match():
    rnd = random.Random(2)
    index = licenses.Index(licenses.TEMPLATES, licenses.Settings())
    import numpy as np

    for t in index.templates:
        for _ in range(6):
            words = np.array([rnd.choice([*t.words.tolist(), len(index.numbers)]) for _ in range(rnd.randint(1, 400))])
            at = rnd.randrange(len(words))
            words = np.r_[words[:at], [w if rnd.random() < 0.9 else len(index.numbers) for w in t.words.tolist()], words[at:]]
            centres = np.arange(-t.band, len(words))
            fits = licenses.can_match(words, t, centres)
            for c in rnd.sample(range(len(centres)), 12) + [int(np.flatnonzero(centres == at)[0])]:
                if licenses.align(words, t.words, int(centres[c]), t.band)[0] >= t.need:
                    assert fits[c]
