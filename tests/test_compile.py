"""Question compilation against a plain greedy choice."""

import random
from collections import Counter

import pytest

from sparkloom.plans import evidence

PRIORITY = {"CM": 0, "BP": 1}
SCHEMA = "video_id string, vqa_id string, task_type string, capability string, question string, gold_answer string, score double"


def plain(rows, most=3, per_task=2, per_capability=2):
    """Videos by name, each greedy; a question is free unless an earlier video took it. All questions here are without issues."""
    taken, out = {}, set()
    for video in sorted({r[0] for r in rows}):
        held, tasks, capabilities = [], Counter(), Counter()
        for _, i, task, capability, question, _, score in sorted((r for r in rows if r[0] == video), key=lambda r: (PRIORITY[r[2]], -r[6], r[1])):
            stem = frozenset(question.rstrip("?").split())
            if len(held) >= most or tasks[task] >= per_task or capabilities[capability] >= per_capability or question in taken or question in held:
                continue
            if any(len(stem & frozenset(h.rstrip("?").split())) / len(stem | frozenset(h.rstrip("?").split())) >= 0.92 for h in held):
                continue
            held.append(question)
            tasks[task] += 1
            capabilities[capability] += 1
            out.add(i)
        taken |= dict.fromkeys(held, video)
    return out


def questions(n):
    nouns = ["bottle", "jacket", "lamp", "phone", "basket", "mirror", "helmet", "drawer", "curtain", "kettle", "ladder", "pillow"]
    return [f"What colour does the {a} beside the {b} have near the {c} in the frame?" for a in nouns for b in nouns for c in nouns if a != b != c][:n]


def chosen(spark, rows):
    return {r["vqa_id"] for r in evidence.compile_questions(spark.createDataFrame(rows, SCHEMA), PRIORITY, most=3, per_task=2, per_capability=2)[0].collect()}


def test_random_chains_of_200_videos(spark):
    rnd, pool = random.Random(7), questions(260)
    rows = [(f"v{v:03d}", f"q{v:03d}_{i}", rnd.choice(["BP", "CM"]), rnd.choice(["OFFER_CONDITION", "USAGE_SCENARIO"]), rnd.choice(pool), "the red one", rnd.randint(1, 9) / 10) for v in range(200) for i in range(6)]
    first = evidence.compile_questions(spark.createDataFrame(rows, SCHEMA), PRIORITY, most=3, per_task=2, per_capability=2)
    reasons = Counter(r["reason"] for r in first[1].select("reason").collect())
    assert not set(reasons) - {"video_quota", "task_quota", "capability_quota", "exact_duplicate_question", "within_video_semantic_duplicate"}
    assert {r["vqa_id"] for r in first[0].collect()} == plain(rows)


def test_a_chain_in_which_each_choice_hangs_on_the_last(spark):
    pool = questions(9)
    rows = [(f"v{v}", f"q{v}_{i}", "BP", "OFFER_CONDITION", pool[v + i], "the red one", 0.9 - i / 10) for v in range(7) for i in range(2)]
    got = {r["vqa_id"] for r in evidence.compile_questions(spark.createDataFrame(rows, SCHEMA), PRIORITY, most=1, per_task=1, per_capability=1)[0].collect()}
    assert got == plain(rows, 1, 1, 1)


@pytest.mark.parametrize("rows", [[], [("v", "q", "BP", "OFFER_CONDITION", None, None, None)]])
def test_empty_and_null(spark, rows):
    assert chosen(spark, rows) == set()
