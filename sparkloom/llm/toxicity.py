"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, removes marks, maps homoglyphs and digit substitutions to
letters inside words, and turns everything else into single blanks. A lexicon entry is a
word (" idiot ") or a word beginning (" lowei") with a weight; an exception phrase
hides the entries inside it. A document's score is a logistic function of its summed
weight, and of that weight per hundred words.

`fit` learns the entries: in a bounded sample of labelled rows, the contexts (word before,
word, word after) in which a word occurs are counted in toxic and in clean documents, each
distinct context once, so copied passages count once. Words and word beginnings that are much more
frequent in toxic documents become entries, weighted by the log ratio.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_slices

# Characters that stand for letters, Cyrillic and Greek look-alikes first, then digits and signs.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "һ": "h", "м": "m", "т": "t", "к": "k", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "χ": "x",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

#: Phrases in which an entry is harmless; a general starting list, a parameter of Lexicon.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "clown fish", "class clown", "circus clown", "sore loser board", "idiot proof", "idiot light", "dumb bell", "dumb waiter", "dumb terminal", "crazy paving", "crazy quilt", "mad scientist", "rat race",
    "rat pack", "pig iron", "guinea pig", "piggy bank", "snake oil", "black sheep", "silly putty", "ugly duckling", "moron test", "lame duck", "nut case study", "screw driver", "hate speech", "stupid simple", "kill switch", "dead pan", "pain killer",
)

#: Bounds of the sample of labelled rows that a lexicon is fitted on; they bound its words and so the lexicon.
MOST_TOXIC, MOST_CLEAN = 4000, 8000
STEMS = (4, 5, 6, 7, 8, 9)
#: Words are Python objects here, so slices are small.
WORD_SLICE = 1 << 20
#: Contexts that a task gathers before it sends them, which bounds its memory.
CONTEXT_BLOCK = 50_000
#: A longer entry replaces a shorter one that it explains to this share.
EXPLAINED = 0.8


def _fold_table() -> dict[int, str]:
    table = {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(k.upper()): v for k, v in HOMOGLYPHS.items()}
    table |= {i: chr(i - 0xFEE0).lower() for i in range(0xFF21, 0xFF5B) if chr(i - 0xFEE0).isalpha()}
    for i in range(0xC0, 0x250):  # Latin letters with marks
        base = unicodedata.normalize("NFD", chr(i))[0]
        if base.isascii() and base.isalpha():
            table[i] = base.lower()
    return table


_TABLE = _fold_table()
_MARKS = re.compile("[̀-ͯ​-‍­]")
_WORD = re.compile(r"[^\W_@$!]+(?:[@$!]+[^\W_@$!]+)*")
_SIGNS = re.compile(r"[0-9@$!]")
_LETTER = re.compile(r"[^\W\d_]")
_DIGIT_TABLE = str.maketrans(DIGITS)


def fold_word(word: str) -> str:
    """Digits and signs inside a word that has a letter become letters."""
    return word.translate(_DIGIT_TABLE) if _SIGNS.search(word) and _LETTER.search(word) else word


def fold(text: str | None) -> list[str]:
    """The folded words of a text; null has none."""
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", text).translate(_TABLE)
    words = _WORD.findall(text.lower())
    return [fold_word(w) if not w.isalpha() else w for w in words]


@dataclass(frozen=True)
class Lexicon:
    """entries: folded word (" w ") or beginning (" w") -> weight. bias, slopes: of the logistic function."""

    entries: dict[str, float]
    bias: float = -4.0
    slopes: tuple[float, float] = (3.0, 1.0)
    exceptions: tuple[str, ...] = field(default=EXCEPTIONS)

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            out.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            folded = f" {' '.join(fold(phrase))} "
            out.add_word(folded, (len(folded), None))
        out.make_automaton()
        return out


def weights_in(matcher, words: list[str]) -> tuple[float, int]:
    """Summed weight and number of matched words: the heaviest entry of each word counts once,
    and entries that lie inside an exception phrase do not count."""
    text = f" {' '.join(words)} "
    best: dict[int, tuple[int, float]] = {}
    hidden: list[tuple[int, int]] = []
    for end, (length, weight) in matcher.iter(text):
        start = end - length + 1
        if weight is None:
            hidden.append((start, end))
        elif start not in best or best[start][1] < weight:
            best[start] = (end, weight)
    if hidden:
        best = {s: (e, w) for s, (e, w) in best.items() if not any(a <= s and e <= b for a, b in hidden)}
    return sum(w for _, w in best.values()), len(best)


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    """log(1 + weight), and log(1 + weight per hundred words): the part normalised by length."""
    return np.stack([np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 1))], 1)


def measure(lexicon: Lexicon, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices with the weight, matched words and words of each text."""
    matcher = lexicon.automaton()
    found = bool(lexicon.entries)
    for batch in text_slices(batches, most=WORD_SLICE):
        rows = []
        for text in batch.column("text").to_pylist():
            words = fold(text)
            rows.append((*(weights_in(matcher, words) if found else (0.0, 0)), len(words)))
        yield batch, *np.array(rows, np.float64).T


def word_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, toxic and a hash of (word before, word, word after); repeats within a block of words once."""
    import xxhash

    def sent(seen: set[tuple[str, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*seen), (pa.string(), pa.int32(), pa.int64()))], ["word", "toxic", "context"])

    seen: set[tuple[str, int, int]] = set()
    for batch in text_slices(batches, most=WORD_SLICE):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = ["", *fold(text), ""]
            for at in range(0, len(words) - 2, CONTEXT_BLOCK):
                part = words[at : at + CONTEXT_BLOCK + 2]
                seen.update((b, toxic, xxhash.xxh64_intdigest(f"{a} {b} {c}") >> 1) for a, b, c in zip(part, part[1:], part[2:]))
                if len(seen) >= CONTEXT_BLOCK:
                    yield sent(seen)
                    seen.clear()
    if seen:
        yield sent(seen)


def bounded(labels: DataFrame, most: tuple[int, int]) -> DataFrame:
    """About most[toxic] rows of each label at most, chosen by a hash of the id."""
    counts = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) / 1_000_000
    keep = F.lit(False)
    for label in (0, 1):
        keep = keep | ((F.col("toxic") == label) & (share < F.lit(min(1.0, most[label] / max(counts.get(label, 0), 1)))))
    return labels.filter(keep)


def choose_entries(counts: DataFrame, least: int, purity: float) -> DataFrame:
    """entry, bad, good of words and beginnings that are frequent in toxic and rare in clean contexts."""
    stems = F.array(*[F.when(F.length("word") > n, F.concat(F.lit(" "), F.substring("word", 1, n))) for n in STEMS])
    spread = counts.select(F.explode(F.concat(F.array(F.concat(F.lit(" "), F.col("word"), F.lit(" "))), F.filter(stems, lambda s: s.isNotNull()))).alias("entry"), "bad", "good", "n_words")
    sums = spread.groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    return sums.filter((F.col("bad") >= least) & (F.col("bad") >= purity * (F.col("bad") + F.col("good"))))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 0.01) -> np.ndarray:
    """Bias and slopes (not below 0) by Newton steps with a small ridge."""
    x = np.c_[np.ones(len(x)), x]
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        penalty = ridge * np.r_[0, np.ones(len(b) - 1)]
        slope = x.T @ (y - p) - penalty * b
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6)
        step = np.linalg.solve(bend, slope)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    b[1:] = np.maximum(b[1:], 0)
    return b


def narrowed(chosen: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weights of the entries that are needed: the shortest beginnings that were chosen cover all that
    begins with them, and each is narrowed to the longest entry that explains most of it.

    Entries with one beginning lie side by side in sorted order, so each looks at its own followers only.
    """
    entries: dict[str, float] = {}
    ordered, beginnings = sorted(chosen), set()
    for entry in sorted(chosen, key=lambda e: (len(e), e)):
        covered = entry in entries or any(entry[:n] in beginnings for n in range(1, len(entry) + 1))
        if covered or any(f" {entry.strip()[:n]}" in chosen for n in STEMS if n < len(entry.strip())):
            continue
        followers = ordered[bisect_left(ordered, entry) : bisect_left(ordered, entry + chr(0x10FFFF))]
        best = max((e for e in followers if chosen[e][0] >= EXPLAINED * chosen[entry][0]), key=lambda e: (len(e), e))
        rest = [best]
        if best != entry:  # what the longer entry leaves of the shorter one
            rest += [e for e in followers if e.endswith(" ") and not e.startswith(best.rstrip())]
        for e in rest:
            bad, good = chosen[e]
            entries[e] = float(np.log((bad + 0.5) / (good + 0.5)))
            if not e.endswith(" "):
                beginnings.add(e.rstrip())
    return entries


def fit(docs: DataFrame, labels: DataFrame, least: int = 5, purity: float = 0.93, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from docs (doc_id, text) and labels (doc_id, toxic 0/1); null texts and labels are not used.

    Read are at most about MOST_TOXIC toxic and MOST_CLEAN clean labels (a bounded sample of labelled
    rows; that bound is why they are broadcast). A document with both labels counts as toxic. Without
    usable rows the lexicon is empty and scores are low.
    """
    rows = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text")
    sample = cut(texts.join(F.broadcast(bounded(rows, (MOST_CLEAN, MOST_TOXIC))), "doc_id").select("doc_id", "text", "toxic"), "labelled")
    contexts = sample.mapInArrow(word_contexts, "word string, toxic int, context bigint").distinct()
    counts = contexts.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"), F.lit(1).alias("n_words"))
    entries = narrowed({r["entry"]: (r["bad"], r["good"]) for r in choose_entries(counts, least, purity).collect()})
    lexicon = Lexicon(entries, exceptions=exceptions)
    if not entries:
        return lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, weight, _, words in measure(lexicon, batches):
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(weight), pa.array(words)], ["toxic", "weight", "words"])

    # three numbers for each row of the bounded sample
    seen = sample.mapInArrow(run, "toxic int, weight double, words double").toPandas()
    b = logistic(features(seen["weight"].to_numpy(), seen["words"].to_numpy()), seen["toxic"].to_numpy())
    return Lexicon(entries, float(b[0]), (float(b[1]), float(b[2])), exceptions)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), weight, n_matches for every row, over the whole text.

    A null or empty text has no weight and the lowest score. Repeated rows are returned as they come;
    an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, weight, matched, words in measure(lexicon, batches):
            x = lexicon.bias + features(weight, words) @ np.array(lexicon.slopes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30)))), pa.array(weight), pa.array(matched.astype(np.int64))], ["doc_id", "score", "weight", "n_matches"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double, weight double, n_matches bigint").withColumnRenamed("doc_id", id_col)


def reject(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below threshold; all columns unchanged, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, weight, _, words in measure(lexicon, batches):
            x = lexicon.bias + features(weight, words) @ np.array(lexicon.slopes)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))) < threshold))

    return docs.mapInArrow(run, docs.schema)
