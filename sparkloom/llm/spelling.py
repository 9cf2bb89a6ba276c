"""Spelling variants: words one edit apart, found by range reporting on a grid.

A word that differs from another at place p shares what stands before p and what stands after it. Words of one length are
put in forward order and in reverse order (read from their ends); each is a point of the grid of both orders. The words with a given beginning are an
interval of the first order, those with a given end an interval of the second, and a wavelet matrix over the points reports those in both.

Words are dealt by what a run of a few places leaves on both sides, so that a task's grid holds all partners of its words for those places. At
most (letters ** REACH) words agree in that, however large the vocabulary is; words that nothing agrees with need no grid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_tables, give_back, n_shuffle
from .wavelet import WaveletMatrix

RUN = r"([A-Za-zÀ-ÿ]{%d,})"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Places of an edit that are looked for in one task; in words of more than REACH * RUNS letters, their length by RUNS.
REACH = 3
RUNS = 32
#: Rows (a word for a run of places) that a task is meant to hold.
TASK_ROWS = 200_000
#: Points of one grid query at a time.
STEP = 1 << 17

_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)
PAIRS = "word string, near string"


def damaged_words(docs: DataFrame, least_chars: int = 6, every: int = 199) -> DataFrame:
    """word: each run of letters of at least least_chars code points, A-Z lower-cased; where `every` divides the crc32 h of `<doc_id>:<run>`,
    without its code point h % length.

    A null text has no words; words of a row without id stay as they are. Shorter words are left out, before and after the change.
    """
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN % least_chars), 1)).alias("run"))
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, UPPER.lower())).otherwise(F.col("run"))
    hashed = found.select("doc_id", lower.alias("run")).withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run")))
    size = F.length("run")
    at = (F.col("h") % size).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= least_chars)


def vocabulary(words: DataFrame, least: int = 5) -> DataFrame:
    """word, n of the words that occur at least `least` times."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


class Grid:
    """Words of one length as points (forward place, reverse place)."""

    def __init__(self, words: np.ndarray) -> None:
        """words: distinct, sorted in code-point order."""
        self.words = words
        ends = reversed_words(words)
        order = np.argsort(ends)
        self.ends, self.by_end = ends[order], words[order]
        points = np.empty(len(words), np.int64)
        points[order] = np.arange(len(words))
        self.tree = WaveletMatrix.build(points)
        self.before = [np.r_[0, np.cumsum(_ONES[p])] for p in self.tree.planes]

    def _ones(self, plane: int, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits of a plane."""
        byte = np.append(self.tree.planes[plane], np.uint8(0))[i >> 3]
        return self.before[plane][i >> 3] + _ONES[byte & ((1 << (i & 7)) - 1).astype(np.uint8)]

    def reported(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, reverse place) of all points with forward place in [lo, hi) and reverse place in [least, most)."""
        query = np.flatnonzero((hi > lo) & (most > least))
        lo, hi, node = lo[query], hi[query], np.zeros(len(query), np.int64)
        for p in range(len(self.tree.planes)):
            span = 1 << (len(self.tree.planes) - 1 - p)
            a, b, zeros = self._ones(p, lo), self._ones(p, hi), self.tree.zeros[p]
            query = np.r_[query, query]
            lo, hi, node = np.r_[lo - a, zeros + a], np.r_[hi - b, zeros + b], np.r_[2 * node, 2 * node + 1]
            kept = (hi > lo) & (node * span < most[query]) & ((node + 1) * span > least[query])
            query, lo, hi, node = query[kept], lo[kept], hi[kept], node[kept]
        return query, node


def letters(words: np.ndarray) -> np.ndarray:
    """Code points: (words, width)."""
    return words.view(np.uint32).reshape(len(words), words.dtype.itemsize // 4)


def as_words(points: np.ndarray) -> np.ndarray:
    points = np.ascontiguousarray(points, np.uint32)
    return points.view(f"U{points.shape[1]}").ravel()


def reversed_words(words: np.ndarray) -> np.ndarray:
    """Words that fill their width, read from the end."""
    return as_words(letters(words)[:, ::-1])


def interval(ordered: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ordered words that begin so: (code points of the starts) -> [lo, hi)."""
    if not starts.shape[1]:
        return np.zeros(len(starts), np.int64), np.full(len(starts), len(ordered), np.int64)
    last = np.full((len(starts), 1), 0x10FFFF, np.uint32)
    return np.searchsorted(ordered, as_words(starts)), np.searchsorted(ordered, as_words(np.c_[starts, last]))


def partners(grid: Grid, words: np.ndarray, first: np.ndarray, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, partner) for words of length m (a letter replaced) or m - 1 (a letter put in), with the edit in the run of places of the partner that starts at first.

    Of a letter put in beside equal ones only the last place counts, so no pair comes twice.
    """
    size, reach = letters(words).shape[1], max(REACH, -(-m // RUNS))
    for p in np.unique((np.unique(first)[:, None] + np.arange(reach)).ravel()):
        if p >= m:
            continue
        mine = words[(first <= p) & (p < first + reach)]
        for s in range(0, len(mine), STEP):
            part = mine[s : s + STEP]
            points = letters(part)
            rest = points[:, p + 1 :] if size == m else points[:, p:]
            lo, hi = interval(grid.words, points[:, :p])
            least, most = interval(grid.ends, rest[:, ::-1])
            query, place = grid.reported(lo, hi, least, most)
            asked, found = part[query], grid.by_end[place]
            if size == m:
                keep = asked != found
            else:
                keep = letters(found)[:, p] != letters(asked)[:, p] if p < size else np.ones(len(query), bool)
            yield asked[keep], found[keep]


def near_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over whole partitions of (word, m, first, put_in, key): the pairs found there, in both directions."""
    parts = list(batches)
    t = pa.Table.from_batches(parts) if parts else None
    parts = None
    if t is not None:
        _, same, times = np.unique(t.column("key").to_numpy(), return_inverse=True, return_counts=True)
        t = t.filter(pa.array(times[same] > 1))
    if t is not None and t.num_rows:
        words = np.array(t.column("word").to_pylist(), object)
        m, first, put_in = (t.column(c).to_numpy() for c in ("m", "first", "put_in"))
        t = None
        for size in np.unique(m):
            own = (m == size) & (put_in == 0)
            if not own.any():
                continue
            grid = Grid(np.unique(words[own].astype(f"U{size}")))
            asked = (own, size, True), ((m == size) & (put_in == 1), size - 1, False)
            for rows, width, replaced in asked:
                if not rows.any():
                    continue
                for a, b in partners(grid, words[rows].astype(f"U{width}"), first[rows].astype(np.int64), int(size)):
                    yield pa.RecordBatch.from_arrays([pa.array(a.tolist(), pa.string()), pa.array(b.tolist(), pa.string())], ["word", "near"])
                    if not replaced:
                        yield pa.RecordBatch.from_arrays([pa.array(b.tolist(), pa.string()), pa.array(a.tolist(), pa.string())], ["word", "near"])
    give_back()


def near_pairs(words: DataFrame, n_words: int) -> DataFrame:
    """word, near: all ordered pairs of distinct words (column word, none twice) that are one inserted, deleted or replaced code point apart."""
    size = F.length("word")

    def dealt(m: Column, put_in: int) -> DataFrame:
        """A row for each run of places of an edit, keyed by what stands on both sides of it."""
        reach = F.greatest(F.lit(REACH), F.ceil(m / RUNS).cast("int"))
        rows = words.select("word", m.alias("m"), F.explode(F.sequence(F.lit(0), m - 1, reach)).alias("first"), reach.alias("reach"), F.lit(put_in).alias("put_in"))
        after = F.substring("word", F.col("first") + F.col("reach") + 1 - put_in, size)
        return rows.withColumn("key", F.xxhash64("m", "first", F.substring("word", F.lit(1), F.col("first")), F.lit("\n"), after))

    n_tasks = max(n_shuffle(words.sparkSession), -(-6 * n_words // TASK_ROWS))
    rows = dealt(size, 0).unionByName(dealt(size + 1, 1))
    return rows.repartitionById(n_tasks, F.pmod("key", F.lit(n_tasks)).cast("int")).select("word", "m", "first", "put_in", "key").mapInArrow(near_in_task, PAIRS)


def spelling_forms(vocab: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for a vocabulary (word, n).

    form: the near word of largest n (ties: the smallest in code-point order) if that n is at least ratio times the word's; root: the last form
    that is reached from the word, itself if it has none. A form is at least `ratio` times as frequent, so chains are short: their length is bounded by
    the logarithm of n. Nulls and empty words are left out, repeated words folded (counts added up); an empty vocabulary gives no rows.
    """
    words = cut(vocab.filter(F.col("word") != "").groupBy("word").agg(F.sum("n").cast("bigint").alias("n")), "words")
    n_words = words.count()
    counted = near_pairs(words.select("word"), n_words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    fits = -F.col("best.m") >= ratio * F.col("n")
    forms = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")
    )
    forms = cut(forms, "forms")
    roots = followed(forms.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def followed(links: DataFrame) -> DataFrame:
    """word, root: the end of each chain of links (word, root); every round doubles the steps taken."""
    now = cut(links, "roots")
    while True:
        after = now.withColumnRenamed("root", "middle").join(now.select(F.col("word").alias("middle"), "root"), "middle", "left")
        moved = cut(after.select("word", F.coalesce("root", "middle").alias("root"), F.col("root").isNotNull().alias("moved")), "roots")
        drop_tables(now)
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now
