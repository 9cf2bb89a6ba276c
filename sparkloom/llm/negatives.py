"""Hard-negative mining over product-quantised vectors, with exact results.

Every row is stored as its integer vector, its codes (one byte for each pair of
dimensions) and the norm of what the codes leave out. Anchors meet the rows block by block: a block's rows stand in
one task's memory, all anchors are streamed past them. Lookup tables give each row's score, the anchor's norm times the stored norm
says how far it can be off, and only rows that can still reach the first k are scored with integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back, n_shuffle

#: Rows of a block, which one task holds.
BLOCK_ROWS = 1 << 18
#: Rows that the codebooks are fitted on; results do not depend on them.
SAMPLE_ROWS = 4096
CENTRES = 256
#: Cells of one table of lower or upper bounds in a task.
CELLS = 1 << 22

INDEX = "vec_id bigint, label bigint, vec binary, codes binary, off double"
FOUND = "anchor_id bigint, anchor_key bigint, place int, positive_id bigint, positive_score bigint, vec_id bigint, score bigint"


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, q: floor(scale * x) of every component, as double.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part.
    """
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & fine)
    return kept.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("q"))


class Codebooks:
    """Centres of every pair of dimensions: (pairs, CENTRES, 2)."""

    def __init__(self, sample: np.ndarray, rounds: int = 5) -> None:
        """Lloyd's rounds from evenly spaced sample rows; no rows give the origin."""
        sample = sample if len(sample) else np.zeros((1, sample.shape[1]), np.int64)
        start = sample[np.linspace(0, len(sample) - 1, CENTRES).astype(int)]
        self.centres = start.reshape(CENTRES, -1, 2).transpose(1, 0, 2).astype(np.float32)
        for _ in range(rounds):
            codes = self.encode(sample)
            for m in range(len(self.centres)):
                n = np.bincount(codes[:, m], minlength=CENTRES)
                for d in range(2):
                    total = np.bincount(codes[:, m], sample[:, 2 * m + d], minlength=CENTRES)
                    self.centres[m, n > 0, d] = (total / np.maximum(n, 1))[n > 0]

    def encode(self, q: np.ndarray) -> np.ndarray:
        """The nearest centre of each pair: (rows, pairs) bytes."""
        out = np.empty((len(q), len(self.centres)), np.uint8)
        for m, c in enumerate(self.centres):
            part = q[:, 2 * m : 2 * m + 2].astype(np.float32)
            out[:, m] = np.argmax(part @ c.T - 0.5 * (c * c).sum(1), axis=1)
        return out

    def off(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """An upper bound of |score - estimate| for an anchor of norm 1: the residual's norm, and what single-precision sums can lose."""
        held = self.centres[np.arange(len(self.centres)), codes].reshape(len(q), -1).astype(np.float64)
        rounding = (len(self.centres) + 16) * 2.0**-22
        return (np.linalg.norm(q - held, axis=1) + rounding * (np.linalg.norm(held, axis=1) + 1)) * (1 + 1e-6)

    def estimates(self, anchors: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(anchors, rows) sums of lookup-table entries."""
        out, part = np.zeros((len(anchors), len(codes)), np.float32), np.empty((len(anchors), len(codes)), np.float32)
        for m, c in enumerate(self.centres):
            table = anchors[:, 2 * m : 2 * m + 2].astype(np.float32) @ c.T
            np.take(table, codes[:, m], axis=1, out=part, mode="clip")
            out += part
        return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows; shorter ones are filled up with zeros."""
    counts = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), counts)
    out[row, np.arange(len(flat)) - (np.cumsum(counts) - counts)[row]] = flat
    return out


def unpacked(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Binary values of one length as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


class Block:
    """Rows that stand in one task, sorted by label. Of rows with one label and one vector, whose scores are always equal, the
    first `keep` ids are enough."""

    def __init__(self, batches: list[pa.RecordBatch], kind: str, width: int, keep: int) -> None:
        t = pa.Table.from_batches(batches).combine_chunks()
        ids, labels = (t.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
        _, same = np.unique(np.array(t.column("vec").to_pylist(), object), return_inverse=True)
        order = np.lexsort((ids, same, labels))
        ids, labels, same = ids[order], labels[order], same[order]
        new = np.r_[True, (labels[1:] != labels[:-1]) | (same[1:] != same[:-1])]
        fresh = new | np.r_[True, ids[1:] != ids[:-1]]
        nth = np.cumsum(fresh)
        kept = fresh & (nth - np.maximum.accumulate(np.where(new, nth, 0)) < keep)
        order = order[kept]
        self.ids, self.labels = ids[kept], labels[kept]
        t = t.take(pa.array(order))
        self.vecs = unpacked(t.column("vec").combine_chunks(), kind, width)
        self.codes = unpacked(t.column("codes").combine_chunks(), "u1", width // 2)
        self.off = t.column("off").to_numpy().astype(np.float32)


def bounds(books: Codebooks, block: Block, part: np.ndarray | slice, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores: (anchors, rows)."""
    est = books.estimates(anchors, block.codes[part])
    room = (np.linalg.norm(anchors.astype(np.float64), axis=1) * (1 + 1e-6)).astype(np.float32)[:, None] * block.off[part][None, :]
    return est - room, est + room


def kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; -inf where a row has fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf, np.float32)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def exact_scores(a: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Integer inner products of the pairs (i, j)."""
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), step):
        at = slice(s, s + step)
        out[at] = np.einsum("ij,ij->i", a[i[at]].astype(np.int64), v[j[at]].astype(np.int64))
    return out


def first_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's first k: highest score, then smallest id."""
    order = np.lexsort((ids, -score, group))
    starts = np.r_[True, group[order][1:] != group[order][:-1]] if len(order) else np.zeros(0, bool)
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    return order[nth < k]


def same_label(books: Codebooks, block: Block, ids: np.ndarray, labels: np.ndarray, a: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, row, score): each anchor's first k other rows of its label."""
    for label in np.unique(labels):
        lo, hi = np.searchsorted(block.labels, [label, label + 1])
        mine = np.flatnonzero(labels == label)
        if lo == hi:
            continue
        low, high = bounds(books, block, slice(lo, hi), a[mine])
        own = block.ids[lo:hi][None, :] == ids[mine][:, None]
        low[own] = high[own] = -np.inf
        i, j = np.nonzero((high >= kth_largest(low, k)[:, None]) & ~own)
        score = exact_scores(a[mine], block.vecs[lo:hi], i, j)
        best = first_of(i, score, block.ids[lo:hi][j], k)
        yield mine[i[best]], j[best] + lo, score[best]


def in_windows(books: Codebooks, block: Block, labels: np.ndarray, a: np.ndarray, positives: np.ndarray, window: tuple[int, int], k: int) -> Iterator[tuple]:
    """(place, anchor, row, score): for the place-th positive score of each anchor, the first k rows of other labels whose score lies between
    window[0] and window[1] percent of it. positives: (anchors, places), masked where there is none."""
    low, high = bounds(books, block, slice(None), a)
    own = block.labels[None, :] == labels[:, None]
    low[own] = high[own] = -np.inf
    below = lambda x: np.nextafter(x.astype(np.float32), np.float32(-np.inf))[:, None]
    above = lambda x: np.nextafter(x.astype(np.float32), np.float32(np.inf))[:, None]
    for place in range(positives.shape[1]):
        p = positives[:, place]
        least, most = -((-window[0] * p.filled(0)) // 100), (window[1] * p.filled(0)) // 100
        has = np.flatnonzero(~p.mask & (least <= most))
        if not len(has):
            continue
        least, most, l, h = least[has], most[has], low[has], high[has]
        surely = np.where((l >= above(least)) & (h <= below(most)), l, -np.inf)
        reach = np.maximum(kth_largest(surely, k)[:, None], below(least))
        i, j = np.nonzero((h >= reach) & (l <= above(most)) & ~own[has])
        score = exact_scores(a[has], block.vecs, i, j)
        fits = (score >= least[i]) & (score <= most[i])
        i, j, score = i[fits], j[fits], score[fits]
        best = first_of(i, score, block.ids[j], k)
        yield place, has[i[best]], j[best], score[best]


def searcher(books: Codebooks, kind: str, width: int, k: int, window: tuple[int, int] | None) -> Callable:
    """For mapInArrow over partitions sorted by block, rows before anchors."""

    def answer(block: Block, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, labels, keys = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("vec_id", "label", "anchor_key"))
        a = unpacked(part.column("vec"), kind, width)
        none = np.zeros(0, np.int64)
        if window is None:
            found = [(None, *f) for f in same_label(books, block, ids, labels, a, k)]
        else:
            lists = part.column("positives").to_pylist()
            most = max(map(len, lists))
            scores = np.ma.masked_all((len(lists), most), np.int64)
            others = np.zeros((len(lists), most), np.int64)
            for n, x in enumerate(lists):
                for m, p in enumerate(x):
                    scores[n, m], others[n, m] = p["score"], p["vec_id"]
            found = list(in_windows(books, block, labels, a, scores, window, k))
        for place, i, j, score in found:
            n = len(i)
            at = none if place is None else others[i, place]
            gone = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[i]), pa.array(keys[i]), pa.nulls(n, pa.int32()) if place is None else pa.array(np.full(n, place, np.int32)),
                    gone if place is None else pa.array(at), gone if place is None else pa.array(scores[i, place].filled(0)), pa.array(block.ids[j]), pa.array(score),
                ],
                ["anchor_id", "anchor_key", "place", "positive_id", "positive_score", "vec_id", "score"],
            )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, block = None, [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy(zero_copy_only=False)
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            turns = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])]) if len(blocks) else []
            for s, e in zip(turns, [*turns[1:], len(blocks)]):
                if blocks[s] != number:
                    number, rows, block = blocks[s], [], None
                part = batch.slice(s, e - s)
                if not asks[s]:
                    rows.append(part.select(["vec_id", "label", "vec", "codes", "off"]))
                    continue
                if block is None and rows:
                    block, rows = Block(rows, kind, width, k + 1), []
                step = max(1, CELLS // len(block.ids)) if block else 0
                for at in range(0, len(part), step) if block else ():
                    yield from answer(block, part.slice(at, step))
        rows = block = None
        give_back()

    return search


def mine(vectors: DataFrame, is_anchor: Column, n_positive: int = 5, n_negative: int = 5, window: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first n_positive other
    rows of its label, the first n_negative rows of other labels whose score is window[0] to window[1] percent of the positive's.

    vectors: vec_id, label, q (integer_vectors). Higher scores come first, ties by smaller vec_id. Rows equal in id, label and vector count once; rows that
    share an id only are rows of their own, but none is its own anchor's positive. Shorter vectors are filled up with zeros. Anchors without
    positives, windows without rows (every one of a negative positive score) and empty tables give no rows. Scores that a long cannot hold are an error.
    """
    facts = vectors.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(F.greatest(F.abs(F.array_max("q")), F.abs(F.array_min("q"))))).first()
    n, width, top = facts[0], max(2, -(-(facts[1] or 0) // 2) * 2), facts[2] or 0
    if top * top * width >= 1 << 63:
        raise ValueError(f"scores of components up to {top} in {width} dimensions do not fit a long")
    kind = next(k for k, most in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if top < most)
    chance = min(1.0, 1.2 * SAMPLE_ROWS / max(n, 1))
    picked = vectors.filter(F.pmod(F.xxhash64("vec_id", "q"), F.lit(1 << 20)) < int(chance * (1 << 20)) + 1).select("q").limit(2 * SAMPLE_ROWS).toArrow()
    books = Codebooks(matrix(picked.column("q").combine_chunks(), width))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column("q"), width)
            codes = books.encode(q)
            off = books.off(q, codes)
            packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (q.astype(kind), codes)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *packed, pa.array(off)], ["vec_id", "label", "vec", "codes", "off"])
        give_back()

    key = F.xxhash64("vec_id", "label", "vec")
    index = cut(vectors.mapInArrow(encode, INDEX), "vectors")
    n_blocks = max(n_shuffle(vectors.sparkSession), -(-n // BLOCK_ROWS))
    no_list = F.lit(None).cast("array<struct<vec_id:bigint,score:bigint>>")
    rows = index.select(F.pmod(key, F.lit(n_blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "label", "vec", "codes", "off", F.lit(None).cast("bigint").alias("anchor_key"), no_list.alias("positives"))
    anchors = index.filter(is_anchor).select("vec_id", "label", "vec", key.alias("anchor_key")).dropDuplicates(["vec_id", "anchor_key"])

    def met(asking: DataFrame, k: int, within: tuple[int, int] | None) -> DataFrame:
        """Every block's answers for every anchor."""
        dealt = asking.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "label", "vec", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("off"), "anchor_key", "positives")
        both = rows.unionByName(dealt).repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block", "asks")
        return both.mapInArrow(searcher(books, kind, width, k, within), FOUND)

    def first(df: DataFrame, k: int, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    ranked = first(met(anchors.withColumn("positives", no_list), n_positive, None), n_positive, "anchor_id", "anchor_key")
    lists = ranked.groupBy(F.col("anchor_id").alias("vec_id"), "anchor_key").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))
    lists = lists.select("vec_id", "anchor_key", F.transform("p", lambda p: F.struct(p["vec_id"].alias("vec_id"), p["score"].alias("score"))).alias("positives"))
    asking = cut(anchors.join(lists, ["vec_id", "anchor_key"]), "anchors")
    out = first(met(asking, n_negative, window), n_negative, "anchor_id", "anchor_key", "place")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
