"""Packing documents into sequences: patterns by non-negative least squares, then best fit.

Only the histogram of piece lengths (at most one count for each length up to the sequence
length) reaches the driver. There, patterns of a few length bins that fill a
sequence are enumerated, repeat counts are fitted to the binned histogram by
non-negative least squares and rounded down, and lengths are drawn for them; what is left goes
best-fit-decreasing into the room that remains, for all pieces of one
length at once. The result is a table of runs: the pieces of a length ranked
first..first+count-1 go to consecutive sequences at one offset. Ranks are given by a
distributed count over (length, bucket), so a third of all pieces may have one length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import encoded_slices

PIECES = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint"
#: Pieces that a (length, bucket) group has at most, about; a group is ranked in one task. And least buckets.
GROUP, LEAST = 50_000, 64


def cut_documents(tokenizer: str, end_id: int, room: int):
    """Pieces of at most room ids of every document, its end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, counts in encoded_slices(batches, tokenizer):
            ends = np.cumsum(counts + 1)
            out = np.full(int(ends[-1]), end_id, "<u4")
            inside = np.ones(len(out), bool)
            inside[ends - 1] = False
            out[inside] = ids
            view = memoryview(out).cast("B")
            rows = [(d, p, p * room, min(room, n - p * room), zlib.crc32(view[4 * (e - n + p * room) : 4 * min(e, e - n + (p + 1) * room)])) for d, e, n in zip(batch.column("doc_id").to_pylist(), ends.tolist(), (counts + 1).tolist()) for p in range(-(-n // room))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def nnls(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|: active sets on the normal equations (Lawson and Hanson)."""
    n = a.shape[1]
    gram, target = a.T @ a, a.T @ b
    x, active = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(most or 3 * n):
        slope = target - gram @ x
        slope[active] = -np.inf
        new = int(np.argmax(slope))
        if slope[new] <= tol:
            break
        active[new] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(gram[np.ix_(at, at)], target[at], rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            gone = at[(x[at] <= tol * 1e-3) & low]
            active[gone] = False
            x[~active] = 0
            if not len(gone):
                return x
    return x


def patterns(bins: int, most_docs: int) -> list[tuple[int, ...]]:
    """Non-increasing bin tuples (1..bins) of at most most_docs entries that sum to bins."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, top: int, taken: tuple[int, ...]) -> None:
        if left == 0:
            out.append(taken)
        elif len(taken) < most_docs:
            for b in range(min(left, top), 0, -1):
                if b * (most_docs - len(taken)) < left:
                    break
                grow(left - b, b, (*taken, b))

    grow(bins, bins, ())
    return out


@dataclass
class Plan:
    """runs: (length, first rank, count, first sequence, offset)."""

    room: int
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    n_sequences: int = 0
    n_by_pattern: int = 0


class Stock:
    """Pieces left of each length, handed out by rank."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.left = dict(histogram)
        self.next = dict.fromkeys(histogram, 0)

    def take(self, length: int, n: int) -> int:
        first = self.next[length]
        self.next[length] += n
        self.left[length] -= n
        return first


def make_plan(histogram: dict[int, int], room: int, bins: int = 64, most_docs: int = 3) -> Plan:
    """Sequences for all pieces of the histogram; work depends on lengths, not on pieces."""
    plan, stock = Plan(room), Stock(histogram)
    width = -(-room // bins)
    binned = np.zeros(bins)
    by_bin: dict[int, list[int]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        binned[(length - 1) // width] += histogram[length]
        by_bin[(length - 1) // width].append(length)
    open_room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> (first sequence, count)

    def place(length: int, sequences: int, count: int, used: int) -> None:
        plan.runs.append((length, stock.take(length, count), count, sequences, used))

    def new_sequences(lengths: tuple[int, ...], count: int) -> None:
        first, used = plan.n_sequences, 0
        plan.n_sequences += count
        for length in lengths:
            place(length, first, count, used)
            used += length
        if used < room:
            open_room[room - used].append((first, count))

    made = patterns(bins, most_docs)
    a = np.zeros((bins, len(made)))
    for j, p in enumerate(made):
        for b in p:
            a[b - 1, j] += 1
    fitted = nnls(a, binned)
    for j in np.argsort(-fitted):
        repeat = int(fitted[j])
        while repeat > 0:
            pick: list[int] = []
            gone: Counter = Counter()
            for b in made[j]:
                length = next((x for x in by_bin[b - 1] if stock.left[x] > gone[x]), None)
                if length is None:
                    break
                pick.append(length)
                gone[length] += 1
            if len(pick) < len(made[j]):
                break
            n = min(repeat, *(stock.left[x] // c for x, c in gone.items()))
            new_sequences(tuple(pick), n)
            repeat -= n
            for b in made[j]:
                while by_bin[b - 1] and not stock.left[by_bin[b - 1][0]]:
                    by_bin[b - 1].pop(0)
    plan.n_by_pattern = plan.n_sequences
    # the rest, longest first, each into the smallest room that holds it
    rooms = sorted(open_room)
    for length in sorted(histogram, reverse=True):
        while stock.left[length]:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                new_first, fit = plan.n_sequences, room // length
                n = -(-stock.left[length] // fit)
                full, rest = divmod(stock.left[length], fit)
                plan.n_sequences += n
                for k in range(fit):
                    count = full + (1 if k < rest else 0)
                    if count:
                        place(length, new_first, count, k * length)
                for first, count, used in ((new_first, full, fit * length), (new_first + full, 1 if rest else 0, rest * length)):
                    if count and used < room:
                        left = room - used
                        if left not in open_room or not open_room[left]:
                            bisect.insort(rooms, left)
                        open_room[left].append((first, count))
                break
            space = rooms[i]
            first, count = open_room[space].pop()
            if not open_room[space]:
                rooms.pop(i)
            n = min(count, stock.left[length])
            place(length, first, n, room - space)
            for left, start, many in ((space - length, first, n), (space, first + n, count - n)):
                if many and left:
                    if not open_room[left]:
                        bisect.insort(rooms, left)
                    open_room[left].append((start, many))
    return plan


def ranked(pieces: DataFrame, group: int = GROUP) -> DataFrame:
    """pieces with `rank`: 0.. within each length, by counts of (length, bucket) and a row number inside."""
    total = pieces.count()
    buckets = max(LEAST, -(-total // group))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    numbered = dealt.withColumn("_row", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["length", "_bucket"]).withColumn("rank", F.col("_before") + F.col("_row")).drop("_bucket", "_before", "_row")


def assign(plan: Plan):
    """Sequence and offset of every ranked piece: a binary search among the runs of its length."""
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    lengths, first, sequence, offset = runs[:, 0], runs[:, 1], runs[:, 3], runs[:, 4]
    bounds = np.searchsorted(lengths, np.arange(plan.room + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            at = np.empty(len(rank), np.int64)
            for n in np.unique(length):
                mine = length == n
                a, b = bounds[n], bounds[n + 1]
                at[mine] = a + np.searchsorted(first[a:b], rank[mine], side="right") - 1
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(sequence[at] + rank - first[at], pa.int64()), pa.array(offset[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_pieces(pieces: DataFrame, room: int, bins: int = 64, most_docs: int = 3) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32; length 1..room) in sequences.

    Repeated rows are placed as often as they occur; no pieces give no rows.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = make_plan(histogram, room, bins, most_docs)
    return ranked(pieces).mapInArrow(assign(plan), PIECES + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, room: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece.

    A document is its ids and end_id; only longer ones than room are cut. A null text counts
    as empty (one id). Rows with a null doc_id are packed like others. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = cut(rows.mapInArrow(cut_documents(tokenizer, end_id, room), PIECES), "pieces")
    out = pack_pieces(pieces, room)
    return out.select("doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, end_id: int, room: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sequence_id and ids (array): the token ids of every packed sequence.

    packed is what pack_documents gave for the same docs. Ids have to be unique and not null here, since pieces meet their texts by (doc_id, piece):
    repeated rows would meet each other's. Null texts are their end id; empty tables give no rows; other columns are ignored.
    """

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, counts in encoded_slices(batches, tokenizer):
            ends = np.cumsum(counts)
            rows = [(d, p, chunk) for d, e, n in zip(batch.column("doc_id").to_pylist(), ends.tolist(), counts.tolist()) for whole in [[*ids[e - n : e].tolist(), end_id]] for p, chunk in enumerate(whole[i : i + room] for i in range(0, n + 1, room))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.list_(pa.int32())))], ["doc_id", "piece", "ids"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(ids_of, "doc_id bigint, piece int, ids array<int>")
    placed = found.join(packed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
