"""N-gram Jaccard join: T-occurrence search with DivideSkip, and its components.

1. Every task turns its texts into shingle sets and sends (hash, place of the
   document) postings to hash ranges, packed as arrays: the inverted index. Copies
   of a set within a task are sent once.
2. Each hash range counts the documents of its lists; only postings of lists
   with two documents or more go back to where they came from.
3. A document linked to another shares at least the needed part of its set, so
   documents that share less are done. For the rest, the shared hashes are kept in
   order of list length (rarest first).
4. Linked documents share a hash in their prefixes (set size - needed overlap + 1,
   rarest first). Documents connected through prefixes form blocks. In a block that is too
   large all documents linked with one pivot merge, and the others look for theirs in
   units of equal prefix hashes (`large_blocks`).
5. In a block, DivideSkip answers each document's T-occurrence query: short lists are
   merged and counted, long lists are probed by binary search, and documents that reach the
   overlap are linked. A candidate already in the component is skipped, which
   loses no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, mix64, n_shuffle, planned_bytes, shingle_hashes, text_slices, word_hashes, words_of
from .components import connected_components

LOW = np.uint64((1 << 48) - 1)
#: Postings a task gathers before it sends them, and documents (places are 16 bits).
FLUSH, PLACES = 1_500_000, 60_000
#: Bytes of input (as the plan estimates them) for a hash range, and for a task of its exchanges.
RANGE_BYTES, TASK_BYTES = 8 << 20, 64 << 20
#: Postings of a block that is joined in one task; larger blocks are dealt over units of about half of that.
UNIT_POSTINGS = 4_000_000
#: DivideSkip's weight of the length of the longest list, from the published experiments.
MU = 0.0085

POSTED = "bucket int, kind int, batch bigint, blob binary"
BACK = "batch bigint, kind int, blob binary"
SETS = "doc_id bigint, n_shingles bigint, key binary, posted boolean, n_prefix int, shared binary"


def range_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The hash range of each shingle, any number of ranges; it follows from all 64 bits, of which 48 are stored with a posting."""
    return (((mix64(hashes) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint32)


def pack(hashes: np.ndarray, *more: np.ndarray) -> bytes:
    """Arrays of equal length, one after another: 48-bit hashes as 4 and 2 bytes, then 16-bit integers."""
    return b"".join([np.uint32(len(hashes)).tobytes(), hashes.astype(np.uint32).tobytes(), (hashes >> np.uint64(32)).astype(np.uint16).tobytes(), *(m.astype(np.uint16).tobytes() for m in more)])


def unpack(blob: bytes, more: int) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    low = np.frombuffer(blob, np.uint32, n, 4).astype(np.uint64)
    high = np.frombuffer(blob, np.uint16, n, 4 + 4 * n).astype(np.uint64)
    return [low | (high << np.uint64(32)), *(np.frombuffer(blob, np.uint16, n, 4 + 6 * n + 2 * n * i) for i in range(more))]


def doc_sets(batch: pa.RecordBatch, n: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and the number of each."""
    words, counts = words_of(batch.column("text"), lower)
    hashes, owner = shingle_hashes(word_hashes(words), counts, n)
    order = np.lexsort((hashes, owner)) if len(counts) > 1 else np.argsort(hashes)
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(counts))


def post(n: int, lower: bool, buckets: int):
    """Postings by hash range, and the table of each batch's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        task, batch_no, seen = TaskContext.get().partitionId(), 0, set()
        ids, sizes, keys, posted, held, places, waiting = [], [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal batch_no, waiting
            name = (task << 24) | batch_no
            h = np.concatenate(held) if held else np.zeros(0, np.uint64)
            at = np.repeat(np.array(places, np.uint16), [len(x) for x in held]) if held else np.zeros(0, np.uint16)
            to = range_of(h, buckets)
            order = np.argsort(to, kind="stable")
            h, at, to = (h & LOW)[order], at[order], to[order]
            starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, int)
            rows = [(int(to[a]), 1, name, pack(h[a:b], at[a:b])) for a, b in zip(starts, [*starts[1:], len(to)])]
            table = b"".join([np.uint32(len(ids)).tobytes(), np.array(ids, np.int64).tobytes(), np.array(sizes, np.int64).tobytes(), np.array(posted, np.uint8).tobytes(), b"".join(keys)])
            rows.append((name % buckets, 0, name, table))
            batch_no, waiting = batch_no + 1, 0
            for x in (ids, sizes, keys, posted, held, places):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["bucket", "kind", "batch", "blob"])

        for batch in text_slices(batches):
            h, size = doc_sets(batch, n, lower)
            ends = np.cumsum(size)
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), ends - size, ends):
                key = xxhash.xxh3_128_digest(h[a:b].tobytes()) if b > a else bytes(16)
                new = b > a and key not in seen
                if new:
                    seen.add(key)
                    held.append(h[a:b])
                    places.append(len(ids))
                    waiting += b - a
                ids.append(doc_id)
                sizes.append(b - a)
                keys.append(key)
                posted.append(new)
                if waiting >= FLUSH or len(ids) >= PLACES:
                    yield flush()
        if ids:
            yield flush()

    return run


def count_lists(table: pa.Table) -> pa.Table:
    """One hash range: postings of lists with two documents or more, with the list's length, by batch."""
    give_back()  # what the previous range used
    kinds, names, blobs = (table.column(c).to_pylist() for c in ("kind", "batch", "blob"))
    out = [(b, 0, x) for k, b, x in zip(kinds, names, blobs) if k == 0]
    lists = [(b, unpack(x, 1)) for k, b, x in zip(kinds, names, blobs) if k == 1]
    if lists:
        bucket = table.column("bucket")[0].as_py()
        h = np.concatenate([x[0] for _, x in lists])
        order = np.argsort(h)
        ordered = h[order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        lengths = np.diff(np.r_[starts, len(h)])
        df = np.empty(len(h), np.int64)
        df[order] = np.repeat(lengths, lengths)
        first = 0
        for name, (x, at) in lists:
            mine = df[first : first + len(x)]
            first += len(x)
            keep = mine >= 2
            if keep.any():
                out.append((name, 1, np.uint32(bucket).tobytes() + pack(x[keep], at[keep], np.minimum(mine[keep], 65_535))))
    return pa.table({"batch": pa.array([x[0] for x in out], pa.int64()), "kind": pa.array([x[1] for x in out], pa.int32()), "blob": pa.array([x[2] for x in out], pa.binary())})


def needed_of_own(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap with any linked document: percent of the own size, rounded up."""
    return -(-percent * sizes // 100)


def gather_sets(percent: int):
    """One batch: a row per document; those that can still be linked carry their shared hashes, rarest first."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        kinds, blobs = (table.column(c).to_pylist() for c in ("kind", "blob"))
        top = next(x for k, x in zip(kinds, blobs) if k == 0)
        n = int(np.frombuffer(top, np.uint32, 1)[0])
        ids, sizes = np.frombuffer(top, np.int64, n, 4), np.frombuffer(top, np.int64, n, 4 + 8 * n)
        posted = np.frombuffer(top, np.uint8, n, 4 + 16 * n).astype(bool)
        keys = [top[4 + 17 * n + 16 * i : 4 + 17 * n + 16 * i + 16] for i in range(n)]
        parts = [(np.frombuffer(x, np.uint32, 1)[0], unpack(x[4:], 2)) for k, x in zip(kinds, blobs) if k == 1]
        shared: list[bytes | None] = [None] * n
        prefix = np.zeros(n, np.int64)
        if parts:
            h = np.concatenate([x[0] | ((np.uint64(b) & np.uint64(0xFFFF)) << np.uint64(48)) for b, x in parts])
            at = np.concatenate([x[1] for _, x in parts]).astype(np.int64)
            df = np.concatenate([x[2] for _, x in parts]).astype(np.uint32)
            have = np.bincount(at, minlength=n)
            need = needed_of_own(sizes, percent)
            stay = (have >= need) & (need > 0)
            mine = stay[at]
            h, at, df = h[mine], at[mine], df[mine]
            order = np.lexsort((h, df, at))
            h, at = h[order], at[order]
            ends = np.cumsum(np.bincount(at, minlength=n))
            prefix = np.maximum(sizes - need + 1 - (sizes - have), 0)
            for i in np.flatnonzero(stay):
                shared[i] = h[ends[i] - have[i] : ends[i]].tobytes()
        return pa.table(
            {"doc_id": pa.array(ids, pa.int64()), "n_shingles": pa.array(sizes, pa.int64()), "key": pa.array([k if s else None for k, s in zip(keys, sizes)], pa.binary()), "posted": pa.array(posted), "n_prefix": pa.array(prefix, pa.int32()), "shared": pa.array(shared, pa.binary())}
        )

    return run


class Groups:
    """Disjoint groups of 0..n-1 with a vector of current labels; the smaller side is relabelled."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.members: dict[int, list[int]] = {}

    def join(self, a: int, b: int) -> None:
        x, y = int(self.label[a]), int(self.label[b])
        if x == y:
            return
        mx, my = self.members.pop(x, None) or [x], self.members.pop(y, None) or [y]
        if len(mx) < len(my):
            x, y, mx, my = y, x, my, mx
        self.label[my] = x
        self.members[x] = mx + my


def divide_skip(hashes: np.ndarray, sizes: np.ndarray, have: np.ndarray, groups: Groups, queries: np.ndarray, percent: int) -> int:
    """Link documents (have[i] consecutive hashes each) whose Jaccard index is percent or more, in groups.

    Returns the number of links it made. The needed overlap of sizes x, y is ceil(p (x + y) / (100 + p)).
    """
    ends = np.cumsum(have)
    owner = np.repeat(np.arange(len(sizes)), have)
    order = np.lexsort((owner, hashes))
    entries = owner[order]
    new = np.r_[True, hashes[order][1:] != hashes[order][:-1]] if len(order) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    lengths = np.diff(np.r_[starts, len(order)])
    list_of = np.empty(len(order), np.int64)
    list_of[order] = np.cumsum(new) - 1
    links = 0
    for q in queries:
        own = list_of[ends[q] - have[q] : ends[q]]
        own = own[lengths[own] > 1]
        least = -(-percent * int(sizes[q]) // 100)
        if len(own) < least or not least:
            continue
        size = lengths[own]
        by = np.argsort(size, kind="stable")
        longest = int(size[by[-1]])
        n_long = min(least - 1, int(least / (MU * math.log2(longest) + 1)))
        split = len(own) - n_long
        short, long = own[by[:split]], own[by[split:]]
        n = lengths[short]
        total = int(n.sum())
        at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[short], n)
        merged = entries[at]
        if total * 8 < len(sizes):
            cand, count = np.unique(merged, return_counts=True)
        else:
            count = np.bincount(merged, minlength=len(sizes))
            cand = np.flatnonzero(count)
            count = count[cand]
        need = -(-percent * (sizes[q] + sizes[cand]) // (100 + percent))
        ok = (count + n_long >= need) & (groups.label[cand] != groups.label[q])
        cand, count, need = cand[ok], count[ok], need[ok]
        for k, one in enumerate(long):
            if not len(cand):
                break
            here = entries[starts[one] : starts[one] + lengths[one]]
            found = np.searchsorted(here, cand)
            found[found == len(here)] = 0
            count = count + (here[found] == cand)
            ok = count + (n_long - k - 1) >= need
            if not ok.all():
                cand, count, need = cand[ok], count[ok], need[ok]
        for c in cand:
            if groups.label[c] != groups.label[q]:
                groups.join(int(q), int(c))
                links += 1
    return links


def prefix_postings(buckets: int):
    """Within a task, documents that share a prefix hash are united; one posting per hash and task goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            held += [np.frombuffer(x, np.uint64)[:p] for x, p in zip(batch.column("shared").to_pylist(), batch.column("n_prefix").to_pylist())]
        if not ids:
            return
        h, owner = np.concatenate(held), np.repeat(np.arange(len(ids)), [len(x) for x in held])
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        groups = Groups(len(ids))
        same = np.flatnonzero(h[1:] == h[:-1])
        for a, b in {(int(owner[i]), int(owner[i + 1])) for i in same}:
            groups.join(a, b)
        ids = np.array(ids, np.int64)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, groups.label, ids)
        root = least[groups.label]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        h, r = h[new], root[owner[new]]
        to = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        h, r, to = h[order], r[order], to[order]
        starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else []
        rows = [(int(to[a]), 1, h[a:b].tobytes() + r[a:b].tobytes()) for a, b in zip(starts, [*starts[1:], len(to)])]
        own = ids != root
        rows.append((int(ids[0] % buckets), 0, ids[own].tobytes() + root[own].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "blob"])

    return run


def prefix_edges(table: pa.Table) -> pa.Table:
    """One hash range: an edge from each group on a list to the first of the list."""
    give_back()
    a, b = [], []
    hs, rs = [], []
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()):
        x = np.frombuffer(blob, np.int64)
        if kind == 0:
            a.append(x[: len(x) // 2])
            b.append(x[len(x) // 2 :])
        else:
            hs.append(x[: len(x) // 2])
            rs.append(x[len(x) // 2 :])
    if hs:
        h, r = np.concatenate(hs), np.concatenate(rs)
        order = np.lexsort((r, h))
        h, r = h[order], r[order]
        new = np.r_[True, h[1:] != h[:-1]]
        first = r[np.flatnonzero(new)][np.cumsum(new) - 1]
        pairs = np.unique(np.stack([r, first], 1)[r != first], axis=0)
        a.append(pairs[:, 0])
        b.append(pairs[:, 1])
    none = np.zeros(0, np.int64)
    return pa.table({"a": pa.array(np.concatenate([none, *a]), pa.int64()), "b": pa.array(np.concatenate([none, *b]), pa.int64())})


def join_unit(percent: int):
    """One unit of blocks: every document with the smallest document of its group, as an edge."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        node = table.column("node").to_numpy()
        sizes = table.column("n_shingles").to_numpy()
        held = [np.frombuffer(x, np.uint64) for x in table.column("shared").to_pylist()]
        have = np.array([len(x) for x in held])
        groups = Groups(len(node))
        roots: dict[int, int] = {}
        for i, r in enumerate(table.column("merged").to_pylist()):
            if r is not None:
                groups.join(i, roots.setdefault(r, i))
        queries = np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False))
        queries = queries[np.argsort(sizes[queries], kind="stable")]
        divide_skip(np.concatenate(held), sizes, have, groups, queries, percent)
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, groups.label, node)
        root = least[groups.label]
        return pa.table({"a": pa.array(node, pa.int64()), "b": pa.array(root, pa.int64())})

    return run


def with_pivot(percent: int):
    """Jaccard index with the block's pivot, from shared hashes and sizes: linked or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("shared", "p_shared", "n_shingles", "p_n"))):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                linked.append(100 * both >= percent * (n + m - both))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(linked)], ["node", "linked"])

    return run


def prefix_units(units: str = "k"):
    """(unit of the block, node ...) for every unit in which a document has a prefix hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, places = [], []
            for node, k, p, x in zip(*(batch.column(c).to_pylist() for c in ("node", units, "n_prefix", "shared"))):
                found = np.unique(np.frombuffer(x, np.uint64)[:p] % np.uint64(k)).astype(np.int64)
                nodes += [node] * len(found)
                places += found.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(places, pa.int64())], ["node", "place"])

    return run


def large_blocks(members: DataFrame, large: DataFrame, percent: int, unit_postings: int) -> DataFrame:
    """Links (a, b) inside blocks above unit_postings.

    All documents linked with the block's pivot merge first. Linked documents share a prefix hash, so the block is
    dealt over k units by prefix hashes, and only documents that are not linked with the pivot ask in theirs. A unit that is still too
    large, since many documents have one hash in their prefixes, is cut into chunks: an asking chunk meets every chunk of its unit.
    Nothing here is broadcast: pivots go to the chunks of their block.
    """
    spread = members.join(large.select("component", "pivot", "k"), "component").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    pivots = large.select("component", "pivot", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("chunk"))
    pivots = pivots.join(members.select(F.col("node").alias("pivot"), F.col("shared").alias("p_shared"), F.col("n_shingles").alias("p_n")), "pivot").drop("pivot")
    linked = spread.join(pivots, ["component", "chunk"]).select("node", "shared", "p_shared", "n_shingles", "p_n").mapInArrow(with_pivot(percent), "node bigint, linked boolean")
    big = cut(spread.drop("chunk").join(linked, "node"), "large")
    merged = big.filter("linked AND node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    dealt = big.select("node", "k", "n_prefix", "shared").mapInArrow(prefix_units(), "node bigint, place bigint")
    dealt = cut(dealt.join(big.select("node", "component", "linked", F.octet_length("shared").alias("weight")), "node"), "dealt")
    weights = dealt.groupBy("component", "place").agg((F.sum("weight") / 8).alias("postings"), F.count_if(~F.col("linked")).alias("asking"))
    # a unit in which nobody asks has no open links
    weights = weights.filter("asking > 0").select("component", "place", F.ceil(2 * F.col("postings") / unit_postings).cast("int").alias("n"))
    placed = dealt.join(weights, ["component", "place"]).withColumn("chunk", F.pmod(F.xxhash64("node", "place"), F.col("n")).cast("int"))
    unit = lambda i, j: F.concat_ws(":", "component", "place", i, j)
    others = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("linked") | (i != F.col("chunk")))
    asked = placed.select(F.explode(others).alias("i"), "*").select(unit(F.col("i"), F.col("chunk")).alias("unit"), "node", F.lit(False).alias("asks"))
    asking = placed.filter("NOT linked").select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"), "*").select(unit(F.col("chunk"), F.col("j")).alias("unit"), "node", F.lit(True).alias("asks"))
    facts = big.select("node", "n_shingles", "shared", F.when(F.col("linked"), F.col("pivot")).alias("merged"))
    met = asking.union(asked).join(facts, "node").groupBy("unit").applyInArrow(join_unit(percent), "a bigint, b bigint").filter("a <> b")
    return connected_components(met.union(merged)).select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b")


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 75, lower: bool = True, unit_postings: int = UNIT_POSTINGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every input row.

    A set holds the distinct n-word shingles (ASCII lower case); fewer words give
    one shingle, no words (null, empty, blank) an empty set that links with nothing. Documents
    link when 100 * intersection >= percent * union; component_id is the smallest
    id reached. Repeated rows are kept. Rows of one id with different
    texts each have the component of their text; where the id is the smallest of both, the texts count as linked. A row with a null id is returned with a
    null component and links with nothing. An empty table gives no rows. Other columns,
    whatever their names, are ignored.
    """
    return joined_sets(docs, n, percent, lower, unit_postings, id_col, text_col).drop("key")


def joined_sets(docs: DataFrame, n: int, percent: int, lower: bool, unit_postings: int, id_col: str, text_col: str) -> DataFrame:
    """ngram_join's rows, each with the key of its set (null without words or without an id)."""
    spark = docs.sparkSession
    parts, size = n_shuffle(spark), planned_bytes(docs)
    buckets = max(64, 2 * parts, -(-size // RANGE_BYTES))
    ranges = max(parts, -(-size // TASK_BYTES))
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    posted = named.filter("doc_id IS NOT NULL").mapInArrow(post(n, lower, buckets), POSTED)
    back = posted.repartition(ranges, "bucket").groupBy("bucket").applyInArrow(count_lists, BACK)
    sets = cut(back.repartition(ranges, "batch").groupBy("batch").applyInArrow(gather_sets(percent), SETS), "sets")

    # one node for all documents with the same set, named after the smallest id
    classes = cut(sets.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("node"), F.min(F.when(F.col("posted"), F.col("doc_id"))).alias("speaker"), F.count(F.lit(1)).alias("copies")), "classes")
    open_sets = sets.filter("posted AND shared IS NOT NULL")
    postings = open_sets.select("doc_id", "n_prefix", "shared").mapInArrow(prefix_postings(buckets), "bucket int, kind int, blob binary")
    edges = postings.repartition(ranges, "bucket").groupBy("bucket").applyInArrow(prefix_edges, "a bigint, b bigint")
    blocks = connected_components(edges)
    nodes = classes.select("node", F.col("speaker").alias("_speaker"))
    members = open_sets.join(blocks, open_sets["doc_id"] == blocks["node"]).drop("node").join(nodes, F.col("doc_id") == F.col("_speaker")).select("node", "component", "n_shingles", "n_prefix", "shared")
    members = cut(members, "members")

    weights = members.groupBy("component").agg(F.sum(F.octet_length("shared") / 8).alias("postings"), F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("pivot"), F.count(F.lit(1)).alias("n"))
    # at most (all postings / unit_postings) blocks are large
    large = cut(weights.filter(F.col("postings") > unit_postings).withColumn("k", F.ceil(2 * F.col("postings") / unit_postings).cast("int")), "large")
    fits = weights.filter((F.col("postings") <= unit_postings) & (F.col("n") > 1))
    units = max(4 * parts, math.ceil(2 * (fits.agg(F.sum("postings")).first()[0] or 0) / unit_postings))
    small = members.join(fits.select("component"), "component")
    small = small.select(F.pmod(F.xxhash64("component"), F.lit(units)).alias("unit"), "node", "n_shingles", "shared", F.lit(True).alias("asks"), F.lit(None).cast("bigint").alias("merged"))
    of_unit = "a bigint, b bigint"
    links = small.repartition(max(parts, -(-units // 4)), "unit").groupBy("unit").applyInArrow(join_unit(percent), of_unit).filter("a <> b")
    if large.limit(1).count():
        links = links.union(large_blocks(members, large, percent, unit_postings))
    found = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    told = classes.join(found, "node", "left").select("key", F.coalesce("component", "node").alias("_component"), "copies", F.col("component").isNotNull().alias("moved")).filter("copies > 1 OR moved").select("key", "_component")
    out = sets.select("doc_id", "n_shingles", "key").join(told, "key", "left")
    out = out.select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"), "key")
    no_id = named.filter("doc_id IS NULL")
    if no_id.limit(1).count():
        size = no_id.mapInArrow(set_sizes(n, lower), "n_shingles bigint")
        out = out.union(size.select(F.lit(None).cast("bigint"), "n_shingles", F.lit(None).cast("bigint"), F.lit(None).cast("binary")))
    return out


def set_sizes(n: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(doc_sets(batch, n, lower)[1], pa.int64())], ["n_shingles"])

    return run


def keep_one(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are the smallest id of their component; all columns unchanged.

    An id that comes with several sets of shingles names no single text: its rows all stay, so no text is lost. Rows with a null id stay.
    """
    ids = joined_sets(docs, n, percent, True, UNIT_POSTINGS, id_col, text_col).filter(F.col(id_col).isNotNull()).withColumn("key", F.coalesce("key", F.lit(b"")))
    lost = ids.groupBy(F.col(id_col).alias("_gone")).agg(F.min("component_id").alias("_first"), F.min("key").alias("_a"), F.max("key").alias("_b"))
    gone = lost.filter("_gone <> _first AND _a = _b").select("_gone")
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
