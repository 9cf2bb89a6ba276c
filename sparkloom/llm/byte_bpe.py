"""Byte-level BPE through a global distinct-word shuffle, and decoding by a token-byte table.

1. Every task explodes its texts into pre-tokens with their positions, one block of
   documents at a time: a sorted local vocabulary dealt over word ranges, and the words' numbers at
   each position, packed.
2. A word range receives a word from all blocks, encodes each distinct word once
   (merges by rank, each pre-token separately), and joins the ids back to the asking blocks.
3. Each block meets the ids of its words and puts them together by position.

The first exchange carries words and blocks on one key, and both later steps read
it, so the positions are shuffled once. A block that gets ids of other words than it sent is an error.

Decoding joins every id with the table of token bytes, which has one row for each
rank (a fixed size) and therefore sits in every task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_shuffle, planned_bytes, text_slices
from .tokens import cut_pieces, spread

#: Bytes of text in a block; a block is put together in one task.
BLOCK_BYTES = 10 << 20
#: Ids that are decoded at once, or those of one text.
SLICE_IDS = 1 << 20
#: Bytes of input (as the plan estimates them) for a range of words, which one task encodes.
RANGE_BYTES = 32 << 20
SENT = "route bigint, block bigint, blob binary"
BACK = "route bigint, bucket int, blob binary"
ENCODED = "doc_id bigint, ids array<int>"


def press(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def plain(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed(*parts: bytes) -> bytes:
    return b"".join([np.array([len(parts), *map(len, parts)], np.int64).tobytes(), *parts])


def unpacked(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, n, 8).tolist()
    out, at = [], 8 * (n + 1)
    for size in sizes:
        out.append(blob[at : at + size])
        at += size
    return out


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, compressed."""
    return press(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def from_planes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(plain(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").reshape(-1)


def mark_of(sizes: bytes, words: bytes) -> int:
    """Tells the words that a block sent to a range from any others."""
    import xxhash

    return xxhash.xxh64_intdigest(sizes + words)


class Block:
    """Pre-tokens of a run of documents: numbers by position, and a vocabulary."""

    def __init__(self, pattern) -> None:
        self.pattern = pattern
        self.words: dict[str, int] = {}
        self.ids: list = []
        self.sizes: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []
        self.bytes = 0

    def add(self, batch: pa.RecordBatch) -> None:
        pieces, counts = cut_pieces(batch.column("text"))
        coded = pieces.dictionary_encode()
        words, flat, lengths = self.words, [], []
        for piece in coded.dictionary.to_pylist():
            found = self.pattern.findall(piece)
            flat += [words.setdefault(w, len(words)) for w in found]
            lengths.append(len(found))
        numbers, lengths = np.array(flat, np.int64), np.array(lengths, np.int64)
        at = coded.indices.to_numpy()
        size = lengths[at]
        self.codes.append(numbers[spread(size, (np.cumsum(lengths) - lengths)[at])].astype(np.uint32))
        ends, sums = np.cumsum(counts), np.r_[0, np.cumsum(size)]
        self.sizes.append(sums[ends] - sums[ends - counts])
        self.ids += batch.column("doc_id").to_pylist()
        self.bytes += pieces.nbytes

    def rows(self, block: int, buckets: int) -> list[tuple]:
        import xxhash

        raw = [w.encode("utf-8", "surrogatepass") for w in self.words]
        to = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in raw), np.int64, len(raw))
        order = np.array(sorted(range(len(raw)), key=raw.__getitem__), np.int64)
        order = order[np.argsort(to[order], kind="stable")]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes = place[np.concatenate(self.codes)] if self.codes else np.zeros(0, np.int64)
        counts = np.bincount(codes, minlength=len(raw))
        # frequent words get small numbers, which pack well; the counts tell the order again
        rank = np.empty(len(raw), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(raw))
        known = np.array([x is not None for x in self.ids], np.uint8)
        out, marks = [], []
        ordered = to[order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(order) else []
        for a, b in zip(starts, [*starts[1:], len(order)]):
            mine = [raw[i] for i in order[a:b]]
            sizes, joined = np.array([len(w) for w in mine], np.uint32).tobytes(), b"".join(mine)
            marks.append((int(ordered[a]), mark_of(sizes, joined)))
            out.append((int(ordered[a]), block, packed(sizes, press(joined))))
        parts = (np.array([x or 0 for x in self.ids], np.int64).tobytes(), known.tobytes(), np.concatenate(self.sizes).astype(np.int64).tobytes(), planes(counts), planes(rank[codes]))
        out.append((buckets + block, block, packed(*parts, np.array(marks, np.uint64).tobytes())))
        return out


def explode_words(pattern: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        task, number = TaskContext.get().partitionId(), 0
        compiled = regex.compile(pattern)

        def sent(block: Block) -> pa.RecordBatch:
            rows = block.rows((task << 24) | number, buckets)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["route", "block", "blob"])

        block = Block(compiled)
        for batch in text_slices(batches):
            block.add(batch)
            if block.bytes >= BLOCK_BYTES:
                yield sent(block)
                block, number = Block(compiled), number + 1
        if block.ids:
            yield sent(block)

    return run


@cache
def rank_encoding(ranks_path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=token_bytes(ranks_path), special_tokens={})


@cache
def token_bytes(ranks_path: str) -> dict[bytes, int]:
    with open(ranks_path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encode_words(ranks_path: str, pattern: str, buckets: int):
    """One word range: each distinct word is encoded once, its ids go to every block that has it."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("route")[0].as_py()
        routes, blobs = [], []
        if bucket < buckets:
            encoding = rank_encoding(ranks_path, pattern)
            known: dict[bytes, list[int]] = {}
            for block, blob in zip(*(table.column(c).to_pylist() for c in ("block", "blob"))):
                sizes, joined = unpacked(blob)
                words, at = plain(joined), 0
                mark = np.uint64(mark_of(sizes, words)).tobytes()
                found = []
                for n in np.frombuffer(sizes, np.uint32).tolist():
                    word = words[at : at + n]
                    at += n
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = encoding.encode_ordinary(word.decode("utf-8", "surrogatepass"))
                    found.append(ids)
                lengths = np.fromiter(map(len, found), np.uint32, len(found))
                flat = np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum()))
                routes.append(buckets + block)
                blobs.append(packed(planes(lengths), planes(flat), mark))
        return pa.table({"route": pa.array(routes, pa.int64()), "bucket": pa.array([bucket] * len(routes), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


def reassemble(blocks: pa.Table, back: pa.Table) -> pa.Table:
    """One block and the ids of its words: ids of every document, by position. Other routes give nothing."""
    none = np.zeros(0, np.uint32)
    parts = sorted(((b, *unpacked(x)) for b, x in zip(back.column("bucket").to_pylist(), back.column("blob").to_pylist())), key=lambda x: x[0]) if back.num_rows else []
    offsets, ids, doc_ids, known = np.zeros(1, np.int32), none, b"", b""
    blob = blocks.column("blob")[0].as_py() if blocks.num_rows else b""
    top = unpacked(blob) if blob else []
    if len(top) == 6:
        doc_ids, known, sizes, counts, ranks, marks = top
        # a block that was made again from rows in another order has other words or numbers: that must never mix with older ids
        if marks != b"".join(np.uint64(b).tobytes() + mark for b, _, _, mark in parts):
            raise RuntimeError("a block got the ids of other words than it sent")
        lengths = np.concatenate([none, *(from_planes(x[1]) for x in parts)]).astype(np.int64)
        flat = np.concatenate([none, *(from_planes(x[2]) for x in parts)])
        counts, sizes = from_planes(counts), np.frombuffer(sizes, np.int64)
        order = np.argsort(-counts.astype(np.int64), kind="stable").astype(np.int32)
        codes = order[from_planes(ranks)]
        size = lengths[codes]
        ends, sums = np.cumsum(sizes), np.r_[0, np.cumsum(size)]
        ids = flat[spread(size, (np.cumsum(lengths) - lengths)[codes])]
        offsets = np.r_[0, sums[ends]].astype(np.int32)
    values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
    return pa.table({"doc_id": pa.array(np.frombuffer(doc_ids, np.int64), pa.int64(), mask=np.frombuffer(known, np.uint8) == 0), "ids": values})


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) for every row; null and empty texts have no ids.

    Repeated rows and null ids are returned as they come; an empty table gives no rows.
    No special tokens. Other columns are ignored.
    """
    buckets = max(16, n_shuffle(docs.sparkSession), -(-planned_bytes(docs) // RANGE_BYTES))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = rows.mapInArrow(explode_words(pattern, buckets), SENT).repartition(max(n_shuffle(docs.sparkSession), buckets // 4), "route")
    back = sent.groupBy("route").applyInArrow(encode_words(ranks_path, pattern, buckets), BACK)
    return sent.groupBy("route").cogroup(back.groupBy("route")).applyInArrow(reassemble, ENCODED).select(F.col("doc_id").alias(id_col), "ids")


def decode_ids(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns but the ids, and the bytes the ids stand for (a null list stays null).

    Every id is joined with the token-byte table by its rank, in arrays: the table's
    bytes lie end to end, and an unknown id is an error.
    """
    others = [c for c in encoded.columns if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sorted((rank, token) for token, rank in token_bytes(ranks_path).items())
        sizes = np.zeros(table[-1][0] + 1, np.int64)
        sizes[[r for r, _ in table]] = [len(t) for _, t in table]
        data = np.frombuffer(b"".join(t for _, t in table), np.uint8)
        starts = np.cumsum(sizes) - sizes
        for batch in batches:
            many = batch.column(ids_col).value_lengths().fill_null(0).to_numpy().astype(np.int64)
            slices = (np.cumsum(many) - many) // SLICE_IDS
            starts_at = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1]]) if batch.num_rows else []
            for a, b in zip(starts_at, [*starts_at[1:], batch.num_rows]):
                part = batch.slice(a, b - a)
                lists = part.column(ids_col)
                ids = lists.flatten().to_numpy()
                counts = lists.value_lengths().fill_null(0).to_numpy()
                size = sizes[ids]
                if len(ids) and (size == 0).any():
                    raise ValueError("an id that is not in the token-byte table")
                out = data[spread(size, starts[ids])]
                ends, sums = np.cumsum(counts), np.r_[0, np.cumsum(size)]
                offsets = np.r_[0, sums[ends]].astype(np.int32)
                mask = pa.py_buffer(np.packbits(np.asarray(lists.is_valid()), bitorder="little").tobytes())
                decoded = pa.Array.from_buffers(pa.binary(), part.num_rows, [mask, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), decoded], [*others, name])

    kept = encoded.select(*others, ids_col)
    schema = kept.drop(ids_col).schema.add(name, "binary")
    return kept.mapInArrow(run, schema)
