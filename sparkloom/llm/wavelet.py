"""Token ids in wavelet-matrix shards: one compressed file per shard.

Documents are put in ascending id order by a range partitioning; each partition
is cut into shards of about `shard_tokens` ids. A shard's file holds the bit-planes of its
wavelet matrix (plane p sorts the ids stably by bit p, most significant first), with
sampled ranks, each plane compressed, and a directory of its documents. `WaveletMatrix`
answers access, rank (count before a place) and select (place of an occurrence)
from those planes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_shuffle, new_path
from .tokens import encoded_slices

MAGIC = b"SLWM0001"
#: Bits between two sampled ranks.
SAMPLE = 4096
SHARD_TOKENS = 1_000_000
SHARDS = "part int, seq int, n_tokens bigint, n_docs bigint, first_doc bigint, last_doc bigint, file binary"
DOCS = "part int, seq int, doc_id bigint, place bigint, at bigint, n_tokens bigint, ids_crc32 bigint"

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class WaveletMatrix:
    """Bit-planes of a sequence of n ids of `bits` bits."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray] | None = None) -> None:
        self.n, self.planes, self.zeros = n, planes, zeros
        self.ranks = ranks or [self._sample(p) for p in planes]

    @staticmethod
    def _sample(plane: np.ndarray) -> np.ndarray:
        """Ones before every SAMPLE-th bit."""
        step = SAMPLE // 8
        padded = np.zeros(-(-len(plane) // step) * step, np.uint8)
        padded[: len(plane)] = _ONES[plane]
        return np.r_[0, np.cumsum(padded.reshape(-1, step).sum(1, dtype=np.int64))].astype(np.uint32)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        bits = bits or max(1, int(ids.max()).bit_length() if len(ids) else 1)
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        spare = np.empty_like(now)
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            bit = (now & now.dtype.type(1 << b)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            n = len(now) - int(np.count_nonzero(bit))
            np.compress(bit, now, out=spare[n:])
            np.compress(np.logical_not(bit, out=bit), now, out=spare[:n])
            now, spare = spare, now
            zeros.append(n)
        return cls(len(ids), planes, zeros)

    def rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // SAMPLE
        a, b = block * (SAMPLE // 8), i // 8
        out = int(self.ranks[plane][block]) + int(_ONES[self.planes[plane][a:b]].sum(dtype=np.int64))
        return out + int(_ONES[self.planes[plane][b] & ((1 << (i % 8)) - 1)]) if i % 8 else out

    def _bit(self, plane: int, i: int) -> int:
        return int(self.planes[plane][i // 8] >> (i % 8)) & 1

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane: samples, then bits of one block."""
        ranks = self.ranks[plane].astype(np.int64)
        if not bit:
            ranks = np.arange(len(ranks)) * SAMPLE - ranks
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        bits = np.unpackbits(self.planes[plane][block * (SAMPLE // 8) : (block + 1) * (SAMPLE // 8)], bitorder="little")
        return block * SAMPLE + int(np.flatnonzero(bits == bit)[k - int(ranks[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(len(self.planes)):
            bit, ones = self._bit(p, i), self.rank1(p, i)
            out = out << 1 | bit
            i = self.zeros[p] + ones if bit else i - ones
        return out

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token among the first i ids."""
        a, b = self._range(token, 0, i)
        return b - a

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        for p in range(len(self.planes)):
            x, y = self.rank1(p, a), self.rank1(p, b)
            a, b = (self.zeros[p] + x, self.zeros[p] + y) if token >> (len(self.planes) - 1 - p) & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of token."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for p in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - p) & 1
            i = self._select(p, bit, i - self.zeros[p] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """The whole sequence: planes are undone from the last to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for p in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[p], count=self.n, bitorder="little").view(bool)
            before = np.empty(self.n, kind)
            before[bit] = now[self.zeros[p] :] | kind(1 << (len(self.planes) - 1 - p))
            before[np.logical_not(bit, out=bit)] = now[: self.zeros[p]]
            now = before
        return now.astype(np.uint32)

    def to_bytes(self, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
        """magic, head length, head (counts, sizes of the parts), then the compressed parts.

        The directory holds ids, whether each is known (a null id is stored as 0, unknown), and lengths.
        """
        press = zstandard.ZstdCompressor(level=1)
        known = np.array([x is not None for x in doc_ids], np.uint8)
        names = np.array([x or 0 for x in doc_ids], "<i8")
        parts = [press.compress(names.tobytes()), press.compress(known.tobytes()), press.compress(lengths.astype("<i8").tobytes())]
        for plane, ranks in zip(self.planes, self.ranks):
            parts += [press.compress(plane.tobytes()), press.compress(ranks.astype("<u4").tobytes())]
        head = struct.pack(f"<QQB{len(self.zeros)}Q{len(parts)}Q", self.n, len(doc_ids), len(self.planes), *self.zeros, *map(len, parts))
        return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])

    @classmethod
    def from_bytes(cls, file: bytes) -> tuple[WaveletMatrix, pa.Array, np.ndarray]:
        """The matrix, and the ids (nulls where unknown) and lengths of its documents."""
        if file[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack_from("<I", file, 8)
        n, _, bits = struct.unpack_from("<QQB", file, 12)
        numbers = struct.unpack_from(f"<{3 * bits + 3}Q", file, 12 + 17)
        zeros, sizes = list(numbers[:bits]), numbers[bits:]
        parts, at, plain = [], 12 + size, zstandard.ZstdDecompressor()
        for length in sizes:
            parts.append(plain.decompress(file[at : at + length]))
            at += length
        doc_ids = pa.array(np.frombuffer(parts[0], "<i8"), pa.int64(), mask=np.frombuffer(parts[1], np.uint8) == 0)
        planes = [np.frombuffer(x, np.uint8) for x in parts[3::2]]
        ranks = [np.frombuffer(x, "<u4") for x in parts[4::2]]
        return cls(n, planes, zeros, ranks), doc_ids, np.frombuffer(parts[2], "<i8")


def write_slices(tokenizer: str, end_id: int, shard_tokens: int, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, sizes, held, waiting, seq, part = [], [], [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            nonlocal seq, waiting
            ids, lengths, names = np.concatenate(held), np.concatenate(sizes), list(docs)
            file = WaveletMatrix.build(ids, bits).to_bytes(names, lengths)
            row = (part, seq, len(ids), len(names), names[0], names[-1], file)
            for x in (docs, sizes, held):
                x.clear()
            seq, waiting = seq + 1, 0
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["part", "seq", "n_tokens", "n_docs", "first_doc", "last_doc", "file"])

        for batch, ids, counts in encoded_slices(batches, tokenizer):
            part = batch.column("part")[0].as_py()
            ends = np.cumsum(counts + 1)
            out = np.full(int(ends[-1]), end_id, np.uint32)
            inside = np.ones(len(out), bool)
            inside[ends - 1] = False
            out[inside] = ids
            docs += batch.column("doc_id").to_pylist()
            sizes.append(counts + 1)
            held.append(out)
            waiting += len(out)
            if waiting >= shard_tokens:
                yield shard()
        if held:
            yield shard()

    return run


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int, shard_tokens: int = SHARD_TOKENS, bits: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write one file per shard below path, documents in ascending id order, end_id after each.

    A null text counts as empty (its only id is end_id). Rows with a null id come first, in any order;
    repeated ids lie next to each other. A document is never cut: a shard ends with the slice of
    documents that fills it. bits must hold the largest id. An empty table writes no shards.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    placed = rows.repartitionByRange(n_shuffle(spark), "doc_id").sortWithinPartitions("doc_id").select("doc_id", "text", F.spark_partition_id().alias("part"))
    shards = placed.mapInArrow(write_slices(tokenizer, end_id, shard_tokens, bits), SHARDS)
    shards.write.option("maxRecordsPerFile", 1).option("compression", "uncompressed").parquet(path)


def read_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, file in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "file"))):
            matrix, names, lengths = WaveletMatrix.from_bytes(file)
            ids = matrix.ids().astype("<u4")
            at = np.cumsum(lengths) - lengths
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), lengths.tolist())]
            n = len(names)
            columns = ((np.full(n, part), pa.int32()), (np.full(n, seq), pa.int32()), (names, pa.int64()), (np.arange(n), pa.int64()), (at, pa.int64()), (lengths, pa.int64()), (crc, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["part", "seq", "doc_id", "place", "at", "n_tokens", "ids_crc32"])


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, seq, base: ids before each shard. Sums of partitions are ordered on the driver (one number for each
    partition of the writing job), shards within their partition by a window."""
    spark: SparkSession = shards.sparkSession
    sums = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, total = [], 0
    for part, n in sums:
        before.append((part, total))
        total += n
    starts = spark.createDataFrame(before, "part int, before bigint")
    order = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n_tokens").over(order), F.lit(0))
    return shards.select("part", "seq", inside.alias("inside")).join(F.broadcast(starts), "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("base"))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files below path."""
    shards = spark.read.schema(SHARDS).parquet(path)
    found = shards.select("part", "seq", "file").mapInArrow(read_slices, DOCS)
    return found.join(shard_starts(shards.drop("file")), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """Occurrences of each asked token in every shard, by rank on the planes: token, part, seq, n.

    Shards without the token, tokens that no shard can hold and an empty list give no rows; a token asked twice is answered twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, file in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "file"))):
                matrix = WaveletMatrix.from_bytes(file)[0]
                rows = [(t, part, seq, matrix.count(t)) for t in tokens]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["token", "part", "seq", "n"])

    shards = spark.read.schema(SHARDS).parquet(path)
    return shards.select("part", "seq", "file").mapInArrow(run, "token bigint, part int, seq int, n bigint").filter("n > 0")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, name: str = "shards") -> DataFrame:
    """Write all documents to shards in the shared folder and read them back."""
    path = new_path(docs.sparkSession, name)
    write_shards(docs, tokenizer, path, end_id)
    return read_shards(docs.sparkSession, path)
