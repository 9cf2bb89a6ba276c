"""Shared helpers: reliable intermediate tables and vectorised word handling."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Texts are handled in slices of about this many bytes inside a task.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where it is unset on a local master (tests on one machine), a temporary folder is set once; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*frames: DataFrame) -> None:
    """Delete tables that cut() wrote; only for frames nothing will read again."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def planned_bytes(df: DataFrame) -> int:
    """The bytes of df as the optimizer estimates them from its files; 0 where it has no estimate."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def give_back() -> None:
    """Return freed memory to the system: Python workers are reused, and idle ones would hold it through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has about `most` bytes of text, or one row; at the end, memory is given back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // most
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)
    batch = None
    give_back()


def plain(column: pa.Array) -> pa.Array:
    """A string column without nulls and with 32-bit offsets that start at 0."""
    out = pc.fill_null(column.cast(pa.string()), "")
    return pa.concat_arrays([out]) if out.offset == 0 else pa.array(out.to_pylist(), pa.string()) if len(out) < 64 else pc.take(out, pa.array(np.arange(len(out))))


def words_of(column: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of every text, flat, and the number in each text."""
    texts = pc.fill_null(column, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    keep = pc.greater(pc.binary_length(flat), 0)
    ends = np.cumsum(counts)
    kept = np.r_[0, np.cumsum(keep.to_numpy(zero_copy_only=False))]
    counts = kept[ends] - kept[ends - counts]
    return flat.filter(keep), counts


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (multiply and xor-shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word; each distinct word is hashed once."""
    import xxhash

    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return hashed[coded.indices.to_numpy()]


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each text, flat, and the text of each.

    A text with fewer words than n has one shingle, its whole sequence (told
    apart by length); a text without words has none. Windows never cross texts.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    made = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    owner = np.repeat(np.arange(len(counts)), made)
    first = np.cumsum(made) - made
    at = np.arange(int(made.sum())) - first[owner] + starts[owner]
    room = np.minimum(counts, n)[owner]
    padded = np.r_[hashes, np.zeros(n, np.uint64)]
    out = room.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    short = room < n
    for j in range(n):
        w = padded[at + j]
        if j and short.any():
            w = np.where(room > j, w, np.uint64(0))
        out = mix64(out * np.uint64(3) + w)
    return out, owner
