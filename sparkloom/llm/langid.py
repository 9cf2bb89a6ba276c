"""Language identification by bit-sliced Bloom filters of character n-grams.

One table of 2^slot_bits words holds the filters of all languages: bit l of a word
belongs to language l. Looking up an n-gram ANDs the words at its hash places, and
the result has the bits of every language whose filter contains it. For a text,
the lookups are counted by mask; each language's count of n-grams is corrected for
its filter's false positives, and the largest share decides. The model has a fixed
size: the table and a false-positive rate for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, text_slices

SIZES = (2, 3, 4)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    slot_bits: int
    words: np.ndarray  # uint64 masks
    false_rate: np.ndarray  # chance that an n-gram of no language passes, by language


def gram_hashes(column: pa.Array, sizes: tuple[int, ...] = SIZES) -> tuple[list[np.ndarray], np.ndarray]:
    """Per size: a 64-bit hash at every place of the joined, lower-cased texts (0 where the n-gram
    would cross texts or has no letter); and each place's text. Other characters count as blanks."""
    lower = pc.utf8_lower(pc.fill_null(column, ""))
    # each text is framed by blanks so that word beginnings and ends count
    joined = "".join(f" {t} " for t in lower.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = pc.utf8_length(lower).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    owner = np.repeat(np.arange(len(lengths)), lengths)
    letter = letters(points)
    points = np.where(letter, points, np.uint32(0x20)).astype(np.uint64)
    out = []
    for n in sizes:
        h = np.zeros(max(len(points) - n + 1, 0), np.uint64)
        real = np.zeros(len(h), bool)
        for j in range(n):
            h = h * np.uint64(0x1F0001) + points[j : len(h) + j]
            real |= letter[j : len(h) + j]
        inside = owner[: len(h)] == owner[n - 1 : len(h) + n - 1]
        h = np.where(real & inside, mix64(h + np.uint64(n)) | np.uint64(1), np.uint64(0))
        out.append(h)
    return out, owner


_table = np.zeros(0, bool)


def letters(points: np.ndarray) -> np.ndarray:
    """Which code points are letters (general category L)."""
    global _table
    if not len(_table):
        import unicodedata

        _table = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)
    return _table[points]


def slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - bits)).astype(np.int64), ((h >> np.uint64(4)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of every text, counted by language within the task."""
    held: dict[str, list] = {}
    for batch in text_slices(batches):
        names = batch.column("lang").to_pylist()
        grams, owner = gram_hashes(batch.column("text"))
        index = {x: i for i, x in enumerate(dict.fromkeys(names))}
        of = np.array([index[x] for x in names])
        for h in grams:
            at = owner[: len(h)]
            order = np.argsort(h, kind="stable")  # places stay in order, so a text's repeats are neighbours
            h, at = h[order], at[order]
            new = h > 0
            new[1:] &= (h[1:] != h[:-1]) | (at[1:] != at[:-1])
            h, lang = h[new], of[at[new]]
            for name, i in index.items():
                held.setdefault(name, []).append(h[lang == i])
    for name, parts in held.items():
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        for a in range(0, len(h), 100_000):
            m = len(h[a : a + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array([name] * m), pa.array(h[a : a + m].view(np.int64)), pa.array(n[a : a + m], pa.int64())], ["lang", "gram", "n"])


def bounded_sample(docs: DataFrame, most: int, strata: str) -> DataFrame:
    """About `most` rows of each stratum at most, the same rows on every run: by a hash of the id."""
    counts = {r[strata]: r["count"] for r in docs.groupBy(strata).count().collect()}
    share = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1_000_000
    keep = F.lit(False)
    for name, n in counts.items():
        keep = keep | ((F.col(strata) == F.lit(name)) & (share < F.lit(min(1.0, most / max(n, 1)))))
    return docs.filter(keep)


def fit(docs: DataFrame, most_docs: int = 800, slot_bits: int = 20, ratio: float = 0.5) -> Model:
    """A model from docs (doc_id, text, lang); rows with a null lang or text are not used.

    At most about most_docs documents of each language are read (a bounded sample of labelled rows).
    A language's filter holds the n-grams whose share of its documents is at least `ratio` of the
    largest share in any language; the sample bounds their number. At most 63 languages.
    """
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sample = bounded_sample(known, most_docs, "lang")
    totals = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    languages = sorted(totals)
    if len(languages) > 63:
        raise ValueError("more than 63 languages")
    if not languages:
        return Model([], slot_bits, np.zeros(1 << slot_bits, np.uint64), np.zeros(0))
    counted = sample.select("text", "lang").mapInArrow(count_grams, "lang string, gram bigint, n bigint").groupBy("gram").pivot("lang", languages).agg(F.sum("n"))
    shares = [F.coalesce(F.col(f"`{x}`"), F.lit(0)) / totals[x] for x in languages]
    top = F.greatest(*shares, F.lit(0.0))
    counted = cut(counted.select("gram", *[s.alias(f"s{i}") for i, s in enumerate(shares)], top.alias("top")).filter(F.col("top") > 0), "grams")
    words = np.zeros(1 << slot_bits, np.uint64)
    for i, _ in enumerate(languages):
        own = counted.filter(F.col(f"s{i}") >= ratio * F.col("top")).select("gram").toPandas()["gram"].to_numpy()
        for at in slots(own.view(np.uint64), slot_bits):
            np.bitwise_or.at(words, at, np.uint64(1 << i))
    fill = np.array([float(((words >> np.uint64(i)) & np.uint64(1)).mean()) for i in range(len(languages))])
    return Model(languages, slot_bits, words, fill**2)


def scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_lang = len(model.languages)
        for batch in text_slices(batches, most=1 << 20):
            n = batch.num_rows
            grams, owner = gram_hashes(batch.column("text"))
            hits, total = np.zeros((n, n_lang)), np.zeros(n)
            for h in grams:
                real = np.flatnonzero(h)
                own = owner[real]
                a, b = slots(h[real], model.slot_bits)
                mask = model.words[a] & model.words[b]
                total += np.bincount(own, minlength=n)
                for i in range(n_lang):
                    hits[:, i] += np.bincount(own[(mask >> np.uint64(i)) & np.uint64(1) == 1], minlength=n)
            right = np.maximum(hits - model.false_rate * total[:, None], 0) / np.maximum(1 - model.false_rate, 1e-9)
            sums = right.sum(1)
            best = right.argmax(1) if n_lang else np.zeros(n, int)
            score = np.where(sums > 0, right.max(1, initial=0) / np.maximum(sums, 1e-12), 1 / max(n_lang, 1))
            # a text with letters but no known n-gram still gets the first language, at an even score
            empty = (total == 0) | (n_lang == 0)
            names = np.array([*model.languages, "und"], object)[np.where(empty, n_lang, best)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(empty, 0.0, score))], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for every row, over the whole text.

    `und` and 0 where the text is null or has no letter, or the model has no language.
    Equal counts go to the first language by name. Repeated rows are returned as they come;
    an empty table gives no rows; other columns are ignored. The table travels to every task
    and has a fixed size (8 bytes * 2^slot_bits).
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scored(model), "doc_id bigint, lang_pred string, score double").withColumnRenamed("doc_id", id_col)
