"""Exact deduplication by a tree-merge of sorted digest runs. DataFrame functions only.

Every row belongs to one of `runs` runs by a hash of its id, so copies of one
text, however many, are spread over all runs. Inside a run the copies of a digest
are folded to one entry (with a map-side combine before the exchange), and the
entries are written sorted by digest range, run and digest. In each round of the
tree `fan_in` neighbouring runs meet (a binomial tree for 2; 4 here, so 64 runs
take three rounds): they are exchanged on (digest range, run group), merged in
the order of their digests, and equal neighbours, at most one of each run, are
folded over that order: the surviving identifier is kept and counts add up. Lengths
and second hashes are part of the order, so only verified copies are neighbours. After
ceil(log_fan_in(runs)) rounds each digest range holds one run. The result goes
back down to the (run, digest) entries of the first level and from there to the
rows, so no join meets more than a run's share of a hot text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_shuffle


def normalised(text: Column, how: str = "none") -> Column:
    """Null counts as empty. how: none, or words (ASCII lower case, blanks collapsed)."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    if how == "none":
        return out
    if how == "words":
        low = F.translate(out, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return F.regexp_replace(F.regexp_replace(low, r"[\x20\x09-\x0D]+", " "), "^ | $", "")
    raise ValueError(how)


def digest_runs(docs: DataFrame, how: str = "none", runs: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: _id, _run, digest, second hash and length of its text."""
    text = normalised(F.col(text_col), how)
    return docs.select(
        F.col(id_col).alias("_id"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(runs)).cast("int").alias("_run"),
        F.unhex(F.sha2(text, 256)).alias("_digest"),
        F.xxhash64(text).alias("_second"),
        F.octet_length(text).alias("_bytes"),
    )


#: What makes two entries one text: the digest only counts together with length and second hash.
ENTRY = ("_digest", "_second", "_bytes")


def sorted_runs(rows: DataFrame, ranges: int, keep: str) -> DataFrame:
    """One entry per run and text, each run in the order of its digest ranges and digests."""
    best = F.max if keep == "largest" else F.min
    first = rows.groupBy("_run", *ENTRY).agg(best("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    first = first.withColumn("_range", F.pmod(F.conv(F.substring(F.hex("_digest"), 1, 8), 16, 10).cast("bigint"), F.lit(ranges)).cast("int"))
    return first.sortWithinPartitions("_range", "_run", *ENTRY)


def merge_level(runs: DataFrame, fan_in: int, keep: str) -> DataFrame:
    """Exchange groups of fan_in runs, merge each group in digest order and fold equal neighbours.

    A text has at most one entry in a run, so a fold meets fan_in entries at most; the order brings the survivor first.
    """
    survivor = F.col("_keep").desc_nulls_last() if keep == "largest" else F.col("_keep").asc_nulls_last()
    met = runs.withColumn("_run", F.floor(F.col("_run") / fan_in).cast("int")).repartition(n_shuffle(runs.sparkSession), "_range", "_run")
    neighbours = Window.partitionBy("_range", "_run", *ENTRY)
    merged = met.withColumn("_place", F.row_number().over(neighbours.orderBy(survivor))).withColumn("_n", F.sum("_n").over(neighbours))
    return merged.filter("_place = 1").drop("_place")


def exact_dedup(docs: DataFrame, keep: str = "largest", how: str = "none", runs: int = 64, fan_in: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every input row.

    keep: largest or smallest id of each group. Null texts count as empty texts and
    are equal to them. Repeated rows (same id and text) are all returned and all
    counted; those with the winning id are all kept. A null id never wins over another, and
    its rows are kept, since nothing names them. An empty table gives no rows. Other columns of docs,
    whatever their names, are ignored.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(keep)
    rows = cut(digest_runs(docs, how, runs, id_col, text_col), "digests")
    first = cut(sorted_runs(rows, n_shuffle(docs.sparkSession) * 8, keep), "runs")
    level, left = first, runs
    while left > 1:
        level = merge_level(level, fan_in, keep)
        left = -(-left // fan_in)
    winners = level.select(*ENTRY, F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"))
    # down again: first-level entries learn the result, then the rows of each run do
    shared = winners.filter("group_size > 1")
    entries = first.select("_run", *ENTRY).join(shared, list(ENTRY))
    out = rows.join(entries, ["_run", *ENTRY], "left")
    size = F.coalesce("group_size", F.lit(1)).cast("bigint")
    keep_id = F.when(size > 1, F.col("keep_id")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        size.alias("group_size"),
        (F.col("_id").isNull() | F.coalesce(F.col("_id") == keep_id, F.lit(False))).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "largest", how: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay; all columns unchanged.

    The verdict is on id and text together: where one id comes with several texts, only its lost copies leave.
    """
    gone = exact_dedup(docs, keep, how, id_col=id_col, text_col=text_col).filter("not kept").select(F.col(id_col).alias("_gone_id"), F.col("text_sha256").alias("_gone_text")).distinct()
    same = (docs[id_col] == gone["_gone_id"]) & (F.sha2(normalised(docs[text_col], how), 256) == gone["_gone_text"])
    return docs.join(gone, same, "left_anti")
