"""Quality rules as a bitmask ledger. DataFrame functions only.

`ledger` evaluates every rule once and stores, for each document, the
measurements and one integer whose bit b is set when rule b fails. A policy is a
named, versioned set of rules, i.e. a mask: `failures & mask = 0` keeps the
document. Changing or ablating a policy needs the ledger only, never the texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """bit: place in the mask, never reused; fails: SQL over the measurements, integer arithmetic."""

    bit: int
    name: str
    fails: str


#: Rules over the measurements. Integer arithmetic throughout, so every engine agrees.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "50 * n_symbols > n_chars"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 25 * n_words"),
    Rule(6, "no_text", "n_words = 0"),
)

#: (policy, version) -> names of the rules that reject. A version never changes once used.
POLICIES = {
    ("base", 1): ("few_words", "repeated_windows"),
    ("web", 1): ("few_words", "repeated_windows", "symbols"),
    ("web", 2): ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "no_text"),
}


def mask_of(policy: tuple[str, int], without: tuple[str, ...] = ()) -> int:
    bits = {r.name: r.bit for r in RULES}
    return reduce(lambda m, name: m | (1 << bits[name]), (n for n in POLICIES[policy] if n not in without), 0)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements of every document; one pass over the text, no shuffle.

    The number of words in repeated windows is exact: a document whose window hashes are
    all different has none; the others are settled by comparing the windows themselves.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    a = docs.select(F.col(id_col).alias(id_col), text.alias("_t"))
    a = a.select(
        id_col,
        F.length("_t").cast("bigint").alias("n_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.array_remove(F.split("_t", BLANKS), "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)).alias("_l"),
    )
    a = a.select(
        id_col, "n_chars", "n_symbols", "_w",
        F.size("_w").alias("_n"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.size("_l").cast("bigint").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
    )
    windows = F.sequence(F.lit(1), F.col("_n") - (WINDOW - 1))
    a = a.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    at = lambda i, j: F.get("_h", i + (j - 1))
    a = a.withColumn("_g", F.when(F.col("_n") > WINDOW, F.transform(windows, lambda i: F.xxhash64(*[at(i, j) for j in range(WINDOW)]))))
    a = a.withColumn("_again", F.coalesce(F.size("_g") > F.size(F.array_distinct("_g")), F.lit(False)))
    # only for documents with a repeated hash: (hash, place) in order of the hash; equal neighbours are compared word by word
    a = a.withColumn("_s", F.when(F.col("_again"), F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))))
    words_at = lambda x: F.slice("_w", x["i"], WINDOW)
    equal = lambda x, y: F.coalesce((x["h"] == y["h"]) & (words_at(x) == words_at(y)), F.lit(False))
    twice = lambda x, k: equal(x, F.get("_s", k - 1)) | equal(x, F.get("_s", k + 1))
    a = a.withColumn("_p", F.when(F.col("_again"), F.sort_array(F.transform(F.filter("_s", twice), lambda x: x["i"]))))
    covered = F.aggregate(
        F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"), lambda s, x: s + x,
    )
    return a.select(
        id_col, "n_chars", F.col("_n").cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.when(F.col("_again"), covered).otherwise(F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def failure_bits() -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES)).cast("bigint")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and `failures`, one row per input row.

    A null or empty text has no words and fails `few_words` and `no_text`. Repeated
    rows give repeated entries; an empty table gives none. Other columns are ignored.
    """
    return measured(docs, id_col, text_col).withColumn("failures", failure_bits())


def apply_policy(entries: DataFrame, policy: tuple[str, int] = ("web", 2), name: str = "kept") -> DataFrame:
    return entries.withColumn(name, F.col("failures").bitwiseAND(F.lit(mask_of(policy))) == 0)


def keep_passing(docs: DataFrame, policy: tuple[str, int] = ("web", 2), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that pass the policy; all columns unchanged, no shuffle (the row travels with its measurements)."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"))
    judged = apply_policy(ledger(whole, "_row", "_text"), policy, "_kept")
    # the place number is not deterministic, so the filter that uses it stays above and the rules are not copied into the scan's filter
    return judged.select("_row", "_kept", F.monotonically_increasing_id().alias("_place")).filter("_kept AND _place >= 0").select("_row.*")


def ablations(entries: DataFrame, policy: tuple[str, int] = ("web", 2)) -> DataFrame:
    """For each rule of the policy: documents that fail it, that only it rejects, and kept without it.

    One pass of conditional counts over the ledger and bitwise totals; the result has a row per rule.
    """
    names, full = POLICIES[policy], mask_of(policy)
    bits = {r.name: 1 << r.bit for r in RULES}
    failed = F.col("failures").bitwiseAND(F.lit(full))
    sums = entries.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.bit_or(failed), F.lit(0)).alias("any_failed"),
        F.coalesce(F.bit_and(failed), F.lit(0)).alias("all_failed"),
        F.array(*[F.struct(F.lit(n).alias("rule"), F.count_if(failed.bitwiseAND(F.lit(bits[n])) != 0).alias("n_failed"), F.count_if(failed == bits[n]).alias("n_only"), F.count_if(failed.bitwiseAND(F.lit(full & ~bits[n])) == 0).alias("n_kept_without")) for n in names]).alias("r"),
    )
    return sums.select("n_docs", "any_failed", "all_failed", F.inline("r"))
