"""Score blocks, quantile bands, rank statistics and intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp


def rounded_ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 6)


def score_block(score: Column, judged: Column) -> list[Column]:
    """count, failed, strict and relaxed means over judged rows (null without any), rounded to 6."""
    ok = judged & score.isNotNull()
    return [
        F.count_if(ok).alias("count"),
        F.count_if(~ok).alias("failed"),
        F.round(F.avg(F.when(ok, (score == 1.0).cast("double"))), 6).alias("strict"),
        F.round(F.avg(F.when(ok, score)), 6).alias("relaxed"),
    ]


def score_report(df: DataFrame, task: str, score: str, judged: str) -> DataFrame:
    """A row per task, then `micro` over all rows and `macro`, the plain mean of tasks with judged rows."""
    tasks = df.groupBy(F.col(task).alias("block")).agg(*score_block(F.col(score), F.col(judged)))
    micro = df.agg(*score_block(F.col(score), F.col(judged))).select(F.lit("micro").alias("block"), "*")
    used = tasks.filter(F.col("count") > 0)
    macro = used.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.round(F.avg("strict"), 6).alias("strict"), F.round(F.avg("relaxed"), 6).alias("relaxed")).select(F.lit("macro").alias("block"), "*")
    return tasks.unionByName(micro).unionByName(macro)


def ranked_values(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Distinct values of each group with `_n` (rows) and `_before` (rows with a smaller value), and `_total`.

    Values are dealt over buckets that keep their order: a bucket follows from the value and the group's exact bounds, finer towards the
    smallest, so it is the same in every run. Windows run over the counts of a group's buckets (at most 1,281) and over the values of one bucket.
    """
    keys = [F.col(c) for c in group]
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    bounds = counts.groupBy(*group).agg(F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high"), F.sum("_n").alias("_total"))
    spread = F.try_divide(F.col(value).cast("double") - F.col("_low"), F.col("_high") - F.col("_low"))
    bucket = F.floor(64 * F.log2(1 + F.coalesce(spread, F.lit(0.0)) * (1 << 20))).cast("int")
    dealt = (counts.join(bounds, group) if group else counts.join(F.broadcast(bounds))).withColumn("_bucket", F.coalesce(bucket, F.lit(0))).drop("_low", "_high")
    earlier = Window.partitionBy(*keys, F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*group, "_bucket").agg(F.sum("_n").alias("_sum")).select(*group, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(offsets, [*group, "_bucket"])
    return ranked.withColumn("_before", F.col("_inside") + F.col("_offset")).drop("_bucket", "_inside", "_offset")


def group_quantiles(df: DataFrame, group: list[str], value: str, points: list[float], names: list[str]) -> DataFrame:
    """group and exact quantiles with linear interpolation; null for no values. One pass over ranked distinct values picks two of them for each point."""
    ranked = ranked_values(df, group, value)

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("_before") <= index) & (index < F.col("_before") + F.col("_n")), F.col(value).cast("double")))

    picked, last = [], F.col("_total") - 1
    for i, p in enumerate(points):
        picked += [at(F.floor(last * p)).alias(f"_a{i}"), at(F.ceil(last * p)).alias(f"_b{i}"), F.max(last * p - F.floor(last * p)).alias(f"_f{i}")]
    out = ranked.groupBy(*group).agg(*picked)
    return out.select(*group, *[(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")).alias(n) for i, n in enumerate(names)])


def quantiles(df: DataFrame, column: str, points: list[float], names: list[str]) -> DataFrame:
    """One row of exact quantiles with linear interpolation; null for no values."""
    return group_quantiles(df, [], column, points, names)


def with_global(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row with the columns of a one-row frame."""
    return df.join(F.broadcast(one_row.limit(1)))


def tie_ranks(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """1-based ranks within groups with ties averaged: rows join their value's rank, no window runs over rows or over all values of a group."""
    ranked = ranked_values(df, group, value).select(*group, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranked, [*group, value], "left")


def pearson(x: str, y: str, least: int = 3) -> Column:
    """Null with fewer than `least` pairs or without variance; exact means of sums, no division error."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(F.count(a) >= least, F.when(spread > 0, F.try_divide(F.covar_pop(a, b), spread)))


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """group, n and rho over pairwise complete rows, rounded to 6."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, x, y)
    ranked = tie_ranks(tie_ranks(both, group, x, "_rx"), group, y, "_ry")
    return ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.round(pearson("_rx", "_ry"), 6).alias("rho"))


def roc_auc(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """Rank-sum area under the curve; null if a class is absent."""
    ranked = tie_ranks(df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()), group, score, "_r")
    p, n = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    area = F.try_divide(F.sum(F.when(F.col(label) == 1, F.col("_r"))) - p * (p + 1) / 2, (p * n).cast("double"))
    return ranked.groupBy(*group).agg(p.alias("n_positive"), n.alias("n_negative"), F.round(area, 6).alias("auc"))


def macro_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: labels and the mean F1 over the union of labels; 0/0 counts as 0."""
    pairs = df.select(F.explode(F.array_distinct(F.array(truth, predicted))).alias("label"), truth, predicted).filter("label IS NOT NULL")
    hit = (F.col(truth).eqNullSafe(F.col("label"))), (F.col(predicted).eqNullSafe(F.col("label")))
    counts = pairs.groupBy("label").agg(F.count_if(hit[0] & hit[1]).alias("tp"), F.count_if(~hit[0] & hit[1]).alias("fp"), F.count_if(hit[0] & ~hit[1]).alias("fn"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return counts.agg(F.count(F.lit(1)).alias("n_labels"), F.round(F.avg(f1), 6).alias("macro_f1"))


def brier(probability: Column, label: Column) -> Column:
    return F.round(F.avg(F.pow(clamp(probability) - label, F.lit(2.0))), 6)


def tertile_thresholds(long: DataFrame, metric: str, value: str) -> DataFrame:
    """metric, q33, q67 of log1p values."""
    logged = long.withColumn("_log", F.when(F.col(value) > -1, F.log1p(F.col(value))))
    return long.select(metric).distinct().join(group_quantiles(logged, [metric], "_log", [1 / 3, 2 / 3], ["q33", "q67"]), metric, "left")


#: Distinct values of a group that are resampled together.
CHUNK_VALUES = 4096
#: Up to so many rows a value, rows are drawn one by one; beyond, how often each value is drawn.
ROWS_A_VALUE = 16


def value_histogram(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, value, n: how often each value occurs in its group; null and NaN values are left out."""
    v = F.col(value).cast("double")
    return df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*group, v.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def resampled_sums(values: np.ndarray, n: np.ndarray, path: list[int], seed: int, chunk: int, resamples: int) -> list[float]:
    """What a chunk of a histogram adds to each resample's sum. path: the rows below each node of the tree from the root to the chunk."""
    rows, depth = np.full(resamples, path[0], dtype=np.int64), len(path) - 1
    for level in range(1, depth + 1):
        node = chunk >> (depth - level)
        all_, own = int(path[level - 1]), int(path[level])
        right = bool(node & 1)
        left = np.random.default_rng([seed, level, node >> 1]).binomial(rows, (all_ - own if right else own) / all_)
        rows = rows - left if right else left
    inside, total = np.random.default_rng([seed, chunk]), int(n.sum())
    if total <= ROWS_A_VALUE * len(values):
        each = np.repeat(values, n)
        return [float(each.take(inside.integers(0, total, r, dtype=np.uint32)).sum()) for r in rows]
    return [float(inside.multinomial(r, n / total) @ values) for r in rows]


def bootstrap_interval(df: DataFrame, group: list[str], value: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """group, n, mean, low, high: a percentile interval of the mean by resampling with replacement.

    A resample of n rows is a multinomial draw over the histogram of values. The values of a group are dealt over 2 ** depth chunks of about CHUNK_VALUES, the
    leaves of a tree: the rows of a resample are halved down the tree by binomial draws (a chunk repeats the draws of the nodes above it, from the same
    generators, so it needs no other chunk), then drawn inside the chunk; sums of chunks add up to the resample. Bounds are the values at index
    floor((B - 1) * 0.025) and floor((B - 1) * 0.975) of the sorted means. Draws follow from the seed and the group's values only. Groups without values give no rows.
    """
    group_key = F.xxhash64(F.lit(seed), *[F.coalesce(F.col(g).cast("string"), F.lit("\0")) for g in group])
    counts = value_histogram(df, group, value).withColumn("_key", group_key)
    depth = F.ceil(F.log2(F.greatest(F.count(F.lit(1)) / CHUNK_VALUES, F.lit(1.0)))).cast("int")
    sizes = counts.groupBy(*group, "_key").agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.col("value")).alias("_sum"), depth.alias("_depth"))
    dealt = counts.select("_key", "value", "n").join(sizes.select("_key", "_depth"), "_key").withColumn("_chunk", F.xxhash64("value").bitwiseAND(F.expr("shiftleft(1L, _depth) - 1")))
    chunks = dealt.groupBy("_key", "_chunk", "_depth").agg(F.sum("n").alias("m"))
    above = chunks.withColumn("_level", F.explode(F.sequence(F.lit(0), "_depth"))).withColumn("_node", F.expr("shiftright(_chunk, _depth - _level)"))
    nodes = above.groupBy("_key", "_level", "_node").agg(F.sum("m").alias("rows"))
    paths = above.join(nodes, ["_key", "_level", "_node"]).groupBy(F.col("_key").alias("_of"), F.col("_chunk").alias("_leaf")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_level", "rows"))), lambda x: x["rows"]).alias("path"))

    def draw(key: tuple, pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        sums = resampled_sums(pdf["value"].to_numpy(float), pdf["n"].to_numpy(), above["path"].iloc[0], int(key[0]) & (2**63 - 1), int(key[1]), resamples)
        return pd.DataFrame({"_key": [key[0]], "sums": [sums]})

    drawn = dealt.select("_key", "_chunk", "value", "n").groupBy("_key", "_chunk").cogroup(paths.groupBy("_of", "_leaf")).applyInPandas(draw, "_key bigint, sums array<double>")
    totals = drawn.select("_key", F.posexplode("sums").alias("_b", "_s")).groupBy("_key", "_b").agg(F.sum("_s").alias("_s"))
    ordered = totals.groupBy("_key").agg(F.array_sort(F.collect_list("_s")).alias("_ss"))  # as many as resamples
    at = lambda p: F.round(F.get("_ss", F.floor((F.size("_ss") - 1) * p).cast("int")) / F.col("_n"), 6)
    return sizes.join(ordered, "_key").select(*group, F.col("_n").alias("n"), F.round(F.col("_sum") / F.col("_n"), 6).alias("mean"), at(0.025).alias("low"), at(0.975).alias("high"))
