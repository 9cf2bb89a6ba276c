"""Deduplication, quotas, deterministic samples and splits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def with_fold(df: DataFrame, key: list[str], fold: Column, into: str) -> DataFrame:
    """df with an aggregate of each row's group. Groups are folded inside tasks before they are sent, and rows meet their group's value in a join, so no task
    sorts a group that holds very many rows; nulls are a group like others."""
    found = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(fold.alias(into))
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(found, same).drop(*[f"_k{i}" for i in range(len(key))])


def is_first(df: DataFrame, key: list[str], order: list[str], into: str) -> DataFrame:
    """df with a boolean: the row is its group's first by order; of rows equal in group and order one is."""
    tie = F.row_number().over(Window.partitionBy(*key, *order).orderBy(*order))
    folded = with_fold(df, key, F.min(F.struct(*order)), "_first")
    return folded.withColumn(into, (F.struct(*order) == F.col("_first")) & (tie == 1)).drop("_first")


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the later ones with a reason."""
    n = is_first(df, key, order, "_is")
    return n.filter("_is").drop("_is"), n.filter("NOT _is").drop("_is").withColumn("reason", F.lit("DUPLICATE"))


def marked_conflicts(df: DataFrame, target: list[str], value: str, order: list[str]) -> DataFrame:
    """duplicate: an earlier row has the same target and value; conflict: the target's first row has another value."""
    same = is_first(df, [*target, value], order, "_is")
    first = with_fold(same, target, F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order)), "_of")
    return first.withColumn("duplicate", ~F.col("_is")).withColumn("conflict", ~F.col("_of.v").eqNullSafe(F.col(value))).drop("_is", "_of")


def conflict_counts(df: DataFrame, target: list[str], value: str, order: list[str]) -> DataFrame:
    """One row: rows (n), and how many marked_conflicts would mark as duplicate (n_duplicate) and conflict (n_conflict), from folds alone."""
    alike = df.groupBy(*target, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_o"))
    of = alike.groupBy(*target).agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_values"), F.min_by("_n", "_o").alias("_same"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return of.agg(total("_all").alias("n"), total(F.col("_all") - F.col("_values")).alias("n_duplicate"), total(F.col("_all") - F.col("_same")).alias("n_conflict"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def hash_ranks(df: DataFrame, partition: list[str], key: str, out: str, hashed: Column | None = None) -> DataFrame:
    """df with `out`: the place (from 1) of a row in its partition by SHA-256 of the key, then the key.

    Places are counts of 4,096 hash prefixes plus the place inside one prefix, so no task sorts a whole partition.
    """
    marked = df.withColumn("_h", F.sha2(F.col(key).cast("string"), 256) if hashed is None else hashed).withColumn("_p", F.substring("_h", 1, 3))
    sizes = marked.groupBy(*partition, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*partition).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(c).alias(f"_of{i}") for i, c in enumerate(partition)], F.col("_p").alias("_ofp"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = marked.withColumn("_rn", F.row_number().over(Window.partitionBy(*partition, "_p").orderBy("_h", key)))
    same = F.col("_p") == F.col("_ofp")
    for i, c in enumerate(partition):
        same = same & F.col(c).eqNullSafe(F.col(f"_of{i}"))
    return placed.join(offsets, same).withColumn(out, (F.col("_rn") + F.col("_before")).cast("int")).select(*df.columns, out)


def hash_sample(df: DataFrame, stratum: str, key: str, share: float, exclude: DataFrame | None = None) -> DataFrame:
    """Per stratum the first max(1, ceil(share * n)) rows by SHA-256 of the key, then the key; the same for any input order."""
    pool = df if exclude is None else df.join(exclude.select(key).distinct(), key, "left_anti")
    sizes = pool.groupBy(F.col(stratum).alias("_stratum")).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * F.lit(share))).alias("_most"))
    ranked = hash_ranks(pool, [stratum], key, "_place")
    return ranked.join(sizes, F.col(stratum).eqNullSafe(F.col("_stratum"))).filter("_place <= _most").select(*df.columns)


def round_robin(df: DataFrame, strata: list[str], key: str, limit: int) -> DataFrame:
    """One row of each stratum in turn by SHA-256 of the key, strata in order, until limit; a row carries its sweep."""
    return hash_ranks(df, strata, key, "sweep").orderBy("sweep", *strata).limit(limit)


def group_split(df: DataFrame, group: str, seed: str = "42") -> DataFrame:
    """Rows with split train, val or test; a group is in one split: about 80/10/10 with at least one where groups allow.

    Groups are shuffled by a hash. Ranks come from counts of hash buckets, so the list of groups is never
    sorted in one task.
    """
    groups = df.filter(F.col(group).isNotNull()).select(group).distinct().withColumn("_h", F.sha2(F.concat_ws("|", F.lit(seed), F.col(group).cast("string")), 256))
    groups = groups.withColumn("_bucket", F.substring("_h", 1, 2))
    sizes = groups.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))  # at most 256 rows
    before = sizes.select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    ranked = groups.withColumn("_rn", F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", group))).join(F.broadcast(before), "_bucket").withColumn("_rank", F.col("_rn") + F.col("_before"))
    n = F.col("_all")
    test = F.when(n < 2, 0).otherwise(F.greatest(F.lit(1), F.floor(n * 0.1)))
    val = F.when(n < 3, 0).otherwise(F.greatest(F.lit(1), F.floor(n * 0.1)))
    split = F.when(F.col("_rank") <= n - test - val, "train").when(F.col("_rank") <= n - test, "val").otherwise("test")
    return df.join(ranked.select(group, split.alias("split")), group)


def quota_select(df: DataFrame, entity: str, task: str, capability: str, order: list[str], most: int = 8, per_task: int = 2, per_capability: int = 1) -> DataFrame:
    """Greedy selection per entity in `order` under three quotas; refused rows use none.

    Capabilities lie inside tasks and tasks inside entities, so a refused row could only have used up a quota that
    stays closed anyway, and the greedy choice is three rankings, innermost first. All three windows
    share one exchange on the entity.
    """
    out = df.repartition(entity)
    for keys, quota in (([entity, task, capability], per_capability), ([entity, task], per_task), ([entity], most)):
        out = out.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= quota).drop("_rn")
    return out


def greedy_distinct(df: DataFrame, entity: str, order: list[str], text: str, least: float = 0.92) -> DataFrame:
    """accepted: no earlier accepted row of the entity has a token Jaccard index of `least` or more.

    A task reads its entities' rows in order as a stream and keeps the accepted word sets of the present one only. Sets of one size are
    held together, and only sizes that can reach `least` are compared.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, kept = object(), {}
        for pdf in frames:
            marks = []
            for key, value in zip(pdf[entity], pdf[text]):
                if key != of:
                    of, kept = key, {}
                words = frozenset((value or "").split())
                n = len(words)
                near = [k for size in kept if min(n, size) >= least * max(n, size) for k in kept[size]]
                close = any((len(words & k) / len(words | k) if words | k else 1.0) >= least for k in near)
                marks.append(not close)
                if not close:
                    kept.setdefault(n, []).append(words)
            yield pdf.assign(accepted=marks)

    ordered = df.repartition(entity).sortWithinPartitions(entity, *order)
    return ordered.mapInPandas(run, StructType([*df.schema.fields, StructField("accepted", BooleanType())]))


def repeated_template(text: str, least: int = 8) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(text)) >= least


def model_calls(df: DataFrame, client, schema: str, batch: int = 64) -> DataFrame:
    """Each partition's rows go to client(list of dicts) -> list of dicts in batches; a failed batch gives rows with `error`.

    The client is injected: retries, limits and prices are its own, and it must give the same reply for the same row.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = pdf.to_dict("records")
            for a in range(0, len(rows), batch):
                part = rows[a : a + batch]
                try:
                    out = client(part)
                except Exception as failure:  # noqa: BLE001  a failure is a row, not the end of the job
                    out = [r | {"error": str(failure)} for r in part]
                yield pd.DataFrame(out)

    return df.mapInPandas(run, schema)
