"""Key-based enrichment, reference closure and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key that is not blank: the last by order."""
    kept = df.filter(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
    return kept.groupBy(key).agg(F.max_by(F.struct(*kept.columns), order).alias("_row")).select("_row.*")


def unique_or_raise(df: DataFrame, key: str) -> DataFrame:
    """df, with an error at run time for the second row of a key."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string")))).otherwise(F.lit(True))).drop("_n")


def scored_or_missing(gold: DataFrame, predictions: DataFrame, key: str, score: str) -> DataFrame:
    """Every gold row with its score; rows without a prediction score 0 and are marked; other predictions are ignored."""
    found = predictions.select(key, F.col(score).alias(score), F.lit(True).alias("_found"))
    return gold.join(found, key, "left").withColumn("missing", F.col("_found").isNull()).withColumn(score, F.when(F.col("missing"), F.lit(0.0)).otherwise(F.col(score))).drop("_found")


def ordered_members(df: DataFrame, ids: str, members: DataFrame, member_id: str, fields: list[str], into: str, key: str, strict: bool = False) -> DataFrame:
    """key and an array of the referenced members in reference order; unresolved references fall out, or are an error at run time if strict."""
    refs = df.select(key, F.posexplode(ids).alias("_pos", "_ref"))
    found = refs.join(members.select(F.col(member_id).alias("_ref"), F.struct(*fields).alias("_row")), "_ref", "left" if strict else "inner")
    if strict:
        found = found.withColumn("_row", F.when(F.col("_row").isNotNull(), F.col("_row")).otherwise(F.raise_error(F.concat(F.lit("unknown id: "), F.col("_ref").cast("string")))))
    packed = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_row"))), lambda x: x["_row"]).alias(into))
    return df.select(key).join(packed, key, "left").withColumn(into, F.coalesce(into, F.array().cast(packed.schema[into].dataType)))


def closure(refs: DataFrame, ref: str, owner: str, targets: DataFrame, target_id: str, target_owner: str, kind: str) -> DataFrame:
    """One row: references, resolved, unresolved, of another owner, and the resolved share in percent (100 without references)."""
    there = targets.select(F.col(target_id).alias("_id"), F.col(target_owner).alias("_owner"))
    joined = refs.select(F.col(ref).alias("_ref"), F.col(owner).alias("_of")).filter("_ref IS NOT NULL").join(there, F.col("_ref") == F.col("_id"), "left")
    resolved = F.count_if(F.col("_id").isNotNull())
    counts = joined.agg(F.count(F.lit(1)).alias("n_refs"), resolved.alias("n_resolved"), F.count_if(F.col("_id").isNull()).alias("n_unresolved"), F.count_if(F.col("_owner") != F.col("_of")).alias("n_cross_owner"))
    percent = F.when(F.col("n_refs") == 0, 100.0).otherwise(F.round(100.0 * F.col("n_resolved") / F.col("n_refs"), 6))
    return counts.select(F.lit(kind).alias("kind"), "*", percent.alias("closure_percent"))


def assert_closed(report: DataFrame) -> None:
    """Raises with the report's open kinds; the report has a row for each kind."""
    bad = report.filter("n_unresolved > 0 OR n_cross_owner > 0").collect()
    if bad:
        raise ValueError("references not closed: " + "; ".join(str(r.asDict()) for r in bad))


def in_range_or_nearest(ranges: DataFrame, points: DataFrame, key: list[str], start: str, end: str, at: str, tie: str, width: float, weight: float | None = None) -> DataFrame:
    """Points with start <= at <= end; for a range without any, the single nearest to its middle (ties: least `tie`, a number).

    With a weight the single point is that of least distance * weight + tie (of equal sums the nearest), so a far smaller tie can outweigh a distance.
    Ranges are joined on the buckets of `width` that they cross, so a hot key is spread over time. A range without a
    point looks in the bucket of its middle, and at the best point before and the best after that bucket (either is the same for every middle between);
    those come from one row for each bucket that has points, so no range meets all points of its key.
    """
    bucket = lambda c: F.floor(c / width)
    placed = points.withColumn("_b", bucket(F.col(at)))
    crossed = ranges.withColumn("_b", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    inside = crossed.join(placed, [*key, "_b"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("_b")
    middle = (F.col(start) + F.col(end)) / 2
    alone = ranges.join(inside.select(*key, start, end).distinct(), [*key, start, end], "left_anti").withColumn("_b", bucket(middle))

    def cost(distance: Column, of: Column) -> Column:
        return F.struct(*([] if weight is None else [(distance * weight + of).alias("_sum")]), distance.alias("_far"), of.alias("_tie"))

    point = F.struct(F.col(at).alias(at), F.col(tie).alias(tie)).alias("_p")
    full = placed.select(*key, "_b", point, cost(-F.col(at), F.col(tie)).alias("_down"), cost(F.col(at), F.col(tie)).alias("_up")).groupBy(*key, "_b").agg(F.min(F.struct("_down", "_p")).alias("_last"), F.min(F.struct("_up", "_p")).alias("_first"))
    asked = alone.select(*key, "_b").distinct()
    passed = lambda order: Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    known = asked.withColumn("_asked", F.lit(True)).join(full, [*key, "_b"], "full")
    known = known.withColumns({"_prev": F.min("_last").over(passed(F.asc("_b")))["_p"], "_next": F.min("_first").over(passed(F.desc("_b")))["_p"]}).filter("_asked")
    here = placed.join(asked, [*key, "_b"], "left_semi").select(*key, "_b", point)
    sides = known.select(*key, "_b", F.explode(F.array_compact(F.array("_prev", "_next"))).alias("_p"))
    near = alone.join(here.unionByName(sides), [*key, "_b"]).groupBy(*alone.columns).agg(F.min_by("_p", cost(F.abs(F.col(f"_p.{at}") - middle), F.col(f"_p.{tie}"))).alias("_p"))
    fallback = near.select(*ranges.columns, F.col(f"_p.{at}").alias(at), F.col(f"_p.{tie}").alias(tie))
    columns = [*ranges.columns, at, tie]
    return inside.select(*columns, F.lit("direct").alias("link")).unionByName(fallback.select(*columns, F.lit("nearest").alias("link")))


def lookup_status(jobs: DataFrame, cache: DataFrame, key: list[str], digest: str, text: str) -> DataFrame:
    """current: cached with the same digest; stale: cached with another; missing; not_applicable for blank text."""
    same = cache.select(*key, digest).distinct().withColumn("_same", F.lit(True))
    other = cache.select(*key).distinct().withColumn("_other", F.lit(True))
    joined = jobs.join(same, [*key, digest], "left").join(other, key, "left")
    status = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "not_applicable").when(F.col("_same"), "current").when(F.col("_other"), "stale").otherwise("missing")
    return joined.withColumn("status", status).drop("_same", "_other")


def attach_or_empty(df: DataFrame, groups: DataFrame, key: str, column: str) -> DataFrame:
    """Left join of an array column; an empty array where there is none."""
    return attach_or_empty_by(df, groups, [key], column)


def attach_or_empty_by(df: DataFrame, groups: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.join(groups.select(*keys, column), keys, "left").withColumn(column, F.coalesce(column, F.array().cast(groups.schema[column].dataType)))


def unpivoted(df: DataFrame, key: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(key, values, name, value)


def by_distinct(df: DataFrame, keys: list[str], columns: list[Column]) -> DataFrame:
    """df with columns that follow from keys alone, worked out once for each of their distinct values; null keys count as equal.

    The values are broadcast, so they are to be of a bounded domain (days, shares of a day, sizes), however many rows there are.
    """
    made = df.select(*keys).distinct().select(*[F.col(k).alias(f"_{k}") for k in keys], *columns)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(F.broadcast(made), same, "left").drop(*[f"_{k}" for k in keys])


def any_of(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
