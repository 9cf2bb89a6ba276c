"""Which rows of a table changed: trees of range digests, compared from the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_number_of(df: DataFrame) -> Column:
    """A number that follows from all of a row: columns by name, nulls kept."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    return F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")


def range_of(key: Column, depth: int) -> Column:
    """The key's range: hexadecimal digits of its SHA-256, so ranges are even whatever the keys are."""
    return F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256), 1, depth)


def depth_for(n_rows: int, rows_per_range: int = 100_000) -> int:
    """Digits that leave about rows_per_range rows or fewer in a range."""
    depth = 1
    while n_rows > rows_per_range * 16**depth:
        depth += 1
    return depth


def digest_tree(df: DataFrame, key: str, depth: int) -> DataFrame:
    """level, prefix, n_rows, digest for every range of the key's digests, level 0 (all rows) to depth.

    A range's digest is made of the sum of its rows' numbers and their count, so it does not depend on the order of rows, repeated rows count, and one pass over
    the leaves (at most 16 ** depth rows) gives all levels. An empty table has no rows; a null key is a key like others.
    """
    leaves = df.select(range_of(F.col(key), depth).alias("leaf"), row_number_of(df).alias("v")).groupBy("leaf").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    levels = leaves.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "leaf", "s", "n").withColumn("prefix", F.substring("leaf", F.lit(1), F.col("level")))
    sums = levels.groupBy("level", "prefix").agg(F.sum("s").alias("s"), F.sum("n").alias("n_rows"))
    return sums.select("level", "prefix", "n_rows", F.sha2(F.concat_ws(":", F.col("s").cast("string"), F.col("n_rows").cast("string")), 256).alias("digest"))


def changed_ranges(old: DataFrame, new: DataFrame, depth: int) -> DataFrame:
    """prefix, n_old, n_new of the leaves of two trees that differ.

    Every round looks only at the children of nodes that differ, so of two tables with few changes few digests are compared, in `depth` rounds.
    """

    def differing(level: int, above: DataFrame | None) -> DataFrame:
        sides = []
        for tree, name in ((old, "old"), (new, "new")):
            rows = tree.filter(F.col("level") == level)
            if above is not None:
                rows = rows.withColumn("_up", F.substring("prefix", 1, level - 1)).join(above.select(F.col("prefix").alias("_up")), "_up", "left_semi")
            sides.append(rows.select("prefix", F.col("n_rows").alias(f"n_{name}"), F.col("digest").alias(f"_{name}")))
        return sides[0].join(sides[1], "prefix", "full").filter(~F.col("_old").eqNullSafe(F.col("_new"))).drop("_old", "_new")

    found = differing(0, None)
    for level in range(1, depth + 1):
        found = differing(level, found)
    return found.fillna(0)


def changed_rows(old: DataFrame, new: DataFrame, key: str, depth: int) -> DataFrame:
    """key, prefix, change (added, removed, changed) of all rows that differ, found inside the changed ranges only.

    A key counts as changed when its rows, taken together, differ; so repeated keys are one row here, and repeated rows count. A null key is a key like others.
    """
    leaves = changed_ranges(digest_tree(old, key, depth), digest_tree(new, key, depth), depth).select("prefix")
    sides = []
    for df, name in ((old, "_old"), (new, "_new")):
        rows = df.select(F.col(key).alias("_key"), range_of(F.col(key), depth).alias("prefix"), row_number_of(df).alias("v"))
        sides.append(rows.join(leaves, "prefix", "left_semi").groupBy("_key", "prefix").agg(F.concat_ws(":", F.sum("v").cast("string"), F.count(F.lit(1)).cast("string")).alias(name)))
    a, b = sides[0].alias("a"), sides[1].alias("b")
    met = a.join(b, F.col("a.prefix").eqNullSafe(F.col("b.prefix")) & F.col("a._key").eqNullSafe(F.col("b._key")), "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return met.filter(~F.col("_old").eqNullSafe(F.col("_new"))).select(F.when(F.col("_old").isNotNull(), F.col("a._key")).otherwise(F.col("b._key")).alias(key), F.coalesce("a.prefix", "b.prefix").alias("prefix"), change.alias("change"))


def fingerprint_of(tree: DataFrame, upstream: str = "") -> DataFrame:
    """One row: the fingerprint of a table's tree and of what the table was made from, and the number of rows."""
    root = tree.filter("level = 0").agg(F.max("digest").alias("d"), F.coalesce(F.max("n_rows"), F.lit(0)).alias("n_rows"))
    return root.select(F.sha2(F.concat_ws("|", F.lit(upstream), F.coalesce("d", F.lit(""))), 256).alias("fingerprint"), "n_rows")
