"""Comparison of two listings of one place at two times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold

COMPARED = ("size", "modified", "created", "accessed", "deleted")


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, by an aggregate rather than a window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def listing_diff(a: DataFrame, b: DataFrame, fold: bool = False, compared: tuple[str, ...] = COMPARED) -> DataFrame:
    """path, status (added, removed, changed, unchanged) and changed columns.

    Entries meet by path, or by name at the root where the path is null.  Nulls equal each other and
    nothing else.  Of entries at one path the first by ``node`` counts.
    """
    have = [c for c in compared if c in a.columns and c in b.columns]
    path = F.coalesce(F.col("path"), F.concat(F.lit("/"), F.col("name")))

    def side(df, name):
        keyed = df.select(path.alias("_path"), *have, "node").withColumn("_key", casefold(F.col("_path")) if fold else F.col("_path"))
        kept = first_by_key(keyed, ["_key"], ["node", "_path"])
        return kept.select("_key", F.struct("_path", *have).alias(name))

    joined = side(a, "a").join(side(b, "b"), "_key", "full")
    differs = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in have)))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size("changes") > 0, "changed").otherwise("unchanged")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    out = joined.withColumn("changes", F.when(both, differs).otherwise(F.array().cast("array<string>")))
    return out.select(F.coalesce("b._path", "a._path").alias("path"), status.alias("status"), "changes")


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("n"))
