"""Digests, hash lists, duplicates and matches against hash sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ALGORITHMS = ("md5", "sha1", "sha256")
# Rank of hash-set kinds; the lowest wins.
KINDS = ("known_bad", "notable", "known_good")


def digests(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds md5, sha1 and sha256 of a binary or text column, in one scan."""
    c = F.col(content).cast("binary")
    return files.withColumns({"md5": F.md5(c), "sha1": F.sha1(c), "sha256": F.sha2(c, 256)})


def duplicates(hashes: DataFrame, digest: str = "sha256", across: str = "evidence_id") -> DataFrame:
    """Rows whose digest stands in more than one ``across``; empty and null digests never group.

    The groups come from a pre-aggregated pass, and rows meet only the digests that repeat.
    """
    held = hashes.where(F.col(digest) != "")
    repeated = held.select(digest, across).distinct().groupBy(digest).agg(F.count("*").alias("_n")).where("_n > 1").select(digest)
    return held.join(repeated, digest)


def duplicate_groups(hashes: DataFrame, digest: str = "sha256", across: str = "evidence_id", members: int = 100) -> DataFrame:
    """digest, n, n_across and the first ``members`` node ids of each group, largest first."""
    rows = duplicates(hashes, digest, across)
    place = Window.partitionBy(digest).orderBy("node")
    first = rows.withColumn("_at", F.row_number().over(place)).where(F.col("_at") <= members)
    lists = first.groupBy(digest).agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    counts = rows.groupBy(digest).agg(F.count("*").alias("n"), F.countDistinct(across).alias("n_across"))
    return counts.join(lists, digest).orderBy(F.desc("n"), digest)


def unpivoted(hashes: DataFrame) -> DataFrame:
    """(node, algo, digest): one row per digest that is not empty, in small letters."""
    have = [a for a in ALGORITHMS if a in hashes.columns]
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("algo"), F.lower(a).alias("digest")) for a in have))).alias("d")
    return hashes.select("node", rows).select("node", "d.algo", "d.digest").where("digest != ''")


def matches(hashes: DataFrame, hash_sets: DataFrame, hash_entries: DataFrame) -> DataFrame:
    """(node, algo, digest, set_id, kind, label): entries of hash sets that name a file's digest of the same algorithm."""
    entries = hash_entries.select("set_id", F.lower("algo").alias("algo"), F.lower("digest").alias("digest"), "label")
    return unpivoted(hashes).join(entries, ["algo", "digest"]).join(hash_sets.select(F.col("id").alias("set_id"), "kind"), "set_id")


def verdicts(matched: DataFrame) -> DataFrame:
    """One row per node with its kind that ranks first and the number of matches."""
    rank = F.when(F.col("kind") == KINDS[0], 0).when(F.col("kind") == KINDS[1], 1).otherwise(2)
    return matched.groupBy("node").agg(F.min_by("kind", F.struct(rank, "kind")).alias("kind"), F.count("*").alias("matches"))


def match_counts(matched: DataFrame) -> DataFrame:
    """Distinct nodes per kind of hash set."""
    return matched.groupBy("kind").agg(F.countDistinct("node").alias("nodes"))


def read_hash_list(spark: SparkSession, path: str) -> DataFrame:
    """(algo, digest, label) of a hash list in CSV or free text.

    The first token of 32, 40 or 64 hexadecimal digits names the algorithm by its length; what else
    the line says is the label.  Of repeated digests the label of the first line stays.
    """
    lines = spark.read.text(path)
    digest = F.lower(F.regexp_extract("value", r"(?i)(?<![0-9a-f])([0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9a-f])", 1))
    algo = F.when(F.length("digest") == 32, "md5").when(F.length("digest") == 40, "sha1").otherwise("sha256")
    label = F.trim(F.regexp_replace(F.regexp_replace("value", r"(?i)(?<![0-9a-f])([0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9a-f])", " "), r'[\s,;"*]+', " "))
    line = F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"))
    rows = lines.withColumn("line", line).withColumn("digest", digest).where("digest != ''").select(algo.alias("algo"), "digest", "line", label.alias("label"))
    return rows.groupBy("algo", "digest").agg(F.min_by("label", "line").alias("label"))


def annotate(hits: DataFrame, judged: DataFrame) -> DataFrame:
    """Search hits with the verdict of their file, null without one."""
    return hits.join(judged.select("node", F.col("kind").alias("hash_kind")), "node", "left")
