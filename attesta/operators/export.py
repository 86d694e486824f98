"""Sinks: manifests of exported files, and verification of acquired images."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import csv_safe
from .hashing import digests


def manifest(files: DataFrame) -> DataFrame:
    """path, size and digests of exported contents."""
    return digests(files).select("path", F.length("content").alias("size"), "md5", "sha1", "sha256")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header, in which no text begins as a formula would."""
    safe = [csv_safe(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    df.select(*safe).write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def piece_digests(blocks: DataFrame) -> DataFrame:
    """SHA-256 of each block, which any number of tasks can compute."""
    return blocks.select("evidence_id", "offset", F.length("data").alias("size"), F.sha2("data", 256).alias("sha256"))


def image_digests(blocks: DataFrame) -> DataFrame:
    """(evidence_id, size, md5, sha1) of whole images from their blocks in order.

    Such a digest depends on all bytes before, so each image is one task's work; images run beside
    one another, and a task holds one batch of blocks at a time.
    """

    def run(batches):
        evidence, size, hashes = None, 0, ()
        done = []
        for batch in batches:
            for e, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if e != evidence:
                    if hashes:
                        done.append((evidence, size, *(h.hexdigest() for h in hashes)))
                    evidence, size, hashes = e, 0, (hashlib.md5(), hashlib.sha1())
                for h in hashes:
                    h.update(data)
                size += len(data)
        if hashes:
            done.append((evidence, size, *(h.hexdigest() for h in hashes)))
        columns = list(zip(*done, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], ["evidence_id", "size", "md5", "sha1"])

    ordered = blocks.repartition("evidence_id").sortWithinPartitions("evidence_id", "offset")
    return ordered.select("evidence_id", "data").mapInArrow(run, "evidence_id long, size long, md5 string, sha1 string")


def verify(blocks: DataFrame, stored: DataFrame) -> DataFrame:
    """Computed digests beside those an image stores (evidence_id, md5, sha1), and whether they agree."""
    want = stored.select("evidence_id", F.col("md5").alias("stored_md5"), F.col("sha1").alias("stored_sha1"))
    same = lambda a, b: F.col(b).isNull() | (F.lower(a) == F.lower(b))
    some = F.col("stored_md5").isNotNull() | F.col("stored_sha1").isNotNull()
    return image_digests(blocks).join(want, "evidence_id", "left").withColumn("verified", F.when(some, same("md5", "stored_md5") & same("sha1", "stored_sha1")))
