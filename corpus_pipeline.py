"""Corpus preparation: stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.llm import decontaminate, lines, packing, quality, simhash
from attesta.llm.common import table


def quality_filter(spark, docs, sf_dir):
    """Keeps documents that the ranker scores at or above its threshold; it learns from ``labels``
    but for the fold that the quality query holds out."""
    labels = table(spark, sf_dir, "labels").where((F.crc32(F.col("doc_id").cast("string")) % 3) != 1)
    ranker = quality.train(docs, labels)
    good = quality.scorer(ranker, quality.features)(F.col("text"))
    return docs.withColumn("_score", good).where("_score >= 0.5").drop("_score")


def line_dedup(spark, docs, sf_dir):
    """Deletes later copies of runs of two or more lines."""
    return lines.dedup_lines(docs, min_lines=2).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark, docs, sf_dir):
    """Keeps one document, that of the smallest doc_id, of each group of similar texts; a null doc_id comes last."""
    return simhash.first_of_similar(docs, words=5).select(*docs.columns)


def decontamination(spark, docs, sf_dir):
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    """Packs the rest into sequences of 2048 ids."""
    return packing.pack_documents(docs)


STAGES = [("quality_filter", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]
# Learned scores, fingerprints and subword ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
