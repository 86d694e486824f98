"""All registered queries of the library proper, with their SQL twins."""

from __future__ import annotations

from .plans import file_queries, hashset_queries, media_queries, mnemonic_queries, record_queries, relation_queries, replay_queries, timeline_queries, triage_queries
from .plans.base import ORACLES, QUERIES

__all__ = ["file_queries", "flagship", "hashset_queries", "media_queries", "mnemonic_queries", "oracle_sql", "queries", "record_queries", "relation_queries", "replay_queries", "triage_queries"]


def flagship(spark, sf_dir):
    return timeline_queries.timeline_histogram_range(spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
