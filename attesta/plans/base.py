"""Registry and the shared shapes of tables that queries read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import at_utc, epoch_seconds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``f(spark, sf_dir)`` under a name, with SQL that gives the same rows."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a timeline."""
    e = table(spark, sf_dir, "events")
    kind, user = F.col("event_type"), F.col("user_id")
    return e.select(
        F.col("event_id").alias("id"), epoch_seconds(at_utc(F.col("ts"))).alias("sort"), kind.alias("action"), F.concat(F.lit("user-"), user).alias("name"),
        F.concat(F.lit("/"), kind, F.lit("/user-"), user).alias("path"), (kind == "error").alias("flagged"), (kind == "signup").alias("deleted"), user.alias("node"), (user % 5).alias("log"),
    )


EV = """ev AS (SELECT event_id AS id, epoch_us(ts) / 1e6 AS sort, event_type AS action, 'user-' || user_id AS name,
  '/' || event_type || '/user-' || user_id AS path, event_type = 'error' AS flagged, event_type = 'signup' AS deleted, user_id AS node, user_id % 5 AS log FROM events)"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a file listing."""
    o = table(spark, sf_dir, "orders")
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    suffix = F.element_at(F.array(*map(F.lit, ("pdf", "docx", "txt", "JPG", "tar.gz"))), (F.col("o_custkey") % 5 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("node"), F.concat(F.lit("Order-"), F.col("o_orderkey"), F.lit("."), suffix).alias("name"),
        F.concat(F.lit("/c"), F.col("o_custkey") % 97, F.lit("/Order-"), F.col("o_orderkey"), F.lit("."), suffix).alias("path"),
        (F.col("o_orderkey") % 11 == 0).alias("is_dir"), (F.col("o_orderstatus") == "F").alias("deleted"), F.floor("o_totalprice").cast("long").alias("size"),
        day.alias("created"), day.alias("modified"), F.when(F.col("o_orderkey") % 3 != 0, day).alias("accessed"), F.col("o_custkey").alias("evidence_id"),
    )


LS = """ls AS (SELECT CAST(o_orderkey AS VARCHAR) AS node, 'Order-' || o_orderkey || '.' || ext AS name, '/c' || (o_custkey % 97) || '/Order-' || o_orderkey || '.' || ext AS path,
  o_orderkey % 11 = 0 AS is_dir, o_orderstatus = 'F' AS deleted, CAST(floor(o_totalprice) AS BIGINT) AS size, day AS created, day AS modified,
  CASE WHEN o_orderkey % 3 <> 0 THEN day END AS accessed, o_custkey AS evidence_id, o_orderkey
  FROM (SELECT *, ['pdf','docx','txt','JPG','tar.gz'][o_custkey % 5 + 1] AS ext, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS day FROM orders))"""


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as indexed files."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.concat(F.lit("doc-"), "doc_id", F.lit(".txt")).alias("name"), F.concat(F.lit("/"), "source", F.lit("/doc-"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("body"), F.col("source").alias("evidence"), F.col("lang").alias("part"), F.col("n_chars").alias("size"))
