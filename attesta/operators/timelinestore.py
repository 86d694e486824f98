"""A timeline on disk: files sorted by (sort, id) with the bounds of each beside them, so a page opens few.

``events`` holds a folder a batch, dealt by ranges of the key and sorted within files; ``bounds`` (file, n, first, last)
tells what each file holds.  A batch counts once its bounds are written, which is last, so a failed write adds nothing.
Appending an evidence writes its own batch and touches no other file; ``merge`` lays all batches out anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("sort", "id")
_BOUNDS = "file string, n long, first struct<sort:double,id:long>, last struct<sort:double,id:long>, batch string"


def _bounds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BOUNDS).parquet(f"{path}/bounds")


def append(events: DataFrame, path: str, rows_per_file: int = 1_000_000) -> str:
    """Adds ``events`` (sort, id and any other columns, the same at each call) as a batch, and names it.

    Rows without a sort value have no place in a timeline and are left out.
    """
    spark, batch = events.sparkSession, uuid.uuid4().hex
    keyed = events.where("sort is not null").withColumns({"sort": F.col("sort").cast("double"), "id": F.col("id").cast("long")})
    at = f"{path}/events/batch={batch}"
    keyed.repartitionByRange(*KEY).sortWithinPartitions(*KEY).write.option("maxRecordsPerFile", rows_per_file).parquet(at)
    key = F.struct(*KEY)
    written = spark.read.schema(keyed.schema).parquet(at)
    told = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
    told.write.parquet(f"{path}/bounds/batch={batch}")
    return batch


def files_of_page(spark: SparkSession, path: str, after: tuple[float, int] | None, limit: int) -> list[str]:
    """The files that hold the ``limit`` events behind ``after``, from the bounds alone."""
    beyond = lambda c: F.lit(True) if after is None else F.col(c) > F.struct(F.lit(float(after[0])).alias("sort"), F.lit(int(after[1])).alias("id"))
    held = _bounds(spark, path).where(beyond("last"))
    # Files that begin behind ``after`` count whole; each holds a row, so ``limit`` of them are enough.
    whole = held.where(beyond("first")).orderBy("last").limit(limit).select("n", "last").collect()
    seen = 0
    for row in whole:
        seen += row["n"]
        if seen >= limit:
            end = row["last"]
            held = held.where(F.col("first") <= F.struct(F.lit(end["sort"]).alias("sort"), F.lit(end["id"]).cast("long").alias("id")))
            break
    return sorted(r[0] for r in held.select("file").collect())


def page(spark: SparkSession, path: str, schema, after: tuple[float, int] | None = None, limit: int = 500) -> DataFrame:
    """The ``limit`` events behind the key ``after``, in order; from the start where that is None.  ``schema`` is that of the events."""
    files = files_of_page(spark, path, after, limit)
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*files)
    if after is not None:
        sort, own = float(after[0]), int(after[1])
        rows = rows.where((F.col("sort") >= sort) & ((F.col("sort") > sort) | (F.col("id") > own)))
    return rows.orderBy(*KEY).limit(limit)


def whole(spark: SparkSession, path: str, schema) -> DataFrame:
    """All events of batches that count."""
    batches = [r[0] for r in _bounds(spark, path).select("batch").distinct().collect()]
    return spark.read.schema(schema).parquet(*(f"{path}/events/batch={b}" for b in batches)) if batches else spark.createDataFrame([], schema)


def merge(spark: SparkSession, path: str, schema, into: str, rows_per_file: int = 1_000_000) -> str:
    """Writes all batches as one to a timeline at ``into``, where pages open one or two files again."""
    return append(whole(spark, path, schema), into, rows_per_file)
