"""Timeline operators over streams: minute buckets with late data, newest events, and growing indexes."""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.textindex import postings


def minute_buckets(events: DataFrame, time: str = "ts", late: str = "10 minutes", flagged: str = "flagged") -> DataFrame:
    """Events and flagged events per minute: m, n, flagged; a minute is final ``late`` after its end.

    The same rows as the batch operator gives once all events are in.
    """
    watched = events.withWatermark(time, late)
    grouped = watched.groupBy(F.window(time, "1 minute").alias("w")).agg(F.count("*").alias("n"), F.sum(F.col(flagged).cast("long")).alias("flagged"))
    return grouped.select(F.floor(F.unix_seconds("w.start") / 60).cast("long").alias("m"), "n", "flagged")


def sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of events of one key with no pause of ``gap`` or more: key, start, end, n."""
    watched = events.withWatermark(time, late)
    grouped = watched.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first of repeated events, as far back as late ones may come."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _present(held):
    """Orders nulls before values; an absent value is not compared with another."""
    keys, event = held
    return tuple((there, value) if there else (False,) for there, value in keys), event


def newest_of_logs(events: DataFrame, limit: int, order: list[str], by: str = "log", time: str | None = None, idle: str | None = None) -> DataFrame:
    """The ``limit`` newest events of each log as they stand: total, rank, and the event's columns.

    Run it with update output.  A batch that adds to a log gives all rows of that log again, oldest first from rank 1,
    and ``total`` tells how many events were read so far: the rows with a log's largest total are its newest,
    the same as over a table of all events, in whatever order they came.  Events go by ``order`` (numbers, texts or
    times; nulls first), those equal there by all their columns as JSON.  A null log is a log of its own.

    State is ``limit`` events a log.  With ``idle`` and ``time``, a timestamp column, a log without an event for so
    long is forgotten, and one that comes back begins anew; later than that, events no longer count.
    """
    whole = F.to_json(F.struct(*events.columns), _EXACT)
    keyed = events.select(F.col(by).cast("string").alias("_log"), (F.col(time) if idle else F.lit(None).cast("timestamp")).alias("_time"), whole.alias("_event"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(order)))
    if idle:
        keyed = keyed.withWatermark("_time", idle)
    names = [f"_k{i}" for i in range(len(order))]

    def newer(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        total, kept = state.get if state.exists else (0, [])
        held = [pickle.loads(k) for k in kept]
        for frame in frames:
            total += len(frame)
            values = zip(*(frame[c].astype(object).where(frame[c].notna(), None) for c in names), frame["_event"], strict=True)
            held += [(tuple((v is not None, v) for v in row[:-1]), row[-1]) for row in values]
            held = sorted(held, key=_present)[-limit:]
        state.update((total, [pickle.dumps(h) for h in held]))
        if idle:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 1 + pd.Timedelta(idle) // pd.Timedelta("1ms"))
        yield pd.DataFrame({"total": total, "rank": range(1, len(held) + 1), "_event": [e for _, e in held]})

    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    found = keyed.groupBy("_log").applyInPandasWithState(newer, "total long, rank long, _event string", "total long, kept array<binary>", "update", timeout)
    return found.select("total", "rank", F.from_json("_event", events.schema, _EXACT).alias("_e")).select("total", "rank", "_e.*")


def follow(spark: SparkSession, path: str, schema: str, per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def index_new(docs: DataFrame, path: str, checkpoint: str):
    """Writes postings of new documents beside those of earlier ones, and stops when all are in."""
    return postings(docs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
