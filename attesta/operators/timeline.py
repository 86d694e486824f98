"""Timelines: events from listings, pages, minute buckets and exact histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import timeline_predicate
from .scratch import cut

# The time fields of a listing entry and the action and source that each stands for, fixed values.
TIME_FIELDS = (
    ("created", "created", "si"), ("modified", "modified", "si"), ("accessed", "accessed", "si"), ("changed", "changed", "si"), ("mft_modified", "changed", "si"),
    ("deleted_at", "deleted", "si"), ("added", "added", "si"), ("fn_created", "created", "fn"), ("fn_modified", "modified", "fn"), ("fn_accessed", "accessed", "fn"), ("fn_mft_modified", "changed", "fn"),
)
PAGE_LIMIT = 2000
MAX_BINS = 1000
TRIM = 0.001


def epoch_of(text: Column) -> Column:
    """ISO-8601 text as seconds since 1970; text without a zone counts as UTC, unreadable text is null."""
    return F.unix_micros(F.try_to_timestamp(text)) / F.lit(1e6)


def anomaly_marks(created: Column, fn_created: Column, modified: Column, fn_modified: Column) -> Column:
    """Names of what is odd about an entry's times, in a fixed order.

    backdated: created before the file-name record's creation; modified_first: modified before
    created; whole_second: created and modified both fall on whole seconds while a time of the
    file-name record does not.  A time that is null or unreadable marks nothing.
    """
    c, f, m, fm = (epoch_of(x) for x in (created, fn_created, modified, fn_modified))
    whole = lambda x: F.coalesce(x == F.floor(x), F.lit(False))
    part = lambda x: F.coalesce(x != F.floor(x), F.lit(False))
    marks = [F.when(c < f, F.lit("backdated")), F.when(m < c, F.lit("modified_first")), F.when(whole(c) & whole(m) & (part(f) | part(fm)), F.lit("whole_second"))]
    return F.array_compact(F.array(*marks))


def events_of(entries: DataFrame, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """One row per entry and time field that holds a time, within the closed range ``lo`` to ``hi``.

    Columns: sort, time, action, source, and those of the entry but the time fields.
    """
    have = [t for t in TIME_FIELDS if t[0] in entries.columns]
    rows = F.array(*(F.struct(F.col(c).alias("time"), F.lit(a).alias("action"), F.lit(s).alias("source")) for c, a, s in have))
    rest = [c for c in entries.columns if c not in {t[0] for t in TIME_FIELDS}]
    out = entries.select(*rest, F.explode(F.filter(rows, lambda r: r["time"].isNotNull() & (r["time"] != ""))).alias("e")).select("e.*", *rest)
    out = out.withColumn("sort", epoch_of(F.col("time"))).where("sort is not null")
    if lo is not None:
        out = out.where(F.col("sort") >= float(lo))
    if hi is not None:
        out = out.where(F.col("sort") <= float(hi))
    return out


def page(events: DataFrame, cursor: tuple | None = None, limit: int = 200, **criteria) -> DataFrame:
    """Up to ``limit`` events after ``cursor`` in the order (sort, path, action, id).

    ``cursor`` is the key of the last event of the page before.  It is a range condition on the sort
    key, so a page costs no more the later it comes.
    """
    if not 1 <= limit <= PAGE_LIMIT:
        raise ValueError(f"limit: 1 to {PAGE_LIMIT}")
    return events.where(timeline_predicate(**criteria)).where(_after(cursor)).orderBy("sort", "path", "action", "id").limit(limit)


def _after(cursor: tuple | None) -> Column:
    if cursor is None:
        return F.lit(True)
    s, p, a, i = cursor
    rest = (F.col("path") > p) | ((F.col("path") == p) & ((F.col("action") > a) | ((F.col("action") == a) & (F.col("id") > i))))
    return (F.col("sort") >= s) & ((F.col("sort") > s) | rest)


def page_status(events: DataFrame, cursor: tuple | None = None, limit: int = 200, **criteria) -> DataFrame:
    """matched (all events that meet ``criteria``), returned and done of a page, in one row and one pass."""
    left = F.coalesce(F.sum(_after(cursor).cast("long")), F.lit(0))
    out = events.where(timeline_predicate(**criteria)).agg(F.count("*").alias("matched"), left.alias("_left"))
    return out.select("matched", F.least("_left", F.lit(limit)).cast("long").alias("returned"), (F.col("_left") <= limit).alias("done"))


def minutes(events: DataFrame) -> DataFrame:
    """Events and flagged events per minute: m (minutes since 1970), n, flagged."""
    return events.groupBy(F.floor(F.col("sort") / 60).cast("long").alias("m")).agg(F.count("*").alias("n"), F.sum(F.col("flagged").cast("long")).alias("flagged"))


def _kth(events: DataFrame, k: int, ascending: bool) -> float:
    key = F.col("sort").asc() if ascending else F.col("sort").desc()
    return events.select("sort").orderBy(key).offset(k).limit(1).first()[0]


def histogram_bounds(events: DataFrame, bins: int, start: float | None = None, end: float | None = None) -> dict:
    """Range and width of a histogram; without a full range, 0.1 % of tails on either side are trimmed
    where that halves the range."""
    bins = max(1, min(int(bins), MAX_BINS))
    got = events.agg(F.min("sort"), F.max("sort"), F.count("*")).first()
    if not got[2]:
        return {"lo": 0.0, "width": 60 / bins, "n": bins, "hi": 60.0, "full": None, "trimmed": False}
    full_lo, full_hi = 60.0 * math.floor(got[0] / 60), 60.0 * (math.floor(got[1] / 60) + 1)
    lo, hi, trimmed = full_lo if start is None else float(start), full_hi if end is None else float(end), False
    k = int(got[2] * TRIM)
    if (start is None or end is None) and k > 0:
        t_lo = 60.0 * math.floor(_kth(events, k, True) / 60)
        t_hi = 60.0 * math.floor(_kth(events, k, False) / 60) + 60
        if t_lo < t_hi and t_hi - t_lo < 0.5 * (full_hi - full_lo):
            trimmed = True
            lo, hi = t_lo if start is None else lo, t_hi if end is None else hi
    if hi <= lo:
        hi = lo + 60
    width, n = (hi - lo) / bins, bins
    if width >= 60:
        width = 60.0 * math.ceil(width / 60)
        lo = 60.0 * math.floor(lo / 60)
        n = math.ceil((hi - lo) / width)
    return {"lo": lo, "width": width, "n": n, "hi": lo + n * width, "full": (full_lo, full_hi), "trimmed": trimmed}


def histogram(events: DataFrame, bins: int, start: float | None = None, end: float | None = None, bounds: dict | None = None, **criteria) -> DataFrame:
    """bucket, lo, n for every bucket of a histogram over the events that meet ``criteria``.

    A bucket takes ``lo <= sort < lo + width`` as those doubles compare: the quotient's bucket is
    moved by one where rounding put it on the wrong side.
    """
    b = bounds or histogram_bounds(events, bins, start, end)
    lo, width, n = F.lit(b["lo"]), F.lit(b["width"]), b["n"]
    s = F.col("sort")
    first = F.floor((s - lo) / width).cast("double")
    exact = first - (lo + first * width > s).cast("int") + (lo + (first + 1) * width <= s).cast("int")
    inside = events.where(timeline_predicate(**criteria)).where((s >= lo) & (s < F.lit(b["hi"])))
    counts = inside.groupBy(F.greatest(F.least(exact, F.lit(n - 1.0)), F.lit(0.0)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    frame = events.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    return frame.join(counts, "bucket", "left").select("bucket", (lo + F.col("bucket") * width).alias("lo"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram_totals(events: DataFrame, bounds: dict, **criteria) -> DataFrame:
    """before, inside, after and total of a histogram's range over the events that meet ``criteria``, in one row."""
    s = F.col("sort")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    kinds = [count(s < bounds["lo"]).alias("before"), count((s >= bounds["lo"]) & (s < bounds["hi"])).alias("inside"), count(s >= bounds["hi"]).alias("after")]
    return events.where(timeline_predicate(**criteria)).agg(*kinds).withColumn("total", F.col("before") + F.col("inside") + F.col("after"))


def histogram_from_minutes(buckets: DataFrame, bounds: dict, flagged: bool = False) -> DataFrame:
    """The rows of ``histogram`` from minute buckets (m, n, flagged) alone, for bounds on whole minutes.

    Such buckets are kept once per timeline, so a zoom out reads a row a minute and not an event each.
    """
    lo, width, n = (int(bounds[k]) for k in ("lo", "width", "n"))
    if lo % 60 or width % 60 or not width or lo != bounds["lo"] or width != bounds["width"]:
        raise ValueError("bounds: whole minutes")
    place = F.floor((F.col("m") - lo // 60) / (width // 60)).cast("int")
    inside = buckets.where((F.col("m") >= lo // 60) & (F.col("m") < (lo + n * width) // 60))
    counts = inside.groupBy(place.alias("bucket")).agg(F.sum("flagged" if flagged else "n").alias("n"))
    frame = buckets.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    return frame.join(counts, "bucket", "left").select("bucket", (F.lit(float(lo)) + F.col("bucket") * F.lit(float(width))).alias("lo"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def summary(events: DataFrame) -> DataFrame:
    """events, files, deleted, flagged and the span of a timeline, in one row."""
    return events.agg(
        F.count("*").alias("events"), F.countDistinct("path").alias("files"), F.countDistinct(F.when(F.col("deleted"), F.col("path"))).alias("deleted"),
        F.sum(F.col("flagged").cast("long")).alias("flagged"), F.min("sort").alias("first"), F.max("sort").alias("last"),
    )


def newest(records: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The ``limit`` newest records by ``order``, oldest first."""
    return records.orderBy(*(F.desc(c) for c in order)).limit(limit).orderBy(*order)


def newest_by(records: DataFrame, by: str, order: list[str], limit: int) -> DataFrame:
    """The ``limit`` newest records of each log by ``order``, with their rank from 1, oldest first, and the log's total.

    Tasks keep ``limit`` records a log before they exchange any.  Nulls are oldest; orders should have no ties.
    """
    back = Window.partitionBy(by).orderBy(*(F.desc_nulls_last(c) for c in order))
    kept = records.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= limit)
    totals = records.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("total"))
    rank = (F.least("total", F.lit(limit)) - F.col("_back") + 1).alias("rank")
    return kept.join(totals, F.col(by).eqNullSafe(F.col("_by"))).select("total", rank, *records.columns)


def log_summaries(records: DataFrame, by: str, channel: str | None = None) -> DataFrame:
    """Records, first and last time of each log, and its first channel that is not null."""
    more = [F.min_by(channel, F.when(F.col(channel).isNotNull(), F.col("sort"))).alias("channel")] if channel else []
    return records.groupBy(by).agg(F.count("*").alias("records"), F.min("sort").alias("first"), F.max("sort").alias("last"), *more)


def ranked(values: DataFrame, column: str) -> DataFrame:
    """Distinct values with their rank from 1 in sorted order, without one task that sees them all.

    Values are dealt by range; a value's rank is its place within its range and the number of values
    in the ranges before, of which there are as many as tasks.
    """
    ranges = values.select(column).distinct().repartitionByRange(column).withColumn("_range", F.spark_partition_id())
    ranges = cut(ranges)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return ranges.withColumn("_place", place).join(F.broadcast(offsets), "_range").select(column, (F.col("_place") + F.col("_before")).cast("long").alias("rank"))


def numbered(events: DataFrame) -> DataFrame:
    """Events with the rank of their path and action among all distinct ones."""
    paths = ranked(events, "path").withColumnRenamed("rank", "path_rank")
    actions = ranked(events, "action").withColumnRenamed("rank", "action_rank")
    return events.join(paths, "path").join(actions, "action")
