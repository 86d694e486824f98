"""Timeline, journal and event-log queries over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import at_utc
from ..operators import artefacts, filters
from ..operators import timeline as T
from .base import EV, LS, listing, query, table, timeline

JAN, FEB = 1704067200.0, 1706745600.0


def _histogram_sql(lo: float, width: float, n: int, where: str = "true") -> str:
    hi = lo + n * width
    return f"""WITH {EV}, b AS (
  SELECT least(greatest(f - CASE WHEN {lo!r}::DOUBLE + f * {width!r}::DOUBLE > sort THEN 1 ELSE 0 END + CASE WHEN {lo!r}::DOUBLE + (f + 1) * {width!r}::DOUBLE <= sort THEN 1 ELSE 0 END, 0), {n - 1}) AS bucket
  FROM (SELECT *, floor((sort - {lo!r}::DOUBLE) / {width!r}::DOUBLE) AS f FROM ev WHERE ({where}) AND sort >= {lo!r}::DOUBLE AND sort < {hi!r}::DOUBLE))
SELECT CAST(i AS INTEGER) AS bucket, {lo!r}::DOUBLE + i * {width!r}::DOUBLE AS lo, count(b.bucket) AS n
FROM range({n}) t(i) LEFT JOIN b ON b.bucket = i GROUP BY i"""


_TRIMMED = f"""WITH {EV}, s AS (SELECT min(sort) AS a, max(sort) AS z, count(*) AS c FROM ev),
full_range AS (SELECT 60.0::DOUBLE * floor(a / 60) AS flo, 60.0::DOUBLE * (floor(z / 60) + 1) AS fhi, CAST(floor(c * 0.001) AS BIGINT) AS k FROM s),
r AS (SELECT sort, row_number() OVER (ORDER BY sort) - 1 AS up, row_number() OVER (ORDER BY sort DESC) - 1 AS down FROM ev),
t AS (SELECT flo, fhi, k, (SELECT 60.0::DOUBLE * floor(sort / 60) FROM r WHERE up = k) AS tlo, (SELECT 60.0::DOUBLE * floor(sort / 60) + 60 FROM r WHERE down = k) AS thi FROM full_range),
p AS (SELECT CASE WHEN k > 0 AND tlo < thi AND thi - tlo < 0.5 * (fhi - flo) THEN tlo ELSE flo END AS lo0, CASE WHEN k > 0 AND tlo < thi AND thi - tlo < 0.5 * (fhi - flo) THEN thi ELSE fhi END AS hi0 FROM t),
w AS (SELECT *, (hi0 - lo0) / 200 AS w0 FROM p),
g AS (SELECT CASE WHEN w0 >= 60 THEN 60.0::DOUBLE * floor(lo0 / 60) ELSE lo0 END AS lo, CASE WHEN w0 >= 60 THEN 60.0::DOUBLE * ceil(w0 / 60) ELSE w0 END AS width, hi0, w0 FROM w),
h AS (SELECT lo, width, CASE WHEN w0 >= 60 THEN CAST(ceil((hi0 - lo) / width) AS BIGINT) ELSE 200 END AS n FROM g),
b AS (SELECT floor((sort - lo) / width) AS f, sort, lo, width, n FROM ev, h WHERE sort >= lo AND sort < lo + n * width),
c AS (SELECT least(greatest(f - CASE WHEN lo + f * width > sort THEN 1 ELSE 0 END + CASE WHEN lo + (f + 1) * width <= sort THEN 1 ELSE 0 END, 0), n - 1) AS bucket FROM b)
SELECT CAST(i AS INTEGER) AS bucket, h.lo + i * h.width AS lo, count(c.bucket) AS n FROM h, range((SELECT n FROM h)) t(i) LEFT JOIN c ON c.bucket = i GROUP BY i, h.lo, h.width"""


@query("timeline_histogram", _TRIMMED)
def timeline_histogram(spark, d):
    return T.histogram(timeline(spark, d), 200)


@query("timeline_histogram_range", _histogram_sql(JAN, 8940.0, 300))
def timeline_histogram_range(spark, d):
    return T.histogram(timeline(spark, d), 300, JAN, FEB)


@query("timeline_histogram_flagged", _histogram_sql(JAN, 8940.0, 300, "flagged"))
def timeline_histogram_flagged(spark, d):
    return T.histogram(timeline(spark, d), 300, JAN, FEB, flagged=True)


@query("timeline_histogram_zoom", _histogram_sql(JAN, 72.0 * 1, 50))
def timeline_histogram_zoom(spark, d):
    events = timeline(spark, d)
    return T.histogram(events, 50, bounds={"lo": JAN, "width": 72.0, "n": 50, "hi": JAN + 3600.0})


@query("timeline_minutes", f"WITH {EV} SELECT CAST(floor(sort / 60) AS BIGINT) AS m, count(*) AS n, CAST(sum(CAST(flagged AS INTEGER)) AS BIGINT) AS flagged FROM ev GROUP BY 1")
def timeline_minutes(spark, d):
    return T.minutes(timeline(spark, d))


@query("timeline_page_first", f"WITH {EV} SELECT id, sort, path, action FROM ev ORDER BY sort, path, action, id LIMIT 97")
def timeline_page_first(spark, d):
    return T.page(timeline(spark, d), limit=97).select("id", "sort", "path", "action")


_CURSOR = (1705276800.0, "/purchase/user-5", "purchase", 500)


@query("timeline_page_next", f"WITH {EV} SELECT id, sort, path, action FROM ev WHERE (sort, path, action, id) > ({_CURSOR[0]!r}::DOUBLE, '{_CURSOR[1]}', '{_CURSOR[2]}', {_CURSOR[3]}) ORDER BY sort, path, action, id LIMIT 97")
def timeline_page_next(spark, d):
    return T.page(timeline(spark, d), _CURSOR, 97).select("id", "sort", "path", "action")


@query("timeline_filter_text_range", f"WITH {EV} SELECT id, sort, path FROM ev WHERE (contains(lower(path), 'user-1') OR contains(lower(name), 'user-1')) AND flagged AND sort >= 1704672000 AND sort < 1705881600")
def timeline_filter_text_range(spark, d):
    return timeline(spark, d).where(filters.timeline_predicate("USER-1", True, 1704672000.0, 1705881600.0)).select("id", "sort", "path")


@query("timeline_summary", f"WITH {EV} SELECT count(*) AS events, count(DISTINCT path) AS files, count(DISTINCT CASE WHEN deleted THEN path END) AS deleted, CAST(sum(CAST(flagged AS INTEGER)) AS BIGINT) AS flagged, min(sort) AS first, max(sort) AS last FROM ev")
def timeline_summary(spark, d):
    return T.summary(timeline(spark, d))


@query("timeline_numbered", f"WITH {EV} SELECT id, dense_rank() OVER (ORDER BY path) AS path_rank, dense_rank() OVER (ORDER BY action) AS action_rank FROM ev")
def timeline_numbered(spark, d):
    return T.numbered(timeline(spark, d)).select("id", "path_rank", "action_rank")


@query("timeline_decoded", f"WITH {EV}, a AS (SELECT DISTINCT action FROM ev), dim AS (SELECT action, CAST(dense_rank() OVER (ORDER BY action) AS INTEGER) AS action_id FROM a) SELECT id, action, upper(action) AS label FROM ev LEFT JOIN dim USING (action)")
def timeline_decoded(spark, d):
    events = timeline(spark, d)
    labels = events.select("action").distinct().withColumn("label", F.upper("action"))
    return events.join(labels, "action", "left").select("id", "action", "label")


_UNPIVOT = f"""WITH {LS}, u AS (
  SELECT node, path, created AS time, 'created' AS action FROM ls UNION ALL SELECT node, path, modified, 'modified' FROM ls UNION ALL SELECT node, path, accessed, 'accessed' FROM ls)
SELECT node, path, time, action, 'si' AS source, epoch_us(CAST(replace(replace(time, 'T', ' '), 'Z', '') AS TIMESTAMP)) / 1e6 AS sort FROM u
WHERE time IS NOT NULL AND epoch_us(CAST(replace(replace(time, 'T', ' '), 'Z', '') AS TIMESTAMP)) / 1e6 BETWEEN 694224000 AND 820454400"""


@query("timeline_unpivot", _UNPIVOT)
def timeline_unpivot(spark, d):
    entries = listing(spark, d).select("node", "path", "created", "modified", "accessed")
    return T.events_of(entries, 694224000.0, 820454400.0).select("node", "path", "time", "action", "source", "sort")


_ANOMALIES = """WITH x AS (SELECT l_orderkey, l_linenumber, epoch_us(o_orderdate) / 1e6 AS c, epoch_us(l_shipdate) / 1e6 + (l_linenumber % 3) * 0.25 AS f, epoch_us(l_shipdate - INTERVAL 30 DAY) / 1e6 + (l_suppkey % 2) * 0.5 AS m, epoch_us(l_shipdate) / 1e6 + (l_linenumber % 2) * 0.75 AS fm FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN c < f THEN 'backdated' END, CASE WHEN m < c THEN 'modified_first' END, CASE WHEN c = floor(c) AND m = floor(m) AND (f <> floor(f) OR fm <> floor(fm)) THEN 'whole_second' END) AS marks FROM x"""


@query("timeline_anomalies", _ANOMALIES)
def timeline_anomalies(spark, d):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    text = lambda c, ms=F.lit(0): F.date_format(F.timestamp_millis(F.unix_millis(c.cast("timestamp")) + ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    ship = F.col("l_shipdate")
    marks = T.anomaly_marks(text(F.col("o_orderdate")), text(ship, F.col("l_linenumber") % 3 * 250), text(ship - F.expr("INTERVAL 30 DAYS"), F.col("l_suppkey") % 2 * 500), text(ship, F.col("l_linenumber") % 2 * 750))
    return joined.select("l_orderkey", "l_linenumber", F.array_join(marks, ",").alias("marks"))


@query("log_summaries", f"WITH {EV} SELECT log, count(*) AS records, min(sort) AS first, max(sort) AS last, arg_min(action, (sort, id)) AS channel FROM ev GROUP BY log")
def log_summaries(spark, d):
    events = timeline(spark, d)
    return events.groupBy("log").agg(F.count("*").alias("records"), F.min("sort").alias("first"), F.max("sort").alias("last"), F.min_by("action", F.struct("sort", "id")).alias("channel"))


@query("newest_events", f"WITH {EV}, n AS (SELECT id, sort, log, action FROM ev ORDER BY sort DESC, log DESC, id DESC LIMIT 500) SELECT * FROM n")
def newest_events(spark, d):
    return T.newest(timeline(spark, d), ["sort", "log", "id"], 500).select("id", "sort", "log", "action")


def journal(spark, d):
    """``events`` as change-journal records."""
    e = table(spark, d, "events")
    reason = F.when(F.col("event_type") == "error", "deleted").otherwise(F.col("event_type"))
    more = F.when(F.col("value") > 50, F.array(reason, F.lit("close"))).otherwise(F.array(reason))
    return e.select(F.col("event_id").alias("usn"), F.concat(F.when(F.col("event_id") % 2 == 0, "File").otherwise("file"), F.col("user_id") % 50, F.lit(".dat")).alias("name"), (F.col("user_id") % 40).alias("mft"), at_utc(F.col("ts")).alias("timestamp"), more.alias("reasons"))


_J = """j AS (SELECT event_id AS usn, CASE WHEN event_id % 2 = 0 THEN 'File' ELSE 'file' END || (user_id % 50) || '.dat' AS name, user_id % 40 AS mft, epoch_us(ts) AS us,
  CASE WHEN value > 50 THEN [CASE WHEN event_type = 'error' THEN 'deleted' ELSE event_type END, 'close'] ELSE [CASE WHEN event_type = 'error' THEN 'deleted' ELSE event_type END] END AS reasons FROM events)"""
_FOLD = "f AS (SELECT lower(name) AS key, mft, count(*) AS records, list_sort(list_distinct(flatten(list(reasons)))) AS reasons, min(us) AS first_us, max(us) AS last_us, arg_min(name, usn) AS name FROM j GROUP BY 1, 2)"


@query("journal_fold", f"WITH {_J}, {_FOLD} SELECT key, mft, records, array_to_string(reasons, ',') AS reasons, first_us, last_us, name FROM f")
def journal_fold(spark, d):
    folded = artefacts.journal_fold(journal(spark, d))
    return folded.select("key", "mft", "records", F.array_join("reasons", ",").alias("reasons"), F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "name")


@query("journal_gone_names", f"WITH {_J}, {_FOLD} SELECT key, mft, list_contains(reasons, 'deleted') AND NOT (mft % 3 = 0 AND key = 'file' || mft || '.dat') AS gone FROM f")
def journal_gone_names(spark, d):
    live = journal(spark, d).select("mft").distinct().where("mft % 3 = 0").withColumn("name", F.concat(F.lit("FILE"), "mft", F.lit(".DAT")))
    return artefacts.gone_names(artefacts.journal_fold(journal(spark, d)), live).select("key", "mft", "gone")


@query("journal_query", f"WITH {_J} SELECT usn, name FROM j WHERE contains(lower(name), 'file1') AND list_contains(reasons, 'close') ORDER BY usn LIMIT 200 OFFSET 10")
def journal_query(spark, d):
    return filters.journal_query(journal(spark, d), "FILE1", "close").orderBy("usn").offset(10).limit(200).select("usn", "name")


@query("journal_facets", f"WITH {_J} SELECT DISTINCT unnest(reasons) AS value FROM j")
def journal_facets(spark, d):
    return filters.facets(journal(spark, d), "reasons")


@query("operation_query", "SELECT event_id, redo, undo FROM (SELECT event_id, event_type AS redo, CASE WHEN event_id % 2 = 0 THEN 'noop' ELSE event_type END AS undo, 'f' || (user_id % 30) AS n FROM events) WHERE (contains(n, 'f1') OR contains(redo, 'f1') OR contains(undo, 'f1')) AND (redo = 'click' OR undo = 'click')")
def operation_query(spark, d):
    e = table(spark, d, "events")
    records = e.select("event_id", F.col("event_type").alias("redo"), F.when(F.col("event_id") % 2 == 0, "noop").otherwise(F.col("event_type")).alias("undo"), F.array(F.concat(F.lit("F"), F.col("user_id") % 30)).alias("names"))
    return filters.operation_query(records, "f1", "click").select("event_id", "redo", "undo")


@query("event_descriptions", "SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN 'known ' || event_type END AS description FROM events")
def event_descriptions(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("record"), F.lit("app").alias("provider"), F.col("event_type").alias("event_id"))
    catalogue = spark.sql("SELECT * FROM VALUES ('app', 'click', 'known click'), ('app', 'error', 'known error') AS c(provider, event_id, description)")
    return artefacts.described(e, catalogue).select(F.col("record").alias("event_id"), "description")
