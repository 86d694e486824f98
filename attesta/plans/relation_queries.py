"""Queries over pages and totals of timelines, browser records, type scans and roll-ups of a case."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import detect
from ..functions.times import FILETIME_EPOCH_US, epoch_seconds
from ..operators import artefacts, casebook, textindex
from ..operators import timeline as T
from .base import EV, LS, contents, listing, query, table, timeline
from .timeline_queries import _CURSOR, JAN, _histogram_sql

_BEHIND = f"(sort, path, action, id) > ({_CURSOR[0]!r}::DOUBLE, '{_CURSOR[1]}', '{_CURSOR[2]}', {_CURSOR[3]})"


@query("timeline_page_status", f"WITH {EV}, s AS (SELECT count(*) AS matched, count(*) FILTER (WHERE {_BEHIND}) AS rest FROM ev) SELECT matched, least(rest, 97) AS returned, rest <= 97 AS done FROM s")
def timeline_page_status(spark, d):
    return T.page_status(timeline(spark, d), _CURSOR, 97)


_ZOOM = {"lo": JAN + 86400.0, "width": 3600.0, "n": 240, "hi": JAN + 86400.0 + 240 * 3600.0}


@query("timeline_histogram_totals", f"WITH {EV} SELECT count(*) FILTER (WHERE sort < {_ZOOM['lo']!r}) AS before, count(*) FILTER (WHERE sort >= {_ZOOM['lo']!r} AND sort < {_ZOOM['hi']!r}) AS inside, count(*) FILTER (WHERE sort >= {_ZOOM['hi']!r}) AS after, count(*) AS total FROM ev WHERE flagged")
def timeline_histogram_totals(spark, d):
    return T.histogram_totals(timeline(spark, d), _ZOOM, flagged=True)


@query("timeline_histogram_minutes", _histogram_sql(JAN, 8940.0, 300, "flagged"))
def timeline_histogram_minutes(spark, d):
    return T.histogram_from_minutes(T.minutes(timeline(spark, d)), {"lo": JAN, "width": 8940.0, "n": 300}, flagged=True)


@query("browser_downloads", "SELECT event_id AS id, 'C:/d/' || event_id AS target, CASE WHEN p.page_id IS NULL THEN NULL WHEN p.page_id % 2 = 0 THEN p.url ELSE 'http://first/' END AS url, epoch_us(ts) / 1e6 AS started_at, CASE WHEN user_id % 4 <> 0 THEN epoch_us(ts) / 1e6 + 5 END AS finished_at, user_id AS bytes, user_id % 2 = 1 AS opened FROM events LEFT JOIN pages p ON page_id = event_id WHERE event_type = 'purchase'")
def browser_downloads(spark, d):
    pages, e = table(spark, d, "pages"), table(spark, d, "events").where("event_type = 'purchase'")
    first = pages.select(F.col("page_id").alias("id"), F.lit(0).alias("chain_index"), F.lit("http://first/").alias("url"))
    then = pages.where("page_id % 2 = 0").select(F.col("page_id").alias("id"), F.lit(1).alias("chain_index"), "url")
    began = (F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())) + FILETIME_EPOCH_US).alias("start_time")
    rows = e.select(F.col("event_id").alias("id"), F.concat(F.lit("C:/d/"), "event_id").alias("target_path"), began, F.col("user_id").alias("received_bytes"), F.lit(None).cast("long").alias("total_bytes"), (F.col("user_id") % 2).alias("opened"))
    rows = rows.withColumn("end_time", F.when(F.col("received_bytes") % 4 != 0, F.col("start_time") + 5_000_000).otherwise(0))
    out = artefacts.chromium_downloads(rows, first.unionByName(then))
    return out.select("id", "target", "url", epoch_seconds(F.col("started_at")).alias("started_at"), epoch_seconds(F.col("finished_at")).alias("finished_at"), "bytes", "opened")


@query("browser_downloads_places", "SELECT event_id AS id, 'file:///d/' || event_id AS target, p.url, CASE WHEN p.page_id % 3 <> 0 THEN 1.7e9 + p.page_id END AS started_at FROM events LEFT JOIN pages p ON page_id = event_id % 400 WHERE event_id % 3 = 1")
def browser_downloads_places(spark, d):
    notes = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 3).alias("anno_attribute_id"), (F.col("event_id") % 400).alias("place_id"), F.concat(F.lit("file:///d/"), "event_id").alias("content"))
    names = spark.sql("SELECT * FROM VALUES (0, 'bookmark'), (1, 'downloads/destinationFileURI'), (2, 'downloads/metaData') AS n(id, name)")
    places = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url", F.when(F.col("page_id") % 3 != 0, (F.col("page_id") + 1_700_000_000) * 1_000_000).otherwise(0).alias("last_visit_date"))
    return artefacts.firefox_downloads(notes, names, places).select("id", "target", "url", epoch_seconds(F.col("started_at")).alias("started_at"))


_COOKIE = "'c' || c_custkey AS name, CASE WHEN c_custkey % 5 <> 0 THEN 1.7e9 + c_custkey END AS created_at, 1.8e9 + c_custkey AS expires_at, c_custkey % 2 = 1 AS secure"


@query("browser_cookies", f"SELECT 'h' || c_nationkey AS host, {_COOKIE}, c_custkey % 3 = 0 AS encrypted, 'chromium' AS source FROM customer UNION ALL SELECT 'h' || c_nationkey, {_COOKIE}, false, 'firefox' FROM customer")
def browser_cookies(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    host, name, made, bit = F.concat(F.lit("h"), "c_nationkey"), F.concat(F.lit("c"), k), (k + 1_700_000_000) * 1_000_000, k % 2
    ends = k + 1_800_000_000
    chromium = c.select(
        host.alias("host_key"), name.alias("name"), F.lit("/").alias("path"), F.when(k % 5 != 0, made + FILETIME_EPOCH_US).otherwise(0).alias("creation_utc"), (ends * 1_000_000 + FILETIME_EPOCH_US).alias("expires_utc"),
        F.lit(0).cast("long").alias("last_access_utc"), bit.alias("is_secure"), bit.alias("is_httponly"), F.when(k % 3 == 0, F.lit(b"v10")).otherwise(F.lit(b"")).alias("encrypted_value"),
    )
    firefox = c.select(host.alias("host"), name.alias("name"), F.lit("/").alias("path"), F.when(k % 5 != 0, made).otherwise(0).alias("creationTime"), ends.alias("expiry"), F.lit(0).cast("long").alias("lastAccessed"), bit.alias("isSecure"), bit.alias("isHttpOnly"))
    both = artefacts.chromium_cookies(chromium).unionByName(artefacts.firefox_cookies(firefox))
    return both.select("host", "name", epoch_seconds(F.col("created_at")).alias("created_at"), epoch_seconds(F.col("expires_at")).alias("expires_at"), "secure", "encrypted", "source")


@query("browser_recovered", "SELECT page_id, url, 'Title ' || page_id AS title, CASE page_id % 3 WHEN 0 THEN 1.7e9 + page_id WHEN 1 THEN 1.7e9 - page_id END AS visited_at FROM pages WHERE regexp_matches(url, '^(https?|ftp|file)://')")
def browser_recovered(spark, d):
    k = F.col("page_id")
    text = lambda c: F.struct(c.alias("text"), F.lit(None).cast("long").alias("number"))
    number = lambda c: F.struct(F.lit(None).cast("string").alias("text"), c.cast("long").alias("number"))
    stamp = F.when(k % 3 == 0, (k + 1_700_000_000) * 1_000_000 + FILETIME_EPOCH_US).when(k % 3 == 1, (F.lit(1_700_000_000) - k) * 1_000_000).otherwise(7)
    values = F.array(number(k), text(F.lit("abc")), text(F.col("url")), number(stamp), text(F.concat(F.lit("Title "), k)))
    out = artefacts.recovered_urls(table(spark, d, "pages").select("page_id", values.alias("values")))
    return out.select("page_id", "url", "title", epoch_seconds(F.col("visited_at")).alias("visited_at"))


@query("cache_keys", """WITH k AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '1/0/_dk_http://a.b http://a.b ' || url WHEN 2 THEN '1/0/' || url ELSE '12345' END AS key FROM pages),
r AS (SELECT *, regexp_extract(key, '^[^/]*/[^/]*/(.*)$', 1, 's') AS rest FROM k), i AS (SELECT *, CASE WHEN starts_with(rest, '_dk_') THEN CASE WHEN contains(rest, ' ') THEN regexp_extract(rest, '^.* (.*)$', 1, 's') ELSE '' END ELSE rest END AS inside FROM r)
SELECT page_id, CASE WHEN regexp_matches(key, '^(https?|ftp|file|wss?)://') THEN key WHEN regexp_matches(inside, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN inside END AS url, CAST(200 + page_id % 5 AS INTEGER) AS status FROM i""")
def cache_keys(spark, d):
    k = F.col("page_id")
    key = F.when(k % 4 == 0, F.col("url")).when(k % 4 == 1, F.concat(F.lit("1/0/_dk_http://a.b http://a.b "), "url")).when(k % 4 == 2, F.concat(F.lit("1/0/"), "url")).otherwise("12345")
    head = F.concat(F.lit("Server: BaseHTTP/0.6\r\nHTTP/1.1 "), (k % 5 + 200).cast("string"), F.lit(" OK\r\n"))
    return table(spark, d, "pages").select("page_id", artefacts.cache_key_url(key).alias("url"), artefacts.http_status(head).alias("status"))


@query("event_logons", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'logon' || CASE user_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' (logon type 1: unrecognised)' WHEN 2 THEN ' (logon type 2: interactive)' ELSE ' (logon type 3: network)' END WHEN event_type = 'view' THEN 'seen' END AS description FROM events")
def event_logons(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("record"), F.lit("app").alias("provider"), F.col("event_type").alias("event_id"), F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 4).alias("logon_type"))
    catalogue = spark.sql("SELECT * FROM VALUES ('app', 'click', 'logon', true), ('app', 'view', 'seen', false) AS c(provider, event_id, description, with_logon)")
    return artefacts.described(e, catalogue).select(F.col("record").alias("event_id"), "description")


_KINDS = ("prefetch", "usn", "mail", "other")


@query("attack_suggestions", "WITH f AS (SELECT ['prefetch','usn','mail','other'][user_id % 4 + 1] AS kind, count(*) AS findings FROM events GROUP BY 1) SELECT kind, technique, findings FROM f JOIN (VALUES ('prefetch', 'T1204.002'), ('usn', 'T1070.004'), ('usn', 'T1070.006'), ('mail', 'T1566.001')) t(kind, technique) USING (kind)")
def attack_suggestions(spark, d):
    findings = table(spark, d, "events").select(F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("user_id") % 4 + 1).cast("int")).alias("kind"))
    catalogue = spark.sql("SELECT * FROM VALUES ('T1204.002'), ('T1070.004'), ('T1070.006'), ('T1566.001'), ('T1083') AS c(technique)")
    return casebook.suggestions(findings, catalogue).select("kind", "technique", "findings")


@query("type_scan", "SELECT page_id % 7 AS evidence_id, count(*) AS checked, count(*) FILTER (WHERE page_id % 3 = 1) AS mismatches, count(*) FILTER (WHERE page_id % 3 = 1) AS high FROM pages GROUP BY 1")
def type_scan(spark, d):
    extension = F.element_at(F.array(F.lit("html"), F.lit("png"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int"))
    judged = table(spark, d, "pages").select((F.col("page_id") % 7).alias("evidence_id"), detect.type_verdict(extension, F.substring(F.col("html").cast("binary"), 1, 4096), F.length("html")).alias("v"))
    return casebook.type_scan(judged, ["evidence_id"])


@query("storage_sizes", f"WITH {LS} SELECT string_split(path, '/')[2] AS folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM ls GROUP BY ROLLUP (string_split(path, '/')[2])")
def storage_sizes(spark, d):
    return casebook.storage(listing(spark, d).withColumn("folder", F.element_at(F.split("path", "/"), 2)))


@query("triage_rollup", f"WITH {EV}, {LS} SELECT * FROM (SELECT 'high' AS severity, 'errors' AS kind, count(*) AS n FROM ev WHERE flagged UNION ALL SELECT 'medium', 'deleted entries', count(*) FROM ls WHERE deleted UNION ALL SELECT 'low', 'toxic texts', count(*) FROM labels WHERE toxic = 1 UNION ALL SELECT 'info', 'no such thing', 0) WHERE n > 0")
def triage_rollup(spark, d):
    parts = [("high", "errors", timeline(spark, d).where("flagged")), ("medium", "deleted entries", listing(spark, d).where("deleted")), ("low", "toxic texts", table(spark, d, "labels").where("toxic = 1")), ("info", "no such thing", table(spark, d, "labels").where("false"))]
    return casebook.triage_over(parts)


@query("metadata_text", "WITH m AS (SELECT doc_id, 'quality ' || quality AS said FROM labels UNION ALL SELECT doc_id, 'toxic ' || toxic FROM labels), g AS (SELECT doc_id, string_agg(said, ' ' ORDER BY said) AS said FROM m GROUP BY 1) SELECT doc_id AS id, CASE WHEN said IS NULL THEN md5(text) ELSE md5(said || coalesce(' ' || text, '')) END AS digest FROM documents LEFT JOIN g USING (doc_id)")
def metadata_text(spark, d):
    labels = table(spark, d, "labels")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in ("quality", "toxic"))))
    said = labels.select(F.col("doc_id").alias("id"), each.alias("m")).select("id", "m.*")
    return textindex.with_metadata(contents(spark, d).select("id", "body"), said).select("id", F.md5("body").alias("digest"))
