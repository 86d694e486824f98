"""Queries over raw media and registry rows; documents cut into blocks stand in for disks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.times import at_utc
from ..operators import carving, export, hints, registry_report, textindex
from .base import contents, query, table

BLOCK = 4096


def _blocks(spark, d):
    """Each document as a medium in blocks of 4 KiB."""
    text = contents(spark, d).where("length(body) > 0").select(F.col("id").alias("evidence_id"), F.col("body").cast("binary").alias("raw"))
    each = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("raw") - 1) / BLOCK)), lambda i: F.substring("raw", i * BLOCK + 1, F.lit(BLOCK)))).alias("i", "data")
    return text.select("evidence_id", each).select("evidence_id", (F.col("i") * BLOCK).cast("long").alias("offset"), "data")


@query("image_digests", "SELECT doc_id AS evidence_id, octet_length(encode(text)) AS size, md5(text) AS md5, sha1(text) AS sha1 FROM documents WHERE length(text) > 0")
def image_digests(spark, d):
    return export.image_digests(_blocks(spark, d))


@query("image_verify", "SELECT doc_id AS evidence_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 3 = 1 END AS verified FROM documents WHERE length(text) > 0")
def image_verify(spark, d):
    docs = contents(spark, d).where("length(body) > 0")
    stored = docs.select(F.col("id").alias("evidence_id"), F.when(F.col("id") % 3 == 1, F.md5("body")).when(F.col("id") % 3 == 2, F.md5(F.lit("x"))).alias("md5"), F.lit(None).cast("string").alias("sha1"))
    return export.verify(_blocks(spark, d), stored).select("evidence_id", "verified")


@query("piece_digests")
def piece_digests(spark, d):
    return export.piece_digests(_blocks(spark, d)).select("evidence_id", "offset", "sha256")


_RULES = (carving.Signature("license", b"Licensed under".hex(), b".".hex(), 200), carving.Signature("release", b"Released".hex(), None, 40))


@query("carve_blocks")
def carve_blocks(spark, d):
    return carving.carve(_blocks(spark, d), _sizes(spark, d), _RULES, 64).select("evidence_id", "name", "offset", "length", "method")


def _sizes(spark, d):
    docs = contents(spark, d).where("length(body) > 0")
    return docs.select(F.col("id").alias("evidence_id"), F.octet_length("body").cast("long").alias("size"))


@query("carve_all")
def carve_all(spark, d):
    return carving.drop_nested(carving.carve(_blocks(spark, d), _sizes(spark, d), _RULES, 64))


@query("core_sample")
def core_sample(spark, d):
    return carving.core_sample(_blocks(spark, d), _sizes(spark, d), BLOCK, buckets=16, windows=2, whole=16 * BLOCK).withColumn("entropy", F.round("entropy", 6))


@query("structure_template")
def structure_template(spark, d):
    t = carving.Template("head", (("magic", 0, "ascii", 4), ("rest", 4, "ascii", 4)))
    pages = table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return carving.apply_template(pages, t).select("page_id", F.col("fields")["magic"].alias("magic"), F.col("fields")["rest"].alias("rest"))


@query("index_regions")
def index_regions(spark, d):
    return textindex.index_regions(_blocks(spark, d)).select("id", "body")


@query("saved_search", "SELECT 'first' AS search, doc_id AS id FROM documents WHERE contains(text, 'Licensed under')")
def saved_search(spark, d):
    hits = contents(spark, d).where("contains(body, 'Licensed under')").select("id")
    return textindex.saved_search(hits, "first", "2024-01-01", ["Licensed under"]).select("search", "hit.id")


def _registry(spark, d):
    e = table(spark, d, "events")
    path = F.when(F.col("event_type") == "click", "Microsoft\\Windows NT\\CurrentVersion").when(F.col("event_type") == "error", F.concat(F.lit("ControlSet001\\Services\\svc"), "user_id")).otherwise("Software\\Else")
    name = F.when(F.col("event_id") % 3 == 0, "ProductName").when(F.col("event_id") % 3 == 1, "ImagePath").otherwise("Other")
    return e.select(path.alias("path"), name.alias("name"), F.col("event_id").cast("string").alias("value"), F.lit("t").alias("modified"))


@query("registry_report", "SELECT CASE event_type WHEN 'click' THEN 'system' ELSE 'services' END AS section, CAST(event_id AS VARCHAR) AS value FROM events WHERE (event_type = 'click' AND event_id % 3 = 0) OR (event_type = 'error' AND event_id % 3 = 1)")
def report_of_registry(spark, d):
    return registry_report.report(_registry(spark, d)).select("section", "value")


@query("registry_section_counts", "SELECT CASE event_type WHEN 'click' THEN 'system' ELSE 'services' END AS section, count(*) AS n FROM events WHERE (event_type = 'click' AND event_id % 3 = 0) OR (event_type = 'error' AND event_id % 3 = 1) GROUP BY 1")
def registry_section_counts(spark, d):
    return registry_report.section_counts(registry_report.report(_registry(spark, d)))


@query("column_hints", "SELECT event_id, epoch_us(date_trunc('second', ts)) AS at_us FROM events")
def column_hints(spark, d):
    us = F.unix_micros(F.date_trunc("second", at_utc(F.col("ts"))))
    rows = table(spark, d, "events").select("event_id", us.alias("last_visit_date"))
    return hints.decoded(rows, "moz_places").select("event_id", F.unix_micros("last_visit_date_decoded").alias("at_us"))


@query("folded_paths", "SELECT p_partkey, lower(p_name) AS folded FROM part")
def folded_paths(spark, d):
    return table(spark, d, "part").select("p_partkey", X.casefold(F.col("p_name")).alias("folded"))
