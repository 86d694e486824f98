"""Listing, hashing, diff, interval and detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import detect, fuzzy
from ..functions import text as X
from ..functions import times as S
from ..operators import artefacts, diff, filters, hashing, intervals, similar
from .base import LS, contents, listing, query, table

_COLS = "node, name, size"


def _entry(name, criteria, where):
    @query(f"entry_filter_{name}", f"WITH {LS} SELECT {_COLS} FROM ls WHERE {where}")
    def run(spark, d):
        return filters.filter_entries(listing(spark, d), criteria).select("node", "name", "size")

    return run


_entry("name", {"name": "ORDER-12"}, "contains(lower(name), 'order-12')")
_entry("extension", {"extensions": [".PDF", "gz", ""]}, "lower(string_split(name, '.')[-1]) IN ('pdf', 'gz')")
_entry("size", {"min_size": 50000, "max_size": 150000}, "coalesce(size, 0) BETWEEN 50000 AND 150000")
_entry("dates", {"accessed_after": "1994-01-01", "accessed_before": "1995-06-17"}, "accessed >= '1994-01-01' AND accessed <= '1995-06-17'")
_entry("flags", {"deleted_only": True, "files_only": True}, "deleted AND NOT is_dir")
_entry("hidden", {"hide_deleted": True, "created_before": "1995-06-17T00:00:00Z"}, "NOT deleted AND created <= '1995-06-17T00:00:00Z'")


@query("directory_order", f"WITH {LS} SELECT node, row_number() OVER (ORDER BY NOT is_dir, lower(name), node) AS place FROM ls ORDER BY NOT is_dir, lower(name), node LIMIT 500")
def directory_order(spark, d):
    from pyspark.sql import Window

    first = listing(spark, d).orderBy(~F.col("is_dir"), F.lower("name"), "node").limit(500)
    return first.select("node", F.row_number().over(Window.orderBy(~F.col("is_dir"), F.lower("name"), "node")).cast("long").alias("place"))


@query("resolve_paths", f"WITH {LS}, wanted AS (SELECT upper(path) AS path, CASE WHEN o_orderkey % 2 = 0 THEN node ELSE '0' END AS node FROM ls WHERE o_orderkey % 7 = 0 UNION ALL SELECT '/none/' || node, node FROM ls WHERE o_orderkey % 70 = 0), held AS (SELECT lower(path) AS k, list_sort(list(DISTINCT node)) AS nodes FROM ls GROUP BY 1) SELECT path, wanted.node AS node, CASE WHEN nodes IS NULL THEN NULL WHEN list_contains(nodes, wanted.node) THEN wanted.node WHEN len(nodes) = 1 THEN nodes[1] END AS found_node, CASE WHEN nodes IS NULL THEN 'not_found' WHEN list_contains(nodes, wanted.node) THEN 'handle' WHEN len(nodes) = 1 THEN 'name' ELSE 'ambiguous' END AS how FROM wanted LEFT JOIN held ON lower(path) = k")
def resolve_paths(spark, d):
    entries = listing(spark, d)
    key = F.col("node").cast("long")
    wanted = entries.where(key % 7 == 0).select(F.upper("path").alias("path"), F.when(key % 2 == 0, F.col("node")).otherwise("0").alias("node"))
    wanted = wanted.unionByName(entries.where(key % 70 == 0).select(F.concat(F.lit("/none/"), "node").alias("path"), "node"))
    return filters.resolve_paths(wanted, entries)


@query("presence", f"WITH {LS} SELECT kind, n FROM (SELECT 'orders' AS kind, count(*) FILTER (WHERE starts_with(path, '/c1/') OR starts_with(path, '/c2/')) AS n FROM ls UNION ALL SELECT 'none', count(*) FILTER (WHERE starts_with(path, '/none/')) FROM ls)")
def presence(spark, d):
    return filters.present(listing(spark, d), {"orders": ["/C1/", "/C2/"], "none": ["/none/"]})


def _hashed(spark, d):
    docs = contents(spark, d)
    return hashing.digests(docs.where("body is not null").select(F.col("id").alias("node"), F.col("evidence").alias("evidence_id"), "body"), "body").drop("body")


_H = "h AS (SELECT doc_id AS node, source AS evidence_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL)"


@query("hash_documents", f"WITH {_H} SELECT * FROM h")
def hash_documents(spark, d):
    return _hashed(spark, d)


@query("duplicate_documents", f"WITH {_H} SELECT node, sha256 FROM h WHERE sha256 IN (SELECT sha256 FROM h GROUP BY 1 HAVING count(DISTINCT evidence_id) > 1)")
def duplicate_documents(spark, d):
    return hashing.duplicates(_hashed(spark, d)).select("node", "sha256")


@query("duplicate_groups", f"WITH {_H}, g AS (SELECT sha256, count(*) AS n, count(DISTINCT evidence_id) AS n_across, list_sort(list(node))[1:100] AS nodes FROM h GROUP BY 1 HAVING count(DISTINCT evidence_id) > 1) SELECT sha256, n, n_across, array_to_string(nodes, ',') AS nodes FROM g")
def duplicate_groups(spark, d):
    groups = hashing.duplicate_groups(_hashed(spark, d))
    return groups.select("sha256", "n", "n_across", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ",").alias("nodes"))


def _sets(spark, d):
    docs = hashing.digests(contents(spark, d).where("body is not null and id % 5 = 0"), "body")
    sets = spark.sql("SELECT * FROM VALUES (1, 'bad', 'known_bad'), (2, 'good', 'known_good'), (3, 'look', 'notable') AS s(id, name, kind)")
    algo = F.element_at(F.array(F.lit("md5"), F.lit("sha1"), F.lit("sha256")), (F.col("id") % 3 + 1).cast("int"))
    digest = F.when(algo == "md5", F.col("md5")).when(algo == "sha1", F.col("sha1")).otherwise(F.col("sha256"))
    return sets, docs.select((F.col("id") % 3 + 1).cast("int").alias("set_id"), algo.alias("algo"), F.upper(digest).alias("digest"), F.concat(F.lit("doc "), "id").alias("label"))


_M = f"""{_H}, e AS (SELECT CAST(node % 3 + 1 AS INTEGER) AS set_id, ['md5','sha1','sha256'][node % 3 + 1] AS algo, CASE node % 3 WHEN 0 THEN md5 WHEN 1 THEN sha1 ELSE sha256 END AS digest, 'doc ' || node AS label FROM h WHERE node % 5 = 0),
u AS (SELECT node, 'md5' AS algo, md5 AS digest FROM h UNION ALL SELECT node, 'sha1', sha1 FROM h UNION ALL SELECT node, 'sha256', sha256 FROM h),
m AS (SELECT u.node, u.algo, u.digest, set_id, ['known_bad','known_good','notable'][set_id] AS kind, label FROM u JOIN e USING (algo, digest))"""


@query("hash_match", f"WITH {_M} SELECT * FROM m")
def hash_match(spark, d):
    return hashing.matches(_hashed(spark, d), *_sets(spark, d)).select("node", "algo", "digest", "set_id", "kind", "label")


@query("hash_match_precedence", f"WITH {_M} SELECT node, ['known_bad','notable','known_good'][min(CASE kind WHEN 'known_bad' THEN 1 WHEN 'notable' THEN 2 ELSE 3 END)] AS kind, count(*) AS matches FROM m GROUP BY node")
def hash_match_precedence(spark, d):
    return hashing.verdicts(hashing.matches(_hashed(spark, d), *_sets(spark, d)))


@query("match_counts", f"WITH {_M} SELECT kind, count(DISTINCT node) AS nodes FROM m GROUP BY kind")
def match_counts(spark, d):
    return hashing.match_counts(hashing.matches(_hashed(spark, d), *_sets(spark, d)))


@query("fuzzy_similar")
def fuzzy_similar(spark, d):
    docs = contents(spark, d).where("body is not null")
    hashed = docs.select(F.col("id").alias("node"), fuzzy.fuzzy(F.col("body").cast("binary")).alias("fuzzy"), F.sha2("body", 256).alias("sha256"))
    return similar.summary(hashed)


def _two_listings(spark, d):
    entries = listing(spark, d).select("path", "name", "size", "modified", "created", "accessed", "deleted", "node")
    key = F.col("node").cast("long")
    before = entries.where(key % 10 != 1)
    after = entries.where(key % 10 != 2).withColumn("size", F.when(key % 10 == 3, F.col("size") + 1).otherwise(F.col("size"))).withColumn("accessed", F.when(key % 20 == 4, F.lit(None)).otherwise(F.col("accessed")))
    return before, after


_D = f"""WITH {LS}, a AS (SELECT * FROM ls WHERE o_orderkey % 10 <> 1), b AS (SELECT * REPLACE (CASE WHEN o_orderkey % 10 = 3 THEN size + 1 ELSE size END AS size, CASE WHEN o_orderkey % 20 = 4 THEN NULL ELSE accessed END AS accessed) FROM ls WHERE o_orderkey % 10 <> 2),
x AS (SELECT coalesce(b.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.size IS DISTINCT FROM b.size OR a.accessed IS DISTINCT FROM b.accessed THEN 'changed' ELSE 'unchanged' END AS status,
  CASE WHEN a.path IS NULL OR b.path IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.size IS DISTINCT FROM b.size THEN 'size' END, CASE WHEN a.accessed IS DISTINCT FROM b.accessed THEN 'accessed' END) END AS changes FROM a FULL JOIN b ON a.path = b.path)"""


@query("listing_diff", f"{_D} SELECT * FROM x")
def listing_diff(spark, d):
    return diff.listing_diff(*_two_listings(spark, d)).withColumn("changes", F.array_join("changes", ","))


@query("listing_diff_counts", f"{_D} SELECT status, count(*) AS n FROM x GROUP BY status")
def listing_diff_counts(spark, d):
    return diff.diff_counts(diff.listing_diff(*_two_listings(spark, d)))


@query("first_by_key", "SELECT l_partkey, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS l_orderkey, arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS l_linenumber FROM lineitem GROUP BY l_partkey")
def first_by_key(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return diff.first_by_key(lines, ["l_partkey"], ["l_orderkey", "l_linenumber"])


def _spans(spark, d):
    lines = table(spark, d, "lineitem")
    start = F.col("l_partkey") * 8 + F.col("l_linenumber")
    return lines.select((F.col("l_suppkey") % 20).alias("evidence_id"), start.cast("long").alias("start"), (start + F.col("l_quantity")).cast("long").alias("end"))


_S = "s AS (SELECT l_suppkey % 20 AS evidence_id, CAST(l_partkey * 8 + l_linenumber AS BIGINT) AS start, CAST(l_partkey * 8 + l_linenumber + l_quantity AS BIGINT) AS \"end\" FROM lineitem)"
_MERGED = f"""{_S}, o AS (SELECT *, max("end") OVER (PARTITION BY evidence_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE start < "end"),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY evidence_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM o),
m AS (SELECT evidence_id, min(start) AS start, max("end") AS "end", count(*) AS n FROM i GROUP BY evidence_id, island)"""


@query("interval_merge", f"WITH {_MERGED} SELECT * FROM m")
def interval_merge(spark, d):
    return intervals.merge(_spans(spark, d), ["evidence_id"])


@query("interval_gaps", f"""WITH {_MERGED}, z AS (SELECT DISTINCT evidence_id, 16500::BIGINT AS size FROM s), e AS (SELECT evidence_id, least(start, size) AS start, least("end", size) AS "end" FROM m JOIN z USING (evidence_id) UNION ALL SELECT evidence_id, size, size FROM z),
g AS (SELECT evidence_id, coalesce(max("end") OVER (PARTITION BY evidence_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, start AS "end" FROM e) SELECT * FROM g WHERE "end" - start >= 4""")
def interval_gaps(spark, d):
    spans = _spans(spark, d)
    return intervals.gaps(spans, spans.select("evidence_id").distinct().withColumn("size", F.lit(16500).cast("long")), ["evidence_id"], 4)


@query("interval_contains", f"WITH {_MERGED} SELECT event_id, user_id % 20 AS evidence_id, CAST(event_id * 7 % 16500 AS BIGINT) AS \"offset\" FROM events WHERE EXISTS (SELECT 1 FROM m WHERE m.evidence_id = user_id % 20 AND event_id * 7 % 16500 >= m.start AND event_id * 7 % 16500 < m.\"end\")")
def interval_contains(spark, d):
    points = table(spark, d, "events").select("event_id", (F.col("user_id") % 20).alias("evidence_id"), (F.col("event_id") * 7 % 16500).alias("offset"))
    return intervals.contained(points, intervals.merge(_spans(spark, d), ["evidence_id"]), ["evidence_id"], bin_size=1024)


@query("containment", f"""WITH {_S}, h AS (SELECT DISTINCT evidence_id, start AS "offset", "end" - start AS length FROM s)
SELECT a.* FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.evidence_id = a.evidence_id AND b."offset" <= a."offset" AND b."offset" + b.length >= a."offset" + a.length AND b.length > a.length)""")
def containment(spark, d):
    hits = _spans(spark, d).select("evidence_id", F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length")).distinct()
    return intervals.drop_contained(hits, ["evidence_id"])


@query("single_gap", f"""WITH {_S}, h AS (SELECT DISTINCT evidence_id, start - 20 AS start, "end" + 20 AS "end" FROM s WHERE start % 50 = 0), a AS (SELECT DISTINCT evidence_id, start AS gs, start + 5 AS ge FROM s WHERE start % 9 = 0)
SELECT h.evidence_id, h.start, h."end", min(gs) AS gap_start, min(ge) AS gap_end FROM h JOIN a ON a.evidence_id = h.evidence_id AND gs > h.start AND gs < h."end" GROUP BY ALL HAVING count(*) = 1 AND min(ge) < h."end" """)
def single_gap(spark, d):
    spans = _spans(spark, d)
    hits = spans.where("start % 50 = 0").select("evidence_id", (F.col("start") - 20).alias("start"), (F.col("end") + 20).alias("end")).distinct()
    taken = spans.where("start % 9 = 0").select("evidence_id", "start", (F.col("start") + 5).alias("end")).distinct()
    return intervals.single_gap(hits, taken, ["evidence_id"], 4096)


@query("next_header_bound", f"""WITH {_S}, h AS (SELECT DISTINCT evidence_id, start AS "offset" FROM s), n AS (SELECT *, lead("offset") OVER (PARTITION BY evidence_id ORDER BY "offset") - "offset" AS nx FROM h)
SELECT evidence_id, "offset", least(coalesce(nx, 40), 40) AS length, CASE WHEN nx < 40 THEN 'next_header' ELSE 'limit' END AS bounded_by FROM n""")
def next_header_bound(spark, d):
    hits = _spans(spark, d).select("evidence_id", F.col("start").alias("offset"), F.lit(40).cast("long").alias("max_length")).distinct()
    return intervals.bounds_by_next(hits, ["evidence_id"]).drop("max_length")


@query("entropy_documents", "WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, length(text)::DOUBLE AS n FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, ch, count(*)::DOUBLE / any_value(n) AS p FROM c GROUP BY ALL), e AS (SELECT doc_id, -sum(p * log2(p)) AS h FROM k GROUP BY 1) SELECT doc_id, round(coalesce(h, 0.0) + 0.0, 6) AS entropy, CASE WHEN coalesce(round(h, 6), 0) < 1 THEN 'constant' WHEN round(h, 6) < 4.5 THEN 'sparse' WHEN round(h, 6) < 6 THEN 'text' WHEN round(h, 6) < 7.2 THEN 'structured' WHEN round(h, 6) < 7.9 THEN 'compressed' ELSE 'random' END AS band FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) LEFT JOIN e USING (doc_id)")
def entropy_documents(spark, d):
    docs = contents(spark, d).where("body is not null")
    h = F.round(detect.char_entropy(F.col("body")), 6)
    return docs.select(F.col("id").alias("doc_id"), h.alias("entropy"), detect.entropy_band(h).alias("band"))


@query("block_class")
def block_class(spark, d):
    docs = contents(spark, d).where("body is not null")
    return docs.select(F.col("id").alias("doc_id"), detect.block_class(F.col("body").cast("binary")).alias("b")).select("doc_id", "b.class", F.round("b.entropy", 6).alias("entropy"))


@query("type_census", "SELECT verdict, detected, count(*) AS n FROM (SELECT CASE WHEN html LIKE '<!doctype html%' OR html LIKE '<html%' OR html LIKE '<!DOCTYPE html%' THEN 'html' END AS detected, CASE page_id % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'mismatch' ELSE 'no_extension' END AS verdict FROM pages) GROUP BY ALL")
def type_census(spark, d):
    pages = table(spark, d, "pages")
    extension = F.element_at(F.array(F.lit("html"), F.lit("png"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int"))
    judged = pages.select(detect.type_verdict(extension, F.substring(F.col("html").cast("binary"), 1, 4096), F.length("html")).alias("v"))
    return judged.groupBy("v.verdict", "v.detected").agg(F.count("*").alias("n"))


@query("wallet_candidates", "SELECT doc_id, unnest(list_distinct(regexp_extract_all(text || ' 1BoatSLRHtKNngkdXEeobR76b53LETtpyT bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4', '\\b(?:[13][1-9A-HJ-NP-Za-km-z]{25,34}|(?:bc|tb)1[02-9ac-hj-np-z]{11,71}|0x[0-9a-fA-F]{40})\\b'))) AS address FROM documents")
def wallet_candidates(spark, d):
    said = F.concat("body", F.lit(" 1BoatSLRHtKNngkdXEeobR76b53LETtpyT bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"))
    return contents(spark, d).select(F.col("id").alias("doc_id"), F.explode(detect.wallet_candidates(said)).alias("address"))


@query("wallet_checked")
def wallet_checked(spark, d):
    said = F.concat("body", F.lit(" 1BoatSLRHtKNngkdXEeobR76b53LETtpyT bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"))
    found = contents(spark, d).select(F.col("id").alias("doc_id"), F.explode(detect.wallet_kinds(detect.wallet_candidates(said))).alias("w"))
    return found.select("doc_id", "w.address", "w.kind")


@query("layered_overlay", "SELECT l_partkey, l_linenumber % 3 AS sub, min(l_suppkey % 4) AS layer, arg_min(l_orderkey, (l_suppkey % 4, l_orderkey)) AS l_orderkey FROM lineitem GROUP BY ALL")
def layered_overlay(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey", (F.col("l_linenumber") % 3).alias("sub"), (F.col("l_suppkey") % 4).alias("layer"), "l_orderkey")
    one = lines.groupBy("l_partkey", "sub", "layer").agg(F.min("l_orderkey").alias("l_orderkey"))
    return artefacts.overlay(one, ["l_partkey", "sub"])


@query("raid_address", "WITH b AS (SELECT event_id AS block, event_id // 16 AS stripe FROM events) SELECT block, stripe // 3 AS \"row\", CAST((3 - stripe // 3 % 4 + 1 + stripe % 3) % 4 AS INTEGER) AS member, stripe // 3 * 16 + block % 16 AS member_block FROM b")
def raid_address(spark, d):
    blocks = table(spark, d, "events").select(F.col("event_id").alias("block"))
    return artefacts.raid_address(blocks, 4, 16)


@query("parity_mismatch", "SELECT l_orderkey, bit_xor(l_partkey) AS parity FROM lineitem GROUP BY 1 HAVING bit_xor(l_partkey) <> 0")
def parity_mismatch(spark, d):
    return artefacts.parity_mismatch(table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("word")), ["l_orderkey"])


@query("string_functions", "SELECT p_partkey, translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') AS turned, CASE WHEN p_partkey % 2 = 0 THEN '''=' || p_brand ELSE p_brand END AS safe, lower(string_split(p_brand || '.' || p_type, '.')[-1]) AS ext FROM part")
def string_functions(spark, d):
    p = table(spark, d, "part")
    cell = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("="), "p_brand")).otherwise(F.col("p_brand"))
    return p.select("p_partkey", X.rot13(F.col("p_name")).alias("turned"), X.csv_safe(cell).alias("safe"), X.extension_of_name(F.concat_ws(".", "p_brand", "p_type")).alias("ext"))


@query("epoch_functions", "SELECT event_id, epoch_us(ts) AS filetime_us, epoch_us(date_trunc('second', ts)) AS unix_us, epoch_us(ts) AS webkit_us FROM events")
def epoch_functions(spark, d):
    us = F.unix_micros(S.at_utc(F.col("ts")))
    e = table(spark, d, "events")
    back = F.unix_micros
    return e.select(
        "event_id", back(S.from_filetime((us + S.FILETIME_EPOCH_US).cast("decimal(20,0)") * 10 + 7)).alias("filetime_us"), back(S.from_unix(F.floor(us / 1_000_000))).alias("unix_us"), back(S.from_webkit(us + S.FILETIME_EPOCH_US)).alias("webkit_us")
    )


_VM = f"""{_S}, x AS (SELECT evidence_id, 'Block' AS family, start % 3 AS kind, start AS number, start, "end" FROM s),
i AS (SELECT *, start < "end" AND "end" <= 15000 AS fits FROM x), d AS (SELECT evidence_id, count(*) FILTER (WHERE NOT fits) AS dropped FROM i GROUP BY 1),
o AS (SELECT DISTINCT evidence_id, family, kind, number, start, "end" FROM i WHERE fits),
n AS (SELECT *, CASE WHEN kind = lag(kind) OVER w AND start <= lag("end") OVER w THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY evidence_id ORDER BY start, "end")),
r AS (SELECT *, sum(new) OVER (PARTITION BY evidence_id ORDER BY start, "end") AS run FROM n),
m AS (SELECT evidence_id, run, any_value(kind) AS kind, min(number) AS first_number, max(number) AS last_number, min(start) AS start, max("end") AS "end" FROM r GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY start, "end") AS rn, count(*) OVER (PARTITION BY evidence_id) AS total FROM m)
SELECT evidence_id, kind, first_number, last_number, start, "end", total, dropped FROM p JOIN d USING (evidence_id) WHERE rn <= 192"""


@query("volume_map", f"WITH {_VM.lstrip()}")
def volume_map(spark, d):
    raw = _spans(spark, d)
    every = raw.select("evidence_id", F.lit("Block").alias("family"), (F.col("start") % 3).alias("kind"), F.col("start").alias("number"), "start", "end")
    good = every.where("start < end and end <= 15000").distinct()
    bad = every.where("not (start < end and end <= 15000)")
    sizes = raw.select("evidence_id").distinct().withColumn("size", F.lit(15000).cast("long"))
    return intervals.volume_map(good.unionByName(bad), sizes, ["evidence_id"]).select("evidence_id", "kind", "first_number", "last_number", "start", "end", "total", "dropped")


@query("latest_usable", "SELECT l_partkey, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS l_quantity, max(l_orderkey * 10 + l_linenumber) AS sequence FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_partkey")
def latest_usable(spark, d):
    v = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sequence"))
    return artefacts.latest_usable(v, ["l_partkey"], F.col("l_returnflag") != "R").select("l_partkey", "l_quantity", "sequence")
