"""Queries over replayed logs, layers, bounds and budgets; orders and their lines stand in for entries and pages."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import artefacts, carving, replay, search, timelinestore
from ..operators.scratch import cut, shared_dir
from .base import EV, query, table, timeline
from .file_queries import _S, _spans
from .media_queries import _blocks, _sizes

# A customer is a hive, an order an entry of one of two logs, a line a page.  Some sequences repeat, some are missing.
_LOGS = """ent AS (SELECT o_custkey AS hive, o_orderkey % 2 AS log, o_orderkey AS "position", 40000 + o_orderkey % 100 AS log_size, (o_orderkey % 3 + rn * 9) // 8 AS sequence, 20000 + (o_orderkey % 13) * 4096 AS hbins_size
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)),
hives AS (SELECT c_custkey AS hive, 1 + CASE WHEN c_custkey % 9 > 0 THEN 1 ELSE 0 END AS "primary", 1 AS secondary, 30000 + (c_custkey % 7) * 4096 AS size FROM customer),
pg AS (SELECT o_custkey AS hive, o_orderkey % 2 AS log, o_orderkey AS "position", l_linenumber AS page, (l_partkey % 64) * 512 AS "offset", CAST(l_quantity AS BIGINT) * 32 AS length FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
first AS (SELECT * FROM ent QUALIFY row_number() OVER (PARTITION BY hive, sequence ORDER BY log, "position") = 1),
later AS (SELECT f.*, h.size, sequence - secondary - (row_number() OVER (PARTITION BY hive ORDER BY sequence) - 1) AS missing FROM first f JOIN hives h USING (hive) WHERE "primary" <> secondary AND sequence >= secondary),
run AS (SELECT * FROM later WHERE missing = 0),
wr AS (SELECT p.*, r.sequence, r.size, r.log_size FROM pg p JOIN run r USING (hive, log, "position")),
es AS (SELECT hive, count(*) AS applied, max(sequence) AS sequence_after, max(hbins_size + 4096) AS need, bool_or(hbins_size + 4096 > size + log_size) AS big FROM run GROUP BY 1),
ps AS (SELECT hive, count(*) AS pages, sum(length) AS bytes, max("offset" + length + 4096) AS reach, bool_or("offset" + length + 4096 > size + log_size) AS big FROM wr GROUP BY 1),
rep AS (SELECT h.*, n.entries, es.applied, es.sequence_after, es.need, ps.pages, ps.bytes, ps.reach, CASE WHEN "primary" = secondary THEN 'clean' WHEN n.entries IS NULL THEN 'no_entries' WHEN es.applied IS NULL THEN 'missing_start' WHEN coalesce(es.big, false) OR coalesce(ps.big, false) THEN 'oversize' ELSE 'replayed' END AS status
  FROM hives h LEFT JOIN (SELECT hive, count(DISTINCT sequence) AS entries FROM ent GROUP BY 1) n USING (hive) LEFT JOIN es USING (hive) LEFT JOIN ps USING (hive))"""


def _logs(spark, d):
    o, c, lines = (table(spark, d, n) for n in ("orders", "customer", "lineitem"))
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    key = F.col("o_orderkey")
    entries = o.select(F.col("o_custkey").alias("hive"), (key % 2).alias("log"), key.alias("position"), (key % 100 + 40000).alias("log_size"), F.floor((key % 3 + rn * 9) / 8).alias("sequence"), (key % 13 * 4096 + 20000).alias("hbins_size"))
    hives = c.select(F.col("c_custkey").alias("hive"), F.when(F.col("c_custkey") % 9 > 0, 2).otherwise(1).cast("long").alias("primary"), F.lit(1).cast("long").alias("secondary"), (F.col("c_custkey") % 7 * 4096 + 30000).alias("size"))
    pages = lines.join(o, lines["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("hive"), (key % 2).alias("log"), key.alias("position"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") % 64 * 512).alias("offset"), (F.col("l_quantity").cast("long") * 32).alias("length"))
    return hives, entries, pages


@query("log_replay_report", f"""WITH {_LOGS} SELECT hive, status, CASE WHEN status = 'replayed' THEN applied ELSE 0 END AS applied, CASE WHEN status = 'replayed' THEN sequence_after END AS sequence_after, CASE WHEN status = 'replayed' THEN entries - applied ELSE 0 END AS beyond_gap,
CAST(CASE WHEN status = 'replayed' THEN coalesce(pages, 0) ELSE 0 END AS BIGINT) AS pages, CAST(CASE WHEN status = 'replayed' THEN coalesce(bytes, 0) ELSE 0 END AS BIGINT) AS bytes, CASE WHEN status = 'replayed' THEN greatest(size, need, reach) ELSE size END AS size_after FROM rep""")
def log_replay_report(spark, d):
    return replay.replay_report(*_logs(spark, d))


@query("log_replay_ranges", f"""WITH {_LOGS}, w AS (SELECT hive, "offset" + 4096 AS a, "offset" + length + 4096 AS z, sequence, page FROM wr JOIN rep USING (hive) WHERE status = 'replayed' AND length > 0),
e AS (SELECT DISTINCT hive, unnest([a, z]) AS x FROM w), s AS (SELECT hive, x AS start, lead(x) OVER (PARTITION BY hive ORDER BY x) AS "end" FROM e),
l AS (SELECT s.hive, s.start, s."end", sequence, page, a FROM s JOIN w ON w.hive = s.hive AND a <= s.start AND z >= s."end" QUALIFY row_number() OVER (PARTITION BY s.hive, s.start ORDER BY sequence DESC, page DESC, a DESC) = 1),
n AS (SELECT *, CASE WHEN start = lag("end") OVER o AND sequence = lag(sequence) OVER o AND page = lag(page) OVER o AND a = lag(a) OVER o THEN 0 ELSE 1 END AS new FROM l WINDOW o AS (PARTITION BY hive ORDER BY start)),
r AS (SELECT *, sum(new) OVER (PARTITION BY hive ORDER BY start) AS run FROM n)
SELECT hive, min(start) AS start, max("end") AS "end", sequence, page, min(start) - a AS skip FROM r GROUP BY hive, run, sequence, page, a""")
def log_replay_ranges(spark, d):
    return replay.replayed_ranges(*_logs(spark, d))


# Suppliers are stores, lines of a part a stack of descriptors of its block.
_LAYERS = """lay AS (SELECT l_suppkey % 50 AS store, l_linenumber - 1 AS layer, (l_partkey % 200) * 16384 AS block, max(((l_partkey + l_orderkey % 3) % 200) * 16384) AS relative, max(l_orderkey * 16384) AS target,
  max(l_orderkey % 4) = 0 AS forwarder, max(l_orderkey % 5) > 1 AS overlay, max((l_orderkey * 2654435761) & 4294967295) AS bitmap FROM lineitem GROUP BY ALL)"""


@query("layered_blocks", f"""WITH RECURSIVE {_LAYERS}, subs AS (SELECT DISTINCT store, block, unnest(range(32)) AS sub FROM lay),
walk AS (
  SELECT store, block, sub, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS layer, CAST(NULL AS BIGINT) AS base FROM subs
  UNION ALL
  SELECT w.store, w.block, w.sub,
    CASE WHEN a.layer IS NULL THEN w.i + 1 WHEN a.forwarder THEN CASE WHEN b.layer IS NULL OR b.forwarder THEN -1 WHEN b.overlay AND (b.bitmap >> w.sub) & 1 = 0 THEN w.i + 2 ELSE -1 END WHEN a.overlay AND (a.bitmap >> w.sub) & 1 = 0 THEN w.i + 1 ELSE -1 END,
    CASE WHEN a.layer IS NULL THEN NULL WHEN a.forwarder THEN CASE WHEN b.layer IS NULL OR b.forwarder THEN NULL ELSE w.i + 1 END ELSE w.i END,
    CASE WHEN a.layer IS NULL THEN NULL WHEN a.forwarder THEN CASE WHEN b.layer IS NULL OR b.forwarder THEN w.block ELSE b.target END ELSE a.target END
  FROM walk w LEFT JOIN lay a ON a.store = w.store AND a.block = w.block AND a.layer = w.i LEFT JOIN lay b ON a.forwarder AND b.store = w.store AND b.block = a.relative AND b.layer = w.i + 1
  WHERE w.i >= 0 AND w.i < 7
), ends AS (SELECT store, block, sub, CASE WHEN i < 0 THEN layer END AS layer, CASE WHEN i < 0 THEN base ELSE block END AS base FROM walk WHERE i < 0 OR i >= 7)
SELECT store, block, CAST(layer AS INTEGER) AS layer, base, CAST(bit_or(CAST(1 AS BIGINT) << sub) AS BIGINT) AS mask FROM ends GROUP BY store, block, layer, base""")
def layered_blocks(spark, d):
    key = F.col("l_orderkey")
    rows = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("store"), (F.col("l_linenumber") - 1).cast("int").alias("layer"), (F.col("l_partkey") % 200 * 16384).alias("block"))
    layers = rows.agg(F.max((F.col("l_partkey") + key % 3) % 200 * 16384).alias("relative"), F.max(key * 16384).alias("target"), (F.max(key % 4) == 0).alias("forwarder"), (F.max(key % 5) > 1).alias("overlay"), F.max((key * 2654435761).bitwiseAND(F.lit(4294967295))).alias("bitmap"))
    return replay.layered_blocks(layers, ["store"])


@query("carve_bounds", f"""WITH {_S}, h AS (SELECT DISTINCT evidence_id, 'k' || start % 3 AS name, start AS "offset", 20 + start % 50 AS cap, start % 2 = 0 AS sa, start % 5 > 0 AS sz FROM s), a AS (SELECT DISTINCT evidence_id, "end" AS x FROM s), z AS (SELECT DISTINCT evidence_id, "end" // 16 * 16 AS x FROM s),
n AS (SELECT *, lead("offset") OVER (PARTITION BY evidence_id, name ORDER BY "offset") - "offset" AS hd FROM h),
u AS (SELECT evidence_id, "offset" AS x, true AS hit, NULL::BIGINT AS sp, NULL::BIGINT AS ze, * EXCLUDE (evidence_id) FROM n UNION ALL BY NAME SELECT evidence_id, x, false AS hit, x AS sp FROM a UNION ALL BY NAME SELECT evidence_id, x, false AS hit, x AS ze FROM z),
m AS (SELECT *, min(sp) OVER f - x AS da, min(ze) OVER f - x AS dz FROM u WINDOW f AS (PARTITION BY evidence_id ORDER BY x RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
b AS (SELECT evidence_id, name, "offset", list_min(list_filter([{{'l': hd, 'r': 0}}, {{'l': CASE WHEN sa THEN da END, 'r': 1}}, {{'l': CASE WHEN sz THEN dz END, 'r': 2}}, {{'l': cap, 'r': 3}}], lambda q: q.l IS NOT NULL)) AS q FROM m WHERE hit)
SELECT evidence_id, name, "offset", CASE WHEN q.l > 0 THEN q.l ELSE 0 END AS length, CASE WHEN q.l > 0 THEN ['next_header', 'allocated', 'empty_sector', 'limit'][q.r + 1] ELSE 'none' END AS method FROM b""")
def carve_bounds(spark, d):
    s, start = _spans(spark, d), F.col("start")
    hits = s.select("evidence_id", F.concat(F.lit("k"), start % 3).alias("name"), start.alias("offset"), (start % 50 + 20).alias("cap"), (start % 2 == 0).alias("stop_at_allocated"), (start % 5 > 0).alias("stop_at_zeros")).distinct()
    return carving.bounded(hits, s.select("evidence_id", F.col("end").alias("start")).distinct(), s.select("evidence_id", (F.floor(F.col("end") / 16) * 16).alias("at")).distinct())


_FEW = 3


@query("search_first_coverage", f"""WITH p AS (SELECT doc_id, string_split(ascii_low, 'license') AS parts FROM (SELECT doc_id, lower(text) AS ascii_low FROM documents WHERE length(text) > 0)),
o AS (SELECT doc_id, octet_length(encode(text)) AS size FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, len(parts) - 1 AS n, octet_length(encode(array_to_string(parts[1:{_FEW + 1}], 'license'))) AS stop FROM p)
SELECT doc_id AS evidence_id, CAST(least(n, {_FEW}) AS BIGINT) AS hits, n > {_FEW} AS truncated, CASE WHEN n > {_FEW} THEN stop ELSE size END AS complete_to FROM c JOIN o USING (doc_id)""")
def search_first_coverage(spark, d):
    return search.search_first(_blocks(spark, d), _sizes(spark, d), ["license"], _FEW, first=1 << 16, encodings=("ascii",))[1]


@query("related_to", """WITH b AS (SELECT DISTINCT user_id AS member, event_type || '/' || (event_id % 500) AS item FROM events)
SELECT a.member, r.member AS related, count(*) AS shared FROM b a JOIN b r ON a.item = r.item AND a.member <> r.member WHERE a.member % 100 = 0 GROUP BY ALL""")
def related_to(spark, d):
    """The members whose id is divisible by 100 against all."""
    held = table(spark, d, "events").select(F.col("user_id").alias("member"), F.concat_ws("/", "event_type", F.col("event_id") % 500).alias("item"))
    return artefacts.related_to(held, held.where("member % 100 = 0").select("member"))



@query("timeline_store_page", f"WITH {EV} SELECT id, sort, action, name FROM ev WHERE sort IS NOT NULL AND (sort > (SELECT quantile_disc(sort, 0.9) FROM ev)) ORDER BY sort, id LIMIT 500")
def timeline_store_page(spark, d):
    """A page near the end of the timeline, read from the files that its bounds name."""
    events = timeline(spark, d).select("id", "sort", "action", "name")
    path = f"{shared_dir(spark)}/timeline-{uuid.uuid4().hex}"
    timelinestore.append(events, path)
    start = events.selectExpr("percentile_disc(0.9) WITHIN GROUP (ORDER BY sort)").first()[0]
    page = cut(timelinestore.page(spark, path, "id long, sort double, action string, name string", (start, 2**63 - 1), 500))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return page
