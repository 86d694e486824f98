"""Triage rules over a whole case, and where members of mirrored and striped sets disagree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import artefacts, timeline, triage
from ..operators.scratch import tasks_for
from .base import EV, query, table
from .base import timeline as events_of

# A part is a volume, a line a journal record of its part, a customer a hive and each of its orders a section.
_CASE = """vol AS (SELECT p_size AS evidence_id, p_partkey AS part, p_partkey % 7 <> 0 AS allocated, p_partkey % 11 = 0 AS container, ['NTFS','BitLocker','LUKS','ext4'][p_partkey % 5] AS detected, p_partkey % 3 = 0 AS unlocked, p_partkey * 4096 AS size FROM part),
jour AS (SELECT p_size AS evidence_id, p_partkey AS part, p_partkey % 4 <> 1 AS "read", p_partkey % 9 // 7 AS resyncs FROM part WHERE p_partkey % 10 < 8),
rec AS (SELECT l_partkey AS part, count(*) AS records, count(*) FILTER (l_returnflag = 'R') AS deleted FROM lineitem GROUP BY 1),
hive AS (SELECT c_custkey AS hive_id, c_nationkey AS evidence_id, CASE WHEN c_custkey % 13 > 0 THEN 'C:\\' || CASE WHEN c_custkey % 2 = 0 THEN 'Users\\' ELSE '' END || c_name || '\\hive' END AS hive, ['NTUSER','SYSTEM','SOFTWARE','USRCLASS'][c_custkey % 4 + 1] AS kind, c_custkey % 17 = 0 AS unreadable, c_custkey % 34 = 0 AS empty, c_mktsegment AS note, c_custkey * 512 AS size FROM customer),
sec AS (SELECT o_custkey AS hive_id, ['Time zone','Networks joined','Local accounts','Services','Mounted devices'][o_orderkey % 5 + 1] AS section, o_orderkey % 4 AS n FROM orders)"""


def _picked(names, at):
    return F.try_element_at(F.array(*map(F.lit, names)), at.cast("int"))


def _volumes(spark, d):
    key = F.col("p_partkey")
    kind = F.when(key % 5 > 0, _picked(("NTFS", "BitLocker", "LUKS", "ext4"), F.greatest(key % 5, F.lit(1))))
    return table(spark, d, "part").select(F.col("p_size").alias("evidence_id"), key.alias("part"), (key % 7 != 0).alias("allocated"), (key % 11 == 0).alias("container"), kind.alias("detected"), (key % 3 == 0).alias("unlocked"), (key * 4096).alias("size"))


def _hives(spark, d):
    key = F.col("c_custkey")
    path = F.concat(F.lit("C:\\"), F.when(key % 2 == 0, "Users\\").otherwise(""), "c_name", F.lit("\\hive"))
    return table(spark, d, "customer").select(
        key.alias("hive_id"), F.col("c_nationkey").alias("evidence_id"), F.when(key % 13 > 0, path).alias("hive"), _picked(("NTUSER", "SYSTEM", "SOFTWARE", "USRCLASS"), key % 4 + 1).alias("kind"),
        (key % 17 == 0).alias("unreadable"), (key % 34 == 0).alias("empty"), F.col("c_mktsegment").alias("note"), (key * 512).alias("size"),
    )


def _sections(spark, d):
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("hive_id"), _picked(("Time zone", "Networks joined", "Local accounts", "Services", "Mounted devices"), key % 5 + 1).alias("section"), (key % 4).alias("n"))


@query(
    "triage_rules",
    f"""WITH {_CASE}, own AS (SELECT * FROM vol WHERE allocated AND NOT container),
    enc AS (SELECT count(*) AS n, count(*) FILTER (NOT unlocked) AS locked FROM own WHERE detected IN ('BitLocker','LUKS')),
    unk AS (SELECT count(*) AS n, sum(size) AS size FROM own WHERE detected IS NULL), gap AS (SELECT count(*) AS n, sum(size) AS size FROM vol WHERE NOT allocated),
    bad AS (SELECT count(*) AS hives, count(*) FILTER (unreadable AND NOT empty) AS bad FROM hive),
    ok AS (SELECT count(*) AS n FROM sec JOIN hive USING (hive_id) WHERE NOT unreadable AND n > 0),
    scan AS (SELECT sum(s_suppkey * 100) AS checked FROM supplier), mis AS (SELECT count(*) AS n, count(*) FILTER (p_size < 10) AS high FROM part),
    j AS (SELECT jour.*, coalesce(records, 0) AS records, coalesce(deleted, 0) AS deleted FROM jour JOIN vol USING (part) LEFT JOIN rec USING (part) WHERE allocated AND detected = 'NTFS')
    SELECT CASE WHEN locked > 0 THEN 'high' ELSE 'info' END AS severity, 'encrypted' AS kind, false AS not_run, CAST(NULL AS BIGINT) AS evidence_id, CAST(NULL AS BIGINT) AS part, n, locked AS grave, CAST(NULL AS BIGINT) AS measure, 'unlock' AS action FROM enc WHERE n > 0
    UNION ALL SELECT 'medium', 'unreadable', false, NULL, NULL, n, NULL, size, NULL FROM unk WHERE n > 0
    UNION ALL SELECT 'info', 'unallocated', false, NULL, NULL, n, NULL, size, 'index' FROM gap WHERE size > 0
    UNION ALL SELECT CASE WHEN high > 0 THEN 'high' ELSE 'info' END, 'filetype', false, NULL, NULL, n, high, checked, 'filetypes' FROM mis, scan
    UNION ALL SELECT CASE WHEN resyncs > 0 THEN 'medium' ELSE 'info' END, 'usn', false, evidence_id, part, records, deleted, resyncs, 'usn' FROM j WHERE "read"
    UNION ALL SELECT 'info', 'usn', true, evidence_id, part, NULL, NULL, NULL, 'usn' FROM j WHERE NOT "read"
    UNION ALL SELECT CASE WHEN bad > 0 THEN 'medium' ELSE 'info' END, 'registry', false, NULL, NULL, n, bad, hives, 'registry' FROM bad, ok
    UNION ALL SELECT 'info', 'tagged', false, NULL, NULL, count(*), NULL, NULL, 'tags' FROM events
    UNION ALL SELECT 'info', 'hashsets', true, NULL, NULL, NULL, NULL, NULL, 'hashes' FROM (SELECT count(*) AS k FROM supplier WHERE s_suppkey < 0) WHERE k = 0
    UNION ALL SELECT 'info', 'index', true, NULL, NULL, NULL, NULL, NULL, 'index' FROM (SELECT count(*) AS k FROM nation WHERE n_nationkey < 0) WHERE k = 0""",
)
def triage_rules(spark, d):
    key = F.col("p_partkey")
    parts = table(spark, d, "part")
    journals = parts.where(key % 10 < 8).select(F.col("p_size").alias("evidence_id"), key.alias("part"), (key % 4 != 1).alias("read"), F.floor(key % 9 / 7).alias("resyncs"))
    reasons = F.when(F.col("l_returnflag") == "R", F.array(F.lit("deleted"), F.lit("closed"))).otherwise(F.array(F.lit("created")))
    records = table(spark, d, "lineitem").join(parts.select("p_partkey", "p_size"), F.col("l_partkey") == key).select(F.col("p_size").alias("evidence_id"), F.col("l_partkey").alias("part"), reasons.alias("reasons"))
    return triage.findings(
        _volumes(spark, d), table(spark, d, "supplier").select((F.col("s_suppkey") * 100).alias("checked")), parts.select(F.when(F.col("p_size") < 10, "high").otherwise("info").alias("severity")), journals, records, _hives(spark, d), _sections(spark, d),
        table(spark, d, "supplier").where("s_suppkey < 0"), table(spark, d, "events"), table(spark, d, "nation").where("n_nationkey < 0"),
    )


@query(
    "registry_items",
    f"""WITH {_CASE}, held AS (SELECT CASE WHEN kind IN ('NTUSER','USRCLASS') AND hive LIKE 'C:\\Users\\%' THEN kind || ' (' || split_part(hive, '\\', 3) || ')' ELSE kind END AS hive, evidence_id, section, n FROM sec JOIN hive USING (hive_id) WHERE NOT unreadable AND n > 0)
    SELECT CASE WHEN empty THEN 2 ELSE 0 END AS place, coalesce(hive, '(unnamed hive)') AS hive, evidence_id, CASE WHEN empty THEN 'allocated but never written' ELSE 'would not parse' END AS section, note, size AS n FROM hive WHERE unreadable
    UNION ALL SELECT 1, hive, evidence_id, section, NULL, n FROM held WHERE section IN ('Networks joined','Local accounts')""",
)
def registry_items(spark, d):
    return triage.registry_items(_hives(spark, d), _sections(spark, d))


# A supplier is a mirrored set, a line a sector of one of three members; its copies differ where the quantity says so.
_SETS = """sec AS (SELECT l_suppkey AS "set", (l_orderkey * 8 + l_linenumber) * 512 AS start, m AS member, l_orderkey * CASE WHEN l_quantity % (m * 7 + 4) = 1 AND m > 0 THEN -1 ELSE 1 END AS content
  FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2, 3), (VALUES (0), (1), (2)) v(m)),
dif AS (SELECT s."set", s.start, s.member FROM sec s JOIN sec b ON s."set" = b."set" AND s.start = b.start AND b.member = 0 WHERE s.member > 0 AND s.content <> b.content),
isl AS (SELECT "set", start, start - 512 * row_number() OVER (PARTITION BY "set" ORDER BY start) AS g FROM (SELECT DISTINCT "set", start FROM dif)),
rng AS (SELECT "set", min(start) AS start, max(start) + 512 AS "end" FROM isl GROUP BY "set", g)"""


def _sectors(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q")).withColumn("member", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    wrong = (F.col("q") % (F.col("member") * 7 + 4) == 1) & (F.col("member") > 0)
    return lines.select(F.col("l_suppkey").alias("set"), "member", ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 512).alias("offset"), F.lit(512).cast("long").alias("length"), (F.col("l_orderkey") * F.when(wrong, -1).otherwise(1)).alias("content"))


@query("mirror_ranges", f"""WITH {_SETS} SELECT * FROM rng""")
def mirror_ranges(spark, d):
    return artefacts.mirror_ranges(_sectors(spark, d), F.col("member") == 0, ["set"])[0]


@query(
    "mirror_summary",
    f"""WITH {_SETS} SELECT b."set", count(*) * 512 AS compared_bytes, coalesce(any_value(r.k), 0) AS differing_ranges, coalesce(any_value(r.bytes), 0) AS differing_bytes, coalesce(any_value(m.members), '') AS differing_members
    FROM sec b LEFT JOIN (SELECT "set", count(*) AS k, sum("end" - start) AS bytes FROM rng GROUP BY 1) r ON r."set" = b."set" LEFT JOIN (SELECT "set", string_agg(DISTINCT member, ',' ORDER BY member) AS members FROM dif GROUP BY 1) m ON m."set" = b."set" WHERE b.member = 0 GROUP BY 1""",
)
def mirror_summary(spark, d):
    told = artefacts.mirror_ranges(_sectors(spark, d), F.col("member") == 0, ["set"])[1]
    return told.withColumn("differing_members", F.array_join(F.transform("differing_members", lambda m: m.cast("string")), ","))


# An order is a row of a set of three members, its customer the set, its lines the words.
@query(
    "parity_ranges",
    """WITH bad AS (SELECT DISTINCT o_custkey AS "set", o_orderkey AS row FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, l_linenumber % 2 HAVING bit_xor(l_partkey % 4) <> 0),
    isl AS (SELECT *, row - row_number() OVER (PARTITION BY "set" ORDER BY row) AS g FROM bad)
    SELECT "set", min(row) * 8192 AS start, (max(row) + 1) * 8192 AS "end", count(*) AS n FROM isl GROUP BY "set", g""",
)
def parity_ranges(spark, d):
    lines = table(spark, d, "lineitem")
    tasks = tasks_for(lines)
    lines = lines.repartition(tasks, "l_orderkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey").repartition(tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    words = lines.select(F.col("o_custkey").alias("set"), F.col("o_orderkey").alias("row"), (F.col("l_linenumber") % 2).alias("at"), (F.col("l_partkey") % 4).alias("word"))
    return artefacts.parity_ranges(words, 4096, 3, ["set"], tasks)


@query("newest_by_log", f"""WITH {EV} SELECT count(*) OVER (PARTITION BY log) AS total, least(50, count(*) OVER (PARTITION BY log)) - row_number() OVER (PARTITION BY log ORDER BY sort DESC, id DESC) + 1 AS rank, log, id, sort, action FROM ev QUALIFY row_number() OVER (PARTITION BY log ORDER BY sort DESC, id DESC) <= 50""")
def newest_by_log(spark, d):
    return timeline.newest_by(events_of(spark, d).select("log", "id", "sort", "action"), "log", ["sort", "id"], 50)
