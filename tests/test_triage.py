"""Triage rules on bare and odd cases, ranges of mirrors, runs that are ended, and newest events of streams."""

import random
import time

import pytest
from pyspark.sql import functions as F

from attesta.operators import artefacts, report, scratch, search, timeline, triage
from attesta.plans import triage_queries
from attesta.streaming import buckets

SHAPES = {
    "volumes": "evidence_id long, part long, allocated boolean, container boolean, detected string, unlocked boolean, size long", "scans": "checked long", "mismatches": "severity string",
    "journals": "evidence_id long, part long, read boolean, resyncs long", "records": "evidence_id long, part long, reasons array<string>",
    "hives": "hive_id long, evidence_id long, hive string, kind string, unreadable boolean, empty boolean, note string, size long", "sections": "hive_id long, section string, n long",
    "hash_sets": "id long", "tags": "id long", "indexes": "id long",
}


def case(spark, **rows):
    return {name: spark.createDataFrame(rows.get(name, []), shape) for name, shape in SHAPES.items()}


def told(df):
    return [tuple(r) for r in df.collect()]


def test_a_bare_case_tells_what_was_not_looked_for(spark):
    got = told(triage.findings(**case(spark)))
    assert [(s, k, nr) for s, k, nr, *_ in got] == [("info", "filetype", True), ("info", "hashsets", True), ("info", "index", True), ("info", "registry", True)]


def test_rules_of_odd_volumes_and_hives(spark):
    volumes = [
        (1, 0, True, None, "BitLocker", None, 10), (1, 10, True, False, "LUKS", True, 10), (1, 20, True, True, "BitLocker", False, 10), (1, 30, True, False, "", False, 7), (1, 40, None, None, None, None, 5),
        (1, 50, False, None, "NTFS", None, None), (2, 0, True, False, "NTFS", False, 9), (2, 9, True, False, "NTFS", False, 9), (2, 18, True, False, "NTFS", False, 9),
    ]
    hives = [(1, 1, "C:\\Users\\ann\\NTUSER.DAT", "NTUSER", None, None, None, 1), (2, 1, None, None, True, False, "short", 4096), (3, 1, "/x/SAM", "SAM", True, True, None, 8), (4, 1, "/Users", "NTUSER", False, None, None, 1)]
    held = case(
        spark, volumes=volumes, journals=[(2, 0, True, 3), (2, 0, True, 3), (2, 9, None, None), (1, 50, True, 0)], records=[(2, 0, ["deleted", "x"]), (2, 0, None), (2, 9, ["deleted"])],
        hives=hives, sections=[(1, "Services", 2), (1, "Local accounts", 0), (3, "Services", 9), (4, "Networks joined", 1), (9, "Services", 1)], tags=[(1,), (2,)], indexes=[(None,)], hash_sets=[(5,)], scans=[(None,)],
    )
    got = {(r["kind"], r["part"]): (r["severity"], r["not_run"], r["n"], r["grave"], r["measure"]) for r in triage.findings(**held).collect()}
    assert got == {
        ("encrypted", None): ("high", False, 2, 1, None), ("unreadable", None): ("medium", False, 1, None, 7), ("unallocated", None): ("info", False, 2, None, 5), ("filetype", None): ("info", False, 0, 0, 0),
        ("usn", 0): ("medium", False, 2, 1, 3), ("usn", 9): ("info", True, None, None, None), ("registry", None): ("medium", False, 2, 1, 4), ("tagged", None): ("info", False, 2, None, None),
    }
    items = [(r["place"], r["hive"], r["section"], r["n"]) for r in triage.registry_items(held["hives"], held["sections"]).collect()]
    assert items == [(0, "(unnamed hive)", "would not parse", 4096), (1, "NTUSER", "Networks joined", 1), (2, "/x/SAM", "allocated but never written", 8)]
    plain = triage.registry_items(held["hives"], held["sections"].where("hive_id <> 4"))
    assert [(r["hive"], r["section"]) for r in plain.where("place = 1").collect()] == [("NTUSER (ann)", "Services")]


def test_mirror_ranges_against_bytes(spark):
    rng = random.Random(2)
    base = rng.randbytes(512 * 40)
    copies = {1: bytearray(base), 2: bytearray(base)}
    for _ in range(12):
        copies[rng.choice((1, 2))][rng.randrange(len(base))] ^= 1
    rows = [(s, m, at, 512, bytes(raw[at : at + 512])) for s, sets in ((7, {0: base, **copies}), (8, {0: base, 1: base}), (9, {0: base[:512]})) for m, raw in sets.items() for at in range(0, len(raw), 512)]
    sectors = spark.createDataFrame(rows + [(7, 1, 1 << 20, 512, b"x")], "`set` long, member int, offset long, length long, content binary")
    ranges, summary = artefacts.mirror_ranges(sectors, F.col("member") == 0, ["set"])
    wrong = [at for at in range(0, len(base), 512) if any(c[at : at + 512] != base[at : at + 512] for c in copies.values())]
    want = []
    for at in wrong:
        if want and want[-1][1] == at:
            want[-1][1] = at + 512
        else:
            want.append([at, at + 512])
    assert sorted([r["start"], r["end"]] for r in ranges.collect()) == want
    assert {r["set"]: tuple(r)[1:] for r in summary.collect()} == {7: (len(base), len(want), 512 * len(wrong), [1, 2]), 8: (len(base), 0, 0, []), 9: (512, 0, 0, [])}
    assert summary.where("`set` < 0").count() == 0


def test_a_search_that_is_stopped_tells_how_far_it_came(spark):
    body = b"..ab" * 1024
    blocks = spark.createDataFrame([(e, at, body[at : at + 512]) for e in (1, 2) for at in range(0, len(body) if e == 1 else 512, 512)], "evidence_id long, offset long, data binary")
    sizes = spark.createDataFrame([(1, len(body)), (2, 512)], "evidence_id long, size long")
    asked = []
    rows, coverage = search.search_first(blocks, sizes, ["ab"], first=512, encodings=("ascii",), overlap=32, stop=lambda: len(asked) >= 2 or asked.append(1))
    assert {r["evidence_id"]: tuple(r)[1:] for r in coverage.collect()} == {1: (256, False, 1024), 2: (128, False, 512)}
    assert {r["offset"] for r in rows.where("evidence_id = 1").collect()} == set(range(2, 1024, 4))
    none, nowhere = search.search_first(blocks, sizes, ["ab"], first=512, stop=lambda: True)
    assert none.count() == 0
    assert {r["complete_to"] for r in nowhere.collect()} == {0}


def test_a_run_can_be_watched_and_ended(spark):
    def slow(batches):
        for batch in batches:
            time.sleep(0.3)
            yield batch

    run = report.Run(spark, lambda: spark.range(0, 200, 1, 200).mapInPandas(slow, "id long").count())
    deadline = time.time() + 60
    while run.progress().done < 3 and time.time() < deadline:
        time.sleep(0.1)
    run.cancel()
    with pytest.raises(Exception, match="(?i)cancel"):
        run.result(60)
    seen = run.progress()
    assert run.done()
    assert run.cancelled()
    assert 3 <= seen.done < 200 <= seen.tasks
    other = report.Run(spark, lambda: spark.range(10).count())
    assert other.result(60) == 10
    assert other.progress().done == other.progress().tasks > 0


def test_newest_of_a_stream_are_those_of_the_table(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.when(F.col("user_id") % 7 > 0, F.col("user_id") % 7).alias("log"), F.when(F.col("event_id") % 9 > 0, F.col("ts").cast("timestamp") + F.expr("interval 123 microseconds")).alias("ts"), "event_id", "event_type")
    e.orderBy(F.rand(3)).repartition(5).write.parquet(str(tmp_path / "in"))

    def drained(name, **more):
        live = buckets.newest_of_logs(buckets.follow(spark, str(tmp_path / "in"), e.schema, per_batch=1), 20, ["ts", "event_id"], **more)
        live.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        seen = [tuple(r) for r in spark.table(name).collect()]
        last = {}
        for row in seen:
            last[row[2]] = max(last.get(row[2], 0), row[0])
        return {row for row in seen if row[0] == last[row[2]]}

    want = {tuple(r) for r in timeline.newest_by(e, "log", ["ts", "event_id"], 20).collect()}
    assert len(want) == 140
    assert drained("newest") == want
    assert drained("newest_idle", time="ts", idle="4000 days") == want


def test_parity_ranges_are_dealt_by_rows(spark, monkeypatch):
    data = "/root/testdata/sf0.001"
    want = sorted(map(tuple, triage_queries.parity_ranges(spark, data).collect()))
    monkeypatch.setattr(scratch, "TASK_ROWS", 100)
    got = triage_queries.parity_ranges(spark, data)
    assert got.rdd.getNumPartitions() >= spark.read.parquet(f"{data}/lineitem.parquet").count() // 100
    assert sorted(map(tuple, got.collect())) == want
