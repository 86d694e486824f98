"""Scans over range partitions against plain loops, in many tasks on one group."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import carving, casebook, intervals, scan
from attesta.operators.scan import Ordered


@pytest.fixture
def ranges(spark):
    """Ranges that hold few rows, so one group spans several."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def table(spark, n, groups, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(groups), i, rng.choice([None, rng.randrange(100)])) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("groups", [["a"], ["a"] * 9 + [None, "b", "c"]])
def test_carry_against_loops(spark, ranges, ahead, groups):
    rows = table(spark, 300, groups)
    placed = Ordered(spark.createDataFrame(rows, "g string, at long, v long"), ["g"], ["at"])
    assert placed.df.select("_range").distinct().count() > 3
    got = placed.carry(ahead, s=("sum", F.col("v")), hi=("max", F.col("v")), lo=("min", F.col("v")), near=("near", F.col("v"))).rows()
    assert got.columns == ["g", "at", "v", "s", "hi", "lo", "near"]
    for g, at, v, s, hi, lo, near in got.collect():
        there = [(a, x) for k, a, x in rows if k == g and x is not None and (a > at if ahead else a < at)]
        values = [x for _, x in there]
        assert (s, hi, lo) == ((sum(values), max(values), min(values)) if values else (None, None, None))
        assert near == ((min(there) if ahead else max(there))[1] if there else None)
    assert got.count() == len(rows)


@pytest.mark.parametrize("few", [0, 100_000])
@pytest.mark.parametrize("ahead", [False, True])
def test_carry_within_against_loops(spark, ranges, monkeypatch, ahead, few):
    monkeypatch.setattr(scan, "FEW", few)
    rows = [(g, at, v, random.Random(at).choice([None, "x", "y"])) for g, at, v in table(spark, 300, ["a"] * 9 + [None, "b"])]
    got = Ordered(spark.createDataFrame(rows, "g string, at long, v long, k string"), ["g"], ["at"]).carry(ahead, within=("k",), s=("sum", F.col("v")), near=("near", F.col("v"))).rows().collect()
    for g, at, v, k, s, near in got:
        there = [(a, x) for h, a, x, j in rows if (h, j) == (g, k) and x is not None and (a > at if ahead else a < at)]
        assert s == (sum(x for _, x in there) if there else None)
        assert near == ((min(there) if ahead else max(there))[1] if there else None)
    assert len(got) == len(rows)


def test_bounds_place_headers_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(carving, "Ordered", lambda *a: made.append(a) or Ordered(*a))
    frames = [spark.createDataFrame(rows, t) for rows, t in (([(1, "a", 3, 9, True, True), (1, "b", 4, 9, True, True), (1, "a", 8, 9, True, True)], "evidence_id long, name string, offset long, cap long, stop_at_allocated boolean, stop_at_zeros boolean"), ([(1, 12)], "evidence_id long, start long"), ([(1, 10)], "evidence_id long, at long"))]
    got = sorted(map(tuple, carving.bounded(*frames).collect()))
    assert got == [(1, "a", 3, 5, "next_header"), (1, "a", 8, 2, "empty_sector"), (1, "b", 4, 6, "empty_sector")] and len(made) == 1


def brute_nested(rows, look_back):
    kept, out, evidence = [], [], object()
    for e, a, n, m in sorted(rows, key=lambda r: (r[0], r[1], -r[2])):
        if e != evidence:
            evidence, kept = e, []
        if any(k and x <= a and a + n <= y and y - x > n for x, y, k in kept):
            continue
        out.append((e, a, n, m))
        kept = [*kept, (a, a + n, m == "footer")][-look_back:]
    return sorted(out)


@pytest.mark.parametrize("look_back", [1, 3, 64])
@pytest.mark.parametrize("kind", ["nested", "chain", "one"])
def test_drop_nested_over_ranges(spark, ranges, look_back, kind):
    """Random nests, overlapping chains that hand their state on, and one hit that holds all the others."""
    rng = random.Random(look_back)
    if kind == "chain":
        rows = [(1, 10 * i, rng.choice([5, 15, 500]), rng.choice(["footer", "limit"])) for i in range(250)]
    elif kind == "one":
        rows = [(1, 0, 100_000, "footer")] + [(1, 7 * i + 1, 5, "footer") for i in range(300)] + [(2, 5, 5, "limit")]
    else:
        rows = [(rng.choice([1, 1, 1, 2]), rng.randrange(2000), rng.randrange(1, 300), rng.choice(["footer", "limit", "next_header"])) for _ in range(300)]
        rows = list({(e, a, n): (e, a, n, m) for e, a, n, m in rows}.values())
    hits = spark.createDataFrame(rows, "evidence_id long, offset long, length long, method string")
    assert sorted(tuple(r) for r in carving.drop_nested(hits, look_back).collect()) == brute_nested(rows, look_back)


def test_scans_without_rows(spark):
    assert carving.drop_nested(spark.createDataFrame([], "evidence_id long, offset long, length long, method string")).count() == 0
    assert casebook.audit_checks(spark.createDataFrame([], "seq long, prev_hash string, hash string, at string, examiner string, action string, detail string")).count() == 0


def test_one_chain_is_verified_in_many_tasks(spark, ranges):
    import hashlib

    rows, prev = [], ""
    for i in range(200):
        said = f"{prev}|t{i}|me|act|{i}"
        own = hashlib.sha256(said.encode()).hexdigest()
        rows.append((i, prev or None, own, f"t{i}", "me", "act", str(i) if i != 77 else "changed"))
        prev = own
    del rows[120]
    audit = spark.createDataFrame(rows, "seq long, prev_hash string, hash string, at string, examiner string, action string, detail string")
    checked = casebook.audit_checks(audit)
    assert checked.columns == [*audit.columns, "ok"]
    assert sorted(r["seq"] for r in checked.where("not ok").collect()) == [77, 121]
    assert "SinglePartition" not in checked.select("seq", "ok")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]


def test_next_header_of_one_evidence(spark, ranges):
    rng = random.Random(3)
    at = sorted(rng.sample(range(100_000), 300))
    got = intervals.bounds_by_next(spark.createDataFrame([(1, a, 400) for a in at], "evidence_id long, offset long, max_length long"), ["evidence_id"]).collect()
    want = {a: min(b - a, 400) if b else 400 for a, b in zip(at, [*at[1:], None], strict=True)}
    assert {r["offset"]: r["length"] for r in got} == want


def test_volume_map_of_one_evidence(spark, ranges):
    rng = random.Random(4)
    rows, at = [], 0
    for i in range(300):
        size = rng.randrange(1, 20)
        rows.append((1, rng.choice(["fs", "gap", None]), rng.choice(["a", None]), i, at, at + size))
        at += size + rng.choice([0, 0, 5])
    want = []
    for _, family, kind, number, start, end in rows:
        if want and want[-1][:2] == [family, kind] and start <= want[-1][5]:
            want[-1][3], want[-1][5] = number, end
        else:
            want.append([family, kind, number, number, start, end])
    spans = spark.createDataFrame(rows, "evidence_id long, family string, kind string, number long, start long, end long")
    got = intervals.volume_map(spans, spark.createDataFrame([(1, at)], "evidence_id long, size long"), ["evidence_id"], limit=100)
    told = [[r[c] for c in ("family", "kind", "first_number", "last_number", "start", "end")] for r in got.orderBy("start").collect()]
    assert told == want[:100] and {r["total"] for r in got.collect()} == {len(want)}
