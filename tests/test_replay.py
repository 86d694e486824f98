"""Log replay, layered blocks, carving bounds, budgeted search and related members against plain code."""

import random
import re
from collections import defaultdict

import pytest

from attesta.operators import artefacts, carving, replay, search


def brute_replay(hives, entries, pages):
    report, ranges = {}, []
    for hive, primary, secondary, size in hives:
        first = {}
        for h, log, position, log_size, sequence, hbins in sorted(entries):
            if h == hive:
                first.setdefault(sequence, (log, position, log_size, hbins))
        run, want = [], secondary
        while primary != secondary and want in first:
            run.append((want, *first[want]))
            want += 1
        own = defaultdict(list)
        for h, log, position, page, offset, length in sorted(pages):
            if h == hive:
                own[log, position].append((page, offset, length))
        status = "clean" if primary == secondary else "no_entries" if not first else "missing_start" if not run else "replayed"
        if any(4096 + hb > size + ls or any(4096 + o + n > size + ls for _, o, n in own[lg, p]) for _, lg, p, ls, hb in run):
            status = "oversize"
        if status != "replayed":
            report[hive] = (status, 0, None, 0, 0, 0, size)
            continue
        after = max([size, *(4096 + hb for *_, hb in run)])
        bytes_, n_pages, total = {}, 0, 0
        for sequence, lg, p, _, _ in run:
            for page, o, n in own[lg, p]:
                n_pages, total, after = n_pages + 1, total + n, max(after, 4096 + o + n)
                for i in range(n):
                    bytes_[4096 + o + i] = (sequence, page, i)
        report[hive] = ("replayed", len(run), run[-1][0], len(first) - len(run), n_pages, total, after)
        ranges += [(hive, at, *w) for at, w in bytes_.items()]
    return report, sorted(ranges)


def test_replay_against_bytes(spark):
    rng = random.Random(6)
    hives = [(h, 5 + (h % 5 > 0), 5, 9000 if h != 7 else 100) for h in range(12)]
    entries, pages = [], []
    for h in range(11):
        for log in (1, 2):
            for position in range(rng.randrange(7)):
                sequence = rng.choice([5, 5, 6, 7, 8, 10]) if h != 3 else rng.choice([8, 9])
                entries.append((h, log, position, 4096, sequence, rng.choice([100, 3000, 9000, 20000 if h == 6 else 100])))
                pages += [(h, log, position, k, rng.randrange(3000), rng.choice([0, 40, 300, 5])) for k in range(rng.randrange(6))]
    frames = [spark.createDataFrame(rows, types) for rows, types in ((hives, "hive long, primary long, secondary long, size long"), (entries, "hive long, log int, position int, log_size long, sequence long, hbins_size long"), (pages, "hive long, log int, position int, page int, offset long, length long"))]
    report, ranges = brute_replay(hives, entries, pages)
    assert {r["hive"]: tuple(r)[1:] for r in replay.replay_report(*frames).collect()} == report
    assert {s for s, *_ in report.values()} >= {"clean", "no_entries", "replayed", "oversize", "missing_start"}
    got = []
    rows = replay.replayed_ranges(*frames, bin_size=256).collect()
    for h, start, end, sequence, page, skip in rows:
        got += [(h, start + i, sequence, page, skip + i) for i in range(end - start)]
    assert sorted(got) == ranges and len(rows) < len(got) / 3
    assert not replay.replayed_ranges(frames[0], frames[1].limit(0), frames[2].limit(0)).count()


def brute_layers(layers, block, sub):
    """Where one sub-block is read, by walking the layers."""
    i = 0
    while i < len(layers):
        row = layers[i].get(block)
        if row is None:
            i += 1
            continue
        relative, target, forwarder, overlay, bitmap = row
        if forwarder:
            other = layers[i + 1].get(relative) if i + 1 < len(layers) else None
            if other is None or other[2]:
                return None, block + 512 * sub
            if other[3] and not other[4] >> sub & 1:
                i += 2
                continue
            return i + 1, other[1] + 512 * sub
        if overlay and not bitmap >> sub & 1:
            i += 1
            continue
        return i, target + 512 * sub
    return None, block + 512 * sub


@pytest.mark.parametrize("seed", [1, 2])
def test_layers_against_a_walk(spark, seed):
    rng = random.Random(seed)
    rows, stores = [], {}
    for store in range(4):
        stores[store] = layers = [{} for _ in range(rng.randrange(1, 6))]
        for i, layer in enumerate(layers):
            for block in rng.sample(range(12), 8):
                forwarder, overlay = rng.random() < 0.35, rng.random() < 0.6
                layer[block * 16384] = (rng.randrange(12) * 16384, rng.randrange(1000) * 16384, forwarder, overlay, rng.getrandbits(32) & rng.getrandbits(32))
                rows.append((store, i, block * 16384, *layer[block * 16384]))
    frame = spark.createDataFrame(rows, "store long, layer int, block long, relative long, target long, forwarder boolean, overlay boolean, bitmap long")
    got = {}
    for store, block, layer, base, mask in replay.layered_blocks(frame, ["store"]).collect():
        for sub in range(32):
            if mask >> sub & 1:
                assert (store, block, sub) not in got
                got[store, block, sub] = (layer, base + 512 * sub)
    assert got == {(s, b, k): brute_layers(layers, b, k) for s, layers in stores.items() for b in {b for x in layers for b in x} for k in range(32)}


def test_bounds_against_plain_code(spark):
    rng = random.Random(5)
    hits = sorted({(e, rng.choice("ab"), rng.randrange(500)) for e in (1, 1, 1, 2) for _ in range(40)})
    hits = [(e, n, o, rng.choice([0, 10, 30, 400]), rng.random() < 0.7, rng.random() < 0.7) for e, n, o in hits]
    spans, empty = [(1, a) for a in rng.sample(range(500), 20)], [(e, a * 16) for e in (1, 2) for a in rng.sample(range(32), 6)]
    frames = [spark.createDataFrame(rows, t) for rows, t in ((hits, "evidence_id long, name string, offset long, cap long, stop_at_allocated boolean, stop_at_zeros boolean"), (spans, "evidence_id long, start long"), (empty, "evidence_id long, at long"))]
    want = {}
    for e, n, o, cap, allocated, zeros in hits:
        ends = [(min((x for k, m, x, *_ in hits if k == e and m == n and x > o), default=None), 0), (min((a for k, a in spans if k == e and a > o), default=None) if allocated else None, 1), (min((a for k, a in empty if k == e and a > o), default=None) if zeros else None, 2), (o + cap, 3)]
        length, rank = min((z - o, r) for z, r in ends if z is not None)
        want[e, n, o] = (length, carving.BOUNDS[rank]) if length > 0 else (0, "none")
    assert {tuple(r)[:3]: tuple(r)[3:] for r in carving.bounded(*frames).collect()} == want
    assert {m for _, m in want.values()} == {*carving.BOUNDS, "none"}


@pytest.mark.parametrize("max_hits", [1, 7, 1000])
def test_budgeted_search_against_a_plain_one(spark, max_hits):
    rng = random.Random(max_hits)
    disks = {e: bytes(rng.choice(b"ab cX") for _ in range(n)) for e, n in ((1, 6000), (2, 900), (3, 40))}
    disks[1] = disks[1][:2990] + "Xab".encode("utf-16-le") + disks[1][2996:]
    blocks = [(e, at, d[at : at + 256]) for e, d in disks.items() for at in range(0, len(d), 256)]
    frames = spark.createDataFrame(blocks, "evidence_id long, offset long, data binary"), spark.createDataFrame([(e, len(d)) for e, d in disks.items()] + [(9, 0)], "evidence_id long, size long")
    rows, coverage = search.search_first(*frames, ["ab", "Xab"], max_hits, first=512, context=4, overlap=32)
    told = {r["evidence_id"]: tuple(r)[1:] for r in coverage.collect()}
    got = defaultdict(list)
    for r in rows.collect():
        d = disks[r["evidence_id"]]
        assert bytes(r["context"]) in d and d[r["context_offset"] :].startswith(bytes(r["context"])) and r["context_offset"] <= r["offset"]
        got[r["evidence_id"]].append(tuple(r)[1:4])
    for e, d in disks.items():
        every = sorted((m.start(), enc, t) for t in ("ab", "Xab") for enc in ("ascii", "utf-16-le") for m in re.finditer(re.escape(t.encode(enc)), d, re.I))
        stop = every[max_hits][0] if len(every) > max_hits else None
        want = [h for h in every if stop is None or h[0] < stop]
        assert sorted(got[e]) == want and told[e] == (len(want), stop is not None, len(d) if stop is None else stop)
    assert told[9] == (0, False, 0)


def test_related_to_the_asked(spark):
    rng = random.Random(2)
    rows = [(m, f"i{rng.randrange(30)}") for m in range(60) for _ in range(4)]
    held = defaultdict(set)
    for m, i in rows:
        held[m].add(i)
    got = artefacts.related_to(spark.createDataFrame(rows, "member long, item string"), spark.createDataFrame([(3,), (3,), (50,), (999,)], "member long"))
    assert {tuple(r) for r in got.collect()} == {(a, b, len(held[a] & held[b])) for a in (3, 50) for b in held if a != b and held[a] & held[b]}


def test_related_pairs_are_counted_where_they_meet(spark, monkeypatch):
    monkeypatch.setattr(artefacts, "MEETINGS", 5)
    monkeypatch.setattr(artefacts, "ASKED", 7)
    rows = [(m, f"i{k}") for m in range(40) for k in range(1, 6) if m % k == 0] + [(None, "i1"), (4, None)]
    got = artefacts.related_to(spark.createDataFrame(rows, "member long, item string"), spark.createDataFrame([(m,) for m in range(0, 40, 4)], "member long"))
    own = {m: {i for n, i in rows if n == m and i} for m in range(40)}
    wanted = {(a, r, len(own[a] & own[r])) for a in range(0, 40, 4) for r in range(40) if a != r and own[a] & own[r]}
    assert sorted(map(tuple, got.collect())) == sorted(wanted)
    assert got.rdd.getNumPartitions() > 8
    assert "hashpartitioning(member" not in got._jdf.queryExecution().executedPlan().toString()


def test_ranges_read_and_deal_pages_once(spark, monkeypatch):
    """Pages are joined with their entries once, and the writes of a bin are dealt once."""
    kept = []
    monkeypatch.setattr(replay, "cut", lambda df: kept.append(df) or df.checkpoint())
    hives = spark.createDataFrame([(1, 2, 1, 100000)], "hive long, primary long, secondary long, size long")
    entries = spark.createDataFrame([(1, 0, 1, 1000, 1, 4096), (1, 0, 2, 1000, 2, 4096)], "hive long, log long, position long, log_size long, sequence long, hbins_size long")
    pages = spark.createDataFrame([(1, 0, 1, 1, 0, 512), (1, 0, 1, 2, 512, 512), (1, 0, 2, 1, 256, 512), (1, 0, 2, 2, 0, 0)], "hive long, log long, position long, page long, offset long, length long")
    got = replay.replayed_ranges(hives, entries, pages, bin_size=256)
    assert sorted(map(tuple, got.collect())) == [(1, 4096, 4352, 1, 1, 0), (1, 4352, 4864, 2, 1, 0), (1, 4864, 5120, 1, 2, 256)]
    assert len(kept) == 2 and {"length", "log_size"} <= set(kept[0].columns) and {"bin", "a", "z"} <= set(kept[1].columns)
