"""Operators on small fixtures with known outcomes."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from attesta.functions import detect, fuzzy, text, times
from attesta.operators import artefacts, casebook, diff, filters, hashing, intervals, report, search, similar, textindex, timeline

ENTRIES = "name string, path string, is_dir boolean, size long, deleted boolean, created string, modified string, accessed string, node string"


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(
        [
            ("Report.docx", "/Report.docx", False, 10, False, "2024-02-01T10:00:00Z", None, "2024-03-05T10:00:00Z", "1"),
            ("notes.txt", "/notes.txt", False, 0, True, "2023-01-01T10:00:00Z", None, None, "2"),
            ("dir", "/dir", True, None, False, None, None, None, "3"),
        ],
        ENTRIES,
    )


@pytest.mark.parametrize(
    ("criteria", "names"),
    [
        ({"name": "REPORT"}, {"Report.docx"}), ({"hide_deleted": True}, {"Report.docx", "dir"}), ({"deleted_only": True}, {"notes.txt"}), ({"created_after": "2024-01-01"}, {"Report.docx"}),
        ({"created_before": "2023-12-31T23:59:59Z"}, {"notes.txt"}), ({"accessed_before": "2024-12-31"}, {"Report.docx"}), ({"files_only": True}, {"Report.docx", "notes.txt"}),
        ({"extensions": [".DOCX"]}, {"Report.docx"}), ({"max_size": 0}, {"notes.txt", "dir"}), ({}, {"Report.docx", "notes.txt", "dir"}),
    ],
)
def test_entry_filter(entries, criteria, names):
    assert {r["name"] for r in filters.filter_entries(entries, criteria).collect()} == names


@pytest.mark.parametrize(
    "raw",
    [{"what": 1}, {"name": 3}, {"min_size": -1}, {"max_size": True}, {"created_after": "soon"}, {"name": "x" * 300}, {"extensions": ["a"] * 65}, {"deleted_only": True, "hide_deleted": True}, {"min_size": 5, "max_size": 4}, {"created_after": "2024-02-01", "created_before": "2024-01-01"}],
)
def test_bad_filters(raw):
    with pytest.raises(ValueError):
        filters.EntryFilter.clean(raw)


def test_blank_filters_are_off():
    assert filters.EntryFilter.clean({"name": "", "deleted_only": False}) == filters.EntryFilter()
    assert filters.EntryFilter.clean({"extensions": [".PDF", "docx", ""]}).extensions == ("pdf", "docx")


def events(spark, n=3600):
    rng = random.Random(7)
    rows = [(i, float(rng.randrange(0, 20_000)), f"/dir{i % 5}/f{i % 400}", f"f{i % 400}", rng.choice("abc"), rng.random() < 0.2, rng.random() < 0.1) for i in range(n)]
    return spark.createDataFrame(rows, "id long, sort double, path string, name string, action string, flagged boolean, deleted boolean"), rows


def test_pages_walk_everything_once(spark):
    df, rows = events(spark, 500)
    df = df.cache()
    seen, cursor = [], None
    while got := timeline.page(df, cursor, 97).collect():
        seen += [r["id"] for r in got]
        last = got[-1]
        cursor = (last["sort"], last["path"], last["action"], last["id"])
    assert seen == [r[0] for r in sorted(rows, key=lambda r: (r[1], r[2], r[4], r[0]))]
    with pytest.raises(ValueError):
        timeline.page(df, limit=2001)


@pytest.mark.parametrize("bins", [7, 50])
def test_histogram_counts_every_event(spark, bins):
    df, rows = events(spark)
    got = timeline.histogram(df, bins, 0.0, 20_000.0).collect()
    assert sum(r["n"] for r in got) == len(rows)
    bounds = timeline.histogram_bounds(df, bins, 0.0, 20_000.0)
    for r in got:
        assert r["n"] == sum(r["lo"] <= x[1] < bounds["lo"] + (r["bucket"] + 1) * bounds["width"] for x in rows)


def test_histogram_of_nothing(spark):
    df, _ = events(spark, 1)
    empty = df.where("false")
    assert timeline.histogram_bounds(empty, 4) == {"lo": 0.0, "width": 15.0, "n": 4, "hi": 60.0, "full": None, "trimmed": False}
    assert [r["n"] for r in timeline.histogram(empty, 4).collect()] == [0] * 4


def test_unpivot_and_marks(spark):
    df = spark.createDataFrame([("a", "2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z", "2024-01-03T00:00:00.5Z"), ("b", None, "", None)], "node string, created string, modified string, fn_created string")
    got = {(r["node"], r["action"], r["source"]) for r in timeline.events_of(df).collect()}
    assert got == {("a", "created", "si"), ("a", "modified", "si"), ("a", "created", "fn")}
    marks = df.select(timeline.anomaly_marks(F.col("created"), F.col("fn_created"), F.col("modified"), F.lit(None).cast("string"))).collect()
    assert marks[0][0] == ["backdated", "modified_first", "whole_second"]
    assert marks[1][0] == []
    odd = [("2024-01-02T00:00:00Z", "2024-01-03T00:00:00.5Z", None, "2024-01-01T00:00:00.5Z"), ("2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00.5Z"), ("2024-01-02T00:00:00Z", None, "2024-01-01T00:00:00.5Z", None)]
    df = spark.createDataFrame(odd, "c string, m string, fc string, fm string")
    assert [r[0] for r in df.select(timeline.anomaly_marks(F.col("c"), F.col("fc"), F.col("m"), F.col("fm"))).collect()] == [[], ["whole_second"], []]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (1, "c", "y"), (1, "d", "y"), (1, "e", ""), (2, "f", ""), (1, "g", "z"), (2, "h", "z"), (3, "i", "z")], "evidence_id long, node string, sha256 string")
    got = [(r["sha256"], r["n"], r["nodes"]) for r in hashing.duplicate_groups(df).collect()]
    assert got == [("z", 3, ["g", "h", "i"]), ("x", 2, ["a", "b"])]


def test_hash_matches(spark):
    files = spark.createDataFrame([("n", "aa", "bb", "cc"), ("m", "cc", "", None)], "node string, md5 string, sha1 string, sha256 string")
    sets = spark.createDataFrame([(1, "known_bad"), (2, "known_good")], "id int, kind string")
    listed = spark.createDataFrame([(1, "md5", "AA", "bad"), (2, "sha256", "cc", "good")], "set_id int, algo string, digest string, label string")
    matched = hashing.matches(files, sets, listed)
    assert {(r["node"], r["kind"]) for r in matched.collect()} == {("n", "known_bad"), ("n", "known_good")}
    assert [(r["node"], r["kind"], r["matches"]) for r in hashing.verdicts(matched).collect()] == [("n", "known_bad", 2)]


def test_hash_list(spark, tmp_path):
    h = hashlib.md5(b"x").hexdigest()
    (tmp_path / "list.txt").write_text(f'"{h.upper()}","b.exe"\n{h} a.exe\nnothing here\n{hashlib.sha256(b"y").hexdigest()}\n')
    got = {(r["algo"], r["label"]) for r in hashing.read_hash_list(spark, str(tmp_path / "list.txt")).collect()}
    assert got == {("md5", "b.exe"), ("sha256", "")}


def test_fuzzy_scores():
    rng = random.Random(3)
    base = bytes(rng.randrange(256) for _ in range(8000))
    changed = base[:3000] + bytes(rng.randrange(256) for _ in range(1900)) + base[4900:]
    other = bytes(rng.randrange(256) for _ in range(8000))
    a, b, c = map(fuzzy.fuzzy_hash, (base, changed, other))
    assert fuzzy.compare(a, a) == 100
    assert fuzzy.compare(a, b) > 60
    assert fuzzy.compare(a, c) == 0
    assert fuzzy.compare("junk", a) == 0


def test_similar_files(spark):
    rng = random.Random(3)
    base = bytes(rng.randrange(256) for _ in range(8000))
    changed = base[:3000] + bytes(rng.randrange(256) for _ in range(1900)) + base[4900:]
    rows = [("a", base), ("b", changed), ("c", base), ("d", bytes(rng.randrange(256) for _ in range(8000))), ("e", None)]
    df = spark.createDataFrame([(n, x, hashlib.sha256(x).hexdigest() if x else None) for n, x in rows], "node string, content binary, sha256 string")
    got = similar.similar_files(df.select("node", "sha256", fuzzy.fuzzy("content").alias("fuzzy"))).collect()
    assert {(r["a"], r["b"]) for r in got} == {("a", "b"), ("b", "c")}


def test_listing_diff(spark):
    schema = "path string, name string, size long, modified string, node string"
    a = spark.createDataFrame([("/b.txt", "b.txt", 3, None, "1"), ("/a.txt", "a.txt", 1, None, "2"), ("/gone.txt", "gone.txt", 9, None, "3")], schema)
    b = spark.createDataFrame([("/b.txt", "b.txt", 4, None, "8"), ("/A.TXT", "A.TXT", 1, None, "9"), ("/new.txt", "new.txt", 2, None, "10")], schema)
    got = {(r["path"], r["status"], tuple(r["changes"])) for r in diff.listing_diff(a, b, fold=True).collect()}
    assert got == {("/b.txt", "changed", ("size",)), ("/A.TXT", "unchanged", ()), ("/gone.txt", "removed", ()), ("/new.txt", "added", ())}
    assert {r["status"] for r in diff.listing_diff(a, b).where("lower(path) = '/a.txt'").collect()} == {"added", "removed"}


def test_intervals_against_brute_force(spark):
    rng = random.Random(11)
    spans = [(rng.randrange(3), s := rng.randrange(400), s + rng.randrange(0, 9)) for _ in range(120)]
    df = spark.createDataFrame(spans, "g int, start long, end long")
    covered = {(g, x) for g, s, e in spans for x in range(s, e)}
    merged = intervals.merge(df, ["g"]).collect()
    assert {(r["g"], x) for r in merged for x in range(r["start"], r["end"])} == covered
    assert all(a["end"] < b["start"] or b["end"] < a["start"] for a in merged for b in merged if a is not b and a["g"] == b["g"])
    sizes = spark.createDataFrame([(g, 410) for g in range(3)], "g int, size long")
    free = {(r["g"], x) for r in intervals.gaps(df, sizes, ["g"]).collect() for x in range(r["start"], r["end"])}
    assert free == {(g, x) for g in range(3) for x in range(410)} - covered
    points = spark.createDataFrame([(g, x) for g in range(3) for x in range(410)], "g int, offset long")
    assert {(r["g"], r["offset"]) for r in intervals.contained(points, df, ["g"], bin_size=16).collect()} == covered


def test_times(spark):
    df = spark.range(1)
    micros = lambda c: df.select(F.unix_micros(c)).first()[0]
    assert micros(times.from_filetime(F.lit(116444736000000010))) == 1
    assert micros(times.from_filetime(F.lit(0))) is None
    assert micros(times.from_filetime(F.lit(-5))) is None
    assert micros(times.from_filetime(F.lit("18446744073709551615"))) is None
    assert micros(times.from_unix(F.lit(1700000000))) == 1700000000000000
    assert micros(times.from_mac_absolute(F.lit(0.5))) == 978307200500000
    assert micros(times.from_ole_days(F.lit(25570.0))) == 86400000000
    assert str(df.select(times.from_dos(F.lit(0x5821), F.lit(0x6000))).first()[0]) == "2024-01-01 12:00:00"
    assert df.select(times.from_dos(F.lit(0x5800), F.lit(0))).first()[0] is None


def test_texts(spark):
    df = spark.createDataFrame([("=1+1", "Straße", "a\x00b")], "c string, s string, n string")
    r = df.select(text.csv_safe(F.col("c")), text.casefold(F.col("s")), text.rot13(F.lit("Uryyb")), text.extension_of_file(F.lit(".bashrc")), text.extension_of_name(F.lit(".bashrc")), text.unreversed_host(F.lit("moc.elpmaxe."))).first()
    assert list(r) == ["'=1+1", "strasse", "Hello", "", "bashrc", "example.com"]
    assert text.visible_of("<p>a</p><script>x</script>b &amp; c<br>d") == "a b & c d"
    h = spark.createDataFrame([("<p onclick='x()'>a<img src='http://x/y'><script>z</script></p>",)], "h string").select(text.sanitised("h").alias("s")).first()["s"]
    assert h["html"] == "<p>a<img></p>"
    assert h["removed"] == ["p onclick", "img src", "<script>"]


def test_detection(spark):
    assert detect.class_of(b"\0" * 512)[0] == "zero"
    assert detect.class_of(b"\xff" * 512)[0] == "ff"
    assert detect.class_of(b"plain words and more of them " * 20)[0] == "text"
    assert detect.class_of(random.Random(1).randbytes(8192))[0] == "high"
    assert detect.base58check("1BoatSLRHtKNngkdXEeobR76b53LETtpyT")
    assert not detect.base58check("1BoatSLRHtKNngkdXEeobR76b53LETtpyU")
    assert detect.bech32("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4") == "bech32"
    df = spark.createDataFrame([(b"%PDF-1.7", "pdf"), (b"%PDF-1.7", "png"), (b"hello there", "docx"), (b"", "txt"), (b"\x01\x02\x03\x04", "zip")], "h binary, e string")
    got = [r["v"] for r in df.select(detect.type_verdict(F.col("e"), F.col("h"), F.length("h")).alias("v")).collect()]
    assert [(v["verdict"], v["severity"]) for v in got] == [("match", None), ("mismatch", "high"), ("mismatch", "low"), ("empty", None), ("no_signature", None)]


def test_audit_chain(spark):
    rows, prev = [], ""
    for i, (who, what) in enumerate([("A", "open"), (None, "hash"), ("B", "close")]):
        h = hashlib.sha256(f"{prev}|t{i}|{who}|{what}|d".encode()).hexdigest()
        rows.append((1, i, f"t{i}", who, what, "d", prev, h))
        prev = h
    schema = "chain int, seq long, at string, examiner string, action string, detail string, prev_hash string, hash string"
    good = spark.createDataFrame(rows, schema)
    assert tuple(casebook.audit_verdict(good, ["chain"]).first())[1:] == (3, True, None)
    bad = good.withColumn("detail", F.when(F.col("seq") == 1, "x").otherwise(F.col("detail")))
    assert tuple(casebook.audit_verdict(bad, ["chain"]).first())[1:] == (3, False, 1)
    heads = spark.createDataFrame([(1, 3, "zz")], "chain int, seq long, hash string")
    assert casebook.audit_verdict(good, ["chain"], heads).first()["intact"] is False


def test_notes(spark):
    df = spark.createDataFrame([(1, "a", None, None), (2, "b", 1, None), (3, "c", 2, None), (4, "d", None, "t")], "id long, examiner string, replaces long, retracted_at string")
    assert {(r["id"], r["root"], r["version"]) for r in casebook.note_history(df).collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 4, 0)}
    assert [(r["id"], r["author"]) for r in casebook.current_notes(df).collect()] == [(3, "a")]


def test_block_search(spark):
    blocks = spark.createDataFrame([(1, 0, bytearray(b"xxxxxpassword" + b"." * 3485 + b"nee")), (1, 3501, bytearray(b"dle" + "wide".encode("utf-16-le"))), (1, 3512, bytearray(b""))], "evidence_id long, offset long, data binary")
    got = {(r["offset"], r["encoding"], r["term"]) for r in search.search_blocks(blocks, ["pass", "password", "NEEDLE", "wide"]).collect()}
    assert got == {(5, "ascii", "pass"), (5, "ascii", "password"), (3498, "ascii", "NEEDLE"), (3504, "utf-16-le", "wide")}
    odd = spark.createDataFrame([(1, 0, bytearray(b"z" + "ab".encode("utf-16-le") + "\U0001f600ab".encode("utf-16-le")))], "evidence_id long, offset long, data binary")
    assert {r["offset"] for r in search.search_blocks(odd, ["ab"], ("utf-16-le",), regex=True).collect()} == {1, 9}


def test_index(spark):
    docs = spark.createDataFrame([(1, "a", "/a", "The quick brown fox. Quick brown again."), (2, "quick", "/b", "slow brown"), (3, "c", "/c", None)], "id long, name string, path string, body string")
    index = textindex.postings(docs)
    assert {(r["id"], r["hits"]) for r in textindex.phrase_hits(index, "quick BROWN").collect()} == {(1, 2)}
    assert [r["id"] for r in textindex.query(index, docs, ["quick"]).collect()][0] in (1, 2)
    assert {r["id"] for r in textindex.ranked(index, ["quick", "slow"], "all").collect()} == {2}
    assert textindex.ranked(index, ["..."]).count() == 0
    assert textindex.extract(b"\x00\x01abcd\x00\x02" + "wxyz".encode("utf-16-le")) == "abcd wxyz"


def test_overlay_raid_recycle(spark):
    layers = spark.createDataFrame([(1, 0, "new"), (1, 9, "live"), (2, 9, "live")], "block long, layer int, data string")
    assert {(r["block"], r["data"]) for r in artefacts.overlay(layers, ["block"]).collect()} == {(1, "new"), (2, "live")}
    at = {r["block"]: (r["row"], r["member"]) for r in artefacts.raid_address(spark.createDataFrame([(b,) for b in range(6)], "block long"), 3, 1).collect()}
    assert at == {0: (0, 0), 1: (0, 1), 2: (1, 2), 3: (1, 0), 4: (2, 1), 5: (2, 2)}
    i = spark.createDataFrame([("b", "s", "AB", 1), ("b", "s", "c", 2)], "bin string, sid string, suffix string, x int")
    r = spark.createDataFrame([("b", "s", "ab", 3), ("b", "s", "d", 4)], "bin string, sid string, suffix string, y int")
    assert {(q["suffix"], q["orphan"]) for q in artefacts.recycled(i, r).collect()} == {("ab", None), ("c", "metadata"), ("d", "content")}


def test_report(spark):
    rows, told = report.capped(spark.range(10), 3)
    assert len(rows.collect()) == 3
    assert told.limit == 3


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_reach_the_scan(spark, entries, tmp_path):
    entries.write.parquet(str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    told = plan(filters.filter_entries(stored, {"min_size": 5, "created_after": "2024-01-01", "hide_deleted": True}).select("name"))
    pushed = next(x for x in told.splitlines() if "PushedFilters" in x)
    for want in ("GreaterThanOrEqual(size,5)", "GreaterThanOrEqual(created,2024-01-01)", "Or(Not(EqualTo(deleted,true)),IsNull(deleted))"):
        assert want in pushed or want.replace("Not(EqualTo(deleted,true))", "EqualTo(deleted,false)") in pushed
    read = next(x for x in told.splitlines() if "ReadSchema" in x)
    assert "path" not in read
    assert "accessed" not in read


def test_pages_read_by_key(spark, tmp_path):
    df, _ = events(spark, 100)
    df.write.parquet(str(tmp_path / "t"))
    told = plan(timeline.page(spark.read.parquet(str(tmp_path / "t")), (500.0, "/a", "b", 1), 10))
    assert "GreaterThanOrEqual(sort,500.0)" in told
    assert "TakeOrderedAndProject" in told
