"""Registry reports, database hints, deleted records, caches, zones and mnemonics."""

import hashlib
import random
import sqlite3
import struct
import zlib
from datetime import datetime

from pyspark.sql import functions as F

from attesta.functions import detect
from attesta.operators import artefacts, hints, registry_report, textindex
from attesta.sources import codecs, formats, records


def test_registry_report(spark):
    rows = [
        ("Microsoft\\Windows NT\\CurrentVersion", "ProductName", "Windows X", "t"), ("Microsoft\\Windows NT\\CurrentVersion", "Other", "x", "t"), ("ControlSet001\\Control\\Windows", "ShutdownTime", struct.pack("<Q", 133500000000000000).hex(), "t"),
        ("Software\\Microsoft\\Windows\\CurrentVersion\\Run", "Updater", "C:\\u.exe", "t"), ("Software\\Microsoft\\Windows\\CurrentVersion\\Explorer\\UserAssist\\{X}\\Count", "P:\\n.rkr", "00", "t"), ("Software\\Else", "a", "b", "t"), ("Software", None, None, "t"),
    ]
    told = registry_report.report(spark.createDataFrame(rows, "path string, name string, value string, modified string"))
    got = {(r["section"], r["name"]) for r in told.collect()}
    assert got == {("system", "ProductName"), ("last_shutdown", "ShutdownTime"), ("autostart", "Updater"), ("user_assist", "C:\\a.exe")}
    assert {r["section"]: r["n"] for r in registry_report.section_counts(told).collect()}["autostart"] == 1
    assert registry_report.shutdown_time(told).first()["at"].startswith("2024-01-1")


def test_key_paths(spark):
    keys = [(0, None, "ROOT"), *((i, i - 1, f"k{i}") for i in range(1, 9))]
    got = {r["key_offset"]: r["path"] for r in registry_report.path_of_keys(spark.createDataFrame(keys, "key_offset long, parent_offset long, name string")).collect()}
    assert got == {i: "\\".join(f"k{k}" for k in range(1, i + 1)) for i in range(9)}


def test_hints(spark):
    df = spark.createDataFrame([(1, 1700000000000000, "moc.elpmaxe."), (2, 0, None)], "id int, last_visit_date long, rev_host string")
    got = hints.decoded(df, "MOZ_PLACES").orderBy("id").collect()
    assert got[0]["rev_host_decoded"] == "example.com"
    assert got[1]["last_visit_date_decoded"] is None
    assert hints.decoded(df, "moz_places").select(F.unix_micros("last_visit_date_decoded")).first()[0] == 1700000000000000


def test_deleted_rows(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "x.db")
    con.execute("PRAGMA secure_delete=OFF")
    con.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, note TEXT)")
    con.executemany("INSERT INTO t VALUES (?,?,?)", [(i, f"person {i}", f"said something {i}") for i in range(1, 400)])
    con.commit()
    con.execute("DELETE FROM t WHERE id > 150")
    con.commit()
    con.close()
    files = spark.createDataFrame([("x", bytearray((tmp_path / "x.db").read_bytes()))], "path string, content binary")
    got = {v for r in formats.decode(files, "sqlite_deleted").collect() for v in r["values"] or [] if v and v.startswith("person")}
    assert len(got & {f"person {i}" for i in range(151, 400)}) > 100


def test_cache_entry(spark):
    key = b"1/0/_dk_https://a.com https://a.com https://a.com/x.png"
    raw = struct.pack("<QIII", 0xFCFB6D1BA7725C30, 5, len(key), 0) + bytes(4) + key + b"\x01\x02HTTP/1.1 200 OK\0Content-Type: image/png\0\0tail"
    raw = raw[:12] + struct.pack("<I", len(key)) + raw[16:]
    r = formats.decode(spark.createDataFrame([("c", bytearray(raw)), ("n", bytearray(b"no"))], "path string, content binary"), "browser_cache").collect()
    assert [(x["url"], x["status"], x["headers"]) for x in r] == [("https://a.com/x.png", 200, {"content-type": "image/png"})]


def test_time_zone():
    raw = struct.pack("<iii", -60, 0, -60) + struct.pack("<8H", 0, 10, 0, 5, 3, 0, 0, 0) + struct.pack("<8H", 0, 3, 0, 5, 2, 0, 0, 0)
    zone = records.time_zone(raw)
    assert [records.utc_offset(zone, datetime(2024, *d)) for d in ((1, 1), (3, 31, 1), (3, 31, 2), (7, 1), (10, 27, 3), (12, 1))] == [60, 60, 120, 120, 60, 60]
    south = struct.pack("<iii", -600, 0, -60) + struct.pack("<8H", 0, 4, 0, 1, 3, 0, 0, 0) + struct.pack("<8H", 0, 10, 0, 1, 2, 0, 0, 0)
    assert [records.utc_offset(records.time_zone(south), datetime(2024, m, 1)) for m in (1, 7, 12)] == [660, 600, 660]
    assert records.time_zone(b"") is None


def test_mnemonics():
    words = [f"w{i:04}" for i in range(2048)]
    rng = random.Random(3)

    def phrase(n):
        raw = rng.randbytes(n * 4 // 3)
        bits = "".join(f"{b:08b}" for b in raw) + f"{hashlib.sha256(raw).digest()[0]:08b}"[: n // 3]
        return [words[int(bits[i : i + 11], 2)] for i in range(0, len(bits), 11)]

    a, b = phrase(12), phrase(24)
    assert detect.mnemonic_valid(a, words)
    assert not detect.mnemonic_valid([*a[:-1], words[(words.index(a[-1]) + 1) % 2048]], words)
    assert detect.mnemonic_runs(["x", *a, "y", *b], words) == [(1, 12), (14, 24)]


def test_inventory(spark):
    key = "Root\\InventoryApplicationFile\\a.exe|1"
    rows = [(key, "LowerCaseLongPath", "c:\\a.exe", "t"), (key, "FileId", "0000" + "ab" * 20, "t"), (key, "Size", "12", "t"), ("Root\\Other\\x", "Name", "n", "t")]
    got = artefacts.inventory(spark.createDataFrame(rows, "path string, name string, value string, modified string")).collect()
    assert [(r["program"], r["sha1"], r["size"]) for r in got] == [("c:\\a.exe", "ab" * 20, 12)]


def test_regions_and_saved_searches(spark):
    noise = random.Random(2).randbytes(4096)
    df = spark.createDataFrame([(1, 0, bytearray(4096)), (1, 4096, bytearray(noise)), (1, 8192, bytearray(b"\0\1readable words here\0"))], "evidence_id long, offset long, data binary")
    docs = textindex.index_regions(df)
    assert [(r["id"], r["body"]) for r in docs.collect()] == [("1@8192", "readable words here")]
    both = textindex.index_all(docs, docs.select("id", "body"))
    assert both.count() == 2
    kept = textindex.saved_search(docs.select("id"), "first", "2024", ["words"]).first()
    assert (kept["search"], kept["hit"]["id"]) == ("first", "1@8192")


def packed_huffman(text):
    """Literals and one long reference, each symbol with a code of nine bits."""
    table = bytes([0x99]) * 256
    symbols = [*text, 256 + 15]
    bits = "".join(f"{s:09b}" for s in symbols)
    words = [int(bits[i : i + 16].ljust(16, "0"), 2) for i in range(0, len(bits), 16)]
    return table, words, len(bits)


def test_lzxpress_and_decmpfs():
    text = b"abcdefg"
    table, words, _ = packed_huffman(text)
    # The reference's extra length byte stands after the words read ahead by then: 8 symbols of 9 bits are 72, so 5 words and 1 ahead.
    words += [0] * (6 - len(words))
    raw = table + struct.pack(f"<{len(words)}H", *words) + bytes([5]) + bytes(8)
    assert codecs.lzxpress_huffman(raw, 30) == text + b"g" * 23
    body = b"x" * 5000
    head = b"fpmc" + struct.pack("<IQ", 3, len(body))
    assert codecs.decmpfs(head + zlib.compress(body)) == body
    assert codecs.decmpfs(b"fpmc" + struct.pack("<IQ", 3, 3) + b"\xffabc") == b"abc"
    parts = [zlib.compress(b"y" * 65536), b"\xff" + b"z" * 10]
    table = struct.pack("<I", 2) + struct.pack("<IIII", 20, len(parts[0]), 20 + len(parts[0]), 11)
    fork = struct.pack(">I", 0) + table + b"".join(parts)
    assert codecs.decmpfs(b"fpmc" + struct.pack("<IQ", 4, 65546), fork) == b"y" * 65536 + b"z" * 10
