"""Carving, templates, samples, sinks, documents and streams."""

import hashlib
import random
import struct
import zipfile
import zlib
from io import BytesIO

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.operators import carving, export, search, timeline
from attesta.sources import documents, formats
from attesta.streaming import buckets


def cut_up(spark, disk, size=1024):
    return spark.createDataFrame([(1, i, bytearray(disk[i : i + size])) for i in range(0, len(disk), size)], "evidence_id long, offset long, data binary")


def test_carving_over_block_edges(spark):
    disk = bytearray(random.Random(1).randbytes(9000)).replace(b"\xff", b"\xfe").replace(b"7z", b"..")
    disk[1022:1025] = b"\xff\xd8\xff"
    disk[2047:2049] = b"\xff\xd9"
    disk[4000:4006] = bytes.fromhex("377abcaf271c")
    disk[5000:5006] = bytes.fromhex("377abcaf271c")
    disk = bytes(disk)
    sizes = spark.createDataFrame([(1, len(disk))], "evidence_id long, size long")
    got = {(r["name"], r["offset"], r["length"], r["method"]) for r in carving.carve(cut_up(spark, disk), sizes).collect()}
    assert got == {("jpeg", 1022, 1027, "footer"), ("7z", 4000, 1000, "next_header"), ("7z", 5000, len(disk) - 5000, "end")}


def test_nested_hits(spark):
    df = spark.createDataFrame([(1, "a", 0, 100, "footer"), (1, "b", 10, 20, "footer"), (1, "c", 0, 100, "limit"), (1, "d", 200, 50, "limit"), (1, "e", 210, 5, "footer"), (2, "f", 10, 20, "footer")], "evidence_id long, name string, offset long, length long, method string")
    assert {r["name"] for r in carving.drop_nested(df).collect()} == {"a", "c", "d", "e", "f"}
    # All kept hits count among those looked back at, so what is too far back holds nothing.
    rows = [(1, "big", 0, 1000, "footer"), *((1, f"open{i}", 5, 2000, "limit") for i in range(3)), (1, "late", 20, 5, "footer")]
    far = spark.createDataFrame(rows, df.schema)
    assert "late" not in {r["name"] for r in carving.drop_nested(far, 4).collect()}
    assert "late" in {r["name"] for r in carving.drop_nested(far, 3).collect()}


@pytest.mark.parametrize("header", ["ff", "??ffd8", "ffd", "zz00", "00" * 65])
def test_bad_rules(header):
    with pytest.raises(ValueError):
        carving.Signature("x", header)


def test_rule_sets():
    with pytest.raises(ValueError):
        carving.check_rules([carving.Signature("x", "ffd8")] * 2)
    assert len(carving.check_rules(list(carving.SIGNATURES))) == len(carving.SIGNATURES)


def test_templates(spark):
    raw = bytearray(512)
    struct.pack_into("<I", raw, 440, 77)
    raw[510:] = b"\x55\xaa"
    df = spark.createDataFrame([(bytes(raw),), (b"short",), (None,)], "content binary")
    got = [r["fields"] for r in carving.apply_template(df, carving.MBR).collect()]
    assert (got[0]["disk_signature"], got[0]["signature"]) == ("77", "55aa")
    assert got[1]["disk_signature"] is None
    assert got[2] is None
    for bad in ([], [("a", 0, "u9", 1)], [("a", -1, "u8", 1)], [("a", 0, "hex", 0)], [("a", 65535, "u32", 4)], [("a", 0, "u8", 1), ("a", 1, "u8", 1)]):
        with pytest.raises(ValueError):
            carving.Template("t", tuple(bad))


def test_core_sample(spark):
    disk = bytes(4096) + b"words of text " * 300 + bytes(2000)
    small = carving.core_sample(cut_up(spark, disk), len(disk), 1024, buckets=4).collect()
    assert sum(r["n"] for r in small) == -(-len(disk) // 1024)
    large = carving.core_sample(cut_up(spark, disk, 64), len(disk), 64, buckets=4, windows=8, whole=10).collect()
    assert 4 * 7 <= sum(r["n"] for r in large) <= 4 * 10


def test_sinks_and_verification(spark, tmp_path):
    files = spark.createDataFrame([("=a", b"x"), ("b", b"y")], "path string, content binary")
    told = export.manifest(files)
    export.write_csv(told, str(tmp_path / "c"))
    back = {r["path"]: r for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()}
    assert set(back) == {"'=a", "b"}
    assert back["b"]["sha256"] == hashlib.sha256(b"y").hexdigest()
    export.write_json(told, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    disk = random.Random(4).randbytes(5000)
    blocks = cut_up(spark, disk).repartition(5)
    stored = spark.createDataFrame([(1, hashlib.md5(disk).hexdigest().upper(), None)], "evidence_id long, md5 string, sha1 string")
    r = export.verify(blocks, stored).first()
    assert (r["size"], r["sha1"], r["verified"]) == (5000, hashlib.sha1(disk).hexdigest(), True)
    assert export.piece_digests(blocks).count() == 5


def test_documents(spark):
    raw = BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:t>Hello</w:t><w:t> you</w:t></w:p><w:p><w:t>Bye</w:t></w:p></w:document>')
        z.writestr("docProps/core.xml", '<c xmlns:d="d"><d:creator>Ann</d:creator></c>')
    stream = zlib.compress(b"BT (He\\(l\\)lo) Tj T* [(wor) -20 <6c64>] TJ ET")
    paper = b"%PDF-1.4\n<< /Title (A \\101) >>\n<< /Filter /FlateDecode /Length 9 >>\nstream\n" + stream + b"\nendstream\n"
    df = spark.createDataFrame([("d", bytearray(raw.getvalue())), ("p", bytearray(paper)), ("x", bytearray(b"nothing"))], "path string, content binary")
    r = formats.decode(df, "office").collect()
    assert [(x["kind"], x["text"], x["author"]) for x in r] == [("docx", "Hello you\nBye", "Ann")]
    r = formats.decode(df, "pdf").first()
    assert (r["text"], r["title"]) == ("He(l)lo\nworld", "A A")


def test_exif():
    def ifd(entries, at):
        body, extra = struct.pack("<H", len(entries)), b""
        base = at + 2 + 12 * len(entries) + 4
        for tag, kind, count, value in entries:
            if len(value) > 4:
                body += struct.pack("<HHII", tag, kind, count, base + len(extra))
                extra += value
            else:
                body += struct.pack("<HHI", tag, kind, count) + value.ljust(4, b"\0")
        return body + bytes(4) + extra

    ratio = lambda *v: b"".join(struct.pack("<II", a, b) for a, b in v)
    gps = ifd([(1, 2, 2, b"S\0"), (2, 5, 3, ratio((10, 1), (30, 1), (36, 1))), (5, 1, 1, b"\1"), (6, 5, 1, ratio((5, 2)))], 200)
    tiff = (b"II*\0" + struct.pack("<I", 8) + ifd([(0x10F, 2, 6, b"Maker\0"), (0x8825, 4, 1, struct.pack("<I", 200))], 8)).ljust(200, b"\0") + gps
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(tiff)) + b"Exif\0\0" + tiff + b"\xff\xd9"
    got = documents.exif(jpeg)
    assert (got["make"], got["latitude"], got["longitude"], got["altitude"]) == ("Maker", -10.51, None, -2.5)
    assert documents.exif(b"\xff\xd8\xff\xd9") is None


def test_compound_and_quarantine():
    head = bytearray(512)
    head[:8] = bytes.fromhex("d0cf11e0a1b11ae1")
    struct.pack_into("<HH", head, 30, 9, 6)
    struct.pack_into("<IIIIIII", head, 48, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    struct.pack_into("<109I", head, 76, 0, *[0xFFFFFFFF] * 108)

    def entry(name, kind, child, start, size):
        n = name.encode("utf-16-le")
        return n.ljust(64, b"\0") + struct.pack("<HBBIII", len(n) + 2, kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, child) + bytes(36) + struct.pack("<IQ", start, size)

    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, 10), 0xFFFFFFFE]
    raw = bytes(head) + struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff") + (entry("Root", 5, 1, 0xFFFFFFFE, 0) + entry("Data", 2, 0xFFFFFFFF, 2, 4096)).ljust(512, b"\0") + b"q" * 4096
    c = documents.Compound(raw)
    assert [(p, n) for p, n, _ in c.streams()] == [("Data", 4096)]
    assert c.read(1) == b"q" * 4096
    assert documents.quarantine("0083;5f000000;Safari;U") == {"flags": "0083", "at": 0x5F000000, "agent": "Safari", "event": "U"}


def test_streams_equal_batches(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("flagged"), "user_id", "event_id")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    live = buckets.follow(spark, str(tmp_path / "in"), e.schema, per_batch=1)

    def drained(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return {tuple(r) for r in spark.table(name).collect()}

    want = {tuple(r) for r in timeline.minutes(e.withColumn("sort", F.unix_micros("ts") / 1e6)).collect()}
    assert drained(buckets.minute_buckets(live, late="4000 days"), "m", "complete") == want
    assert len(drained(buckets.first_seen(live, ["user_id"], late="4000 days"), "f", "append")) == e.select("user_id").distinct().count()
    docs = spark.createDataFrame([(1, "a b", "/a", "x y x")], "id long, name string, path string, body string")
    docs.write.parquet(str(tmp_path / "docs"))
    buckets.index_new(buckets.follow(spark, str(tmp_path / "docs"), docs.schema), str(tmp_path / "ix"), str(tmp_path / "ckix")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ix")).where("term = 'x'").count() == 2


def test_marks_are_found_in_few_blocks_at_a_time(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([b"ab." * 50] * 1000)], ["i", "data"])
    parts = list(search.few_at_once([batch]))
    assert max(p.num_rows for p in parts) <= 64 and [x for p in parts for x in p.column(0).to_pylist()] == list(range(1000))
    blocks = spark.createDataFrame([(1, i * 150, bytearray(b"ab." * 50)) for i in range(300)], "evidence_id long, offset long, data binary").coalesce(1)
    found = carving.marks(blocks, (carving.Signature("x", b"ab".hex(), b".".hex(), 9),), 64)
    assert found.groupBy("kind").count().orderBy("kind").collect() == [("footer", 15_000), ("header", 15_000)]
