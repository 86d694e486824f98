"""Readers against files made here, byte by byte or by the standard library."""

import bz2
import json
import plistlib
import random
import sqlite3
import struct
import uuid
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from attesta.sources import codecs, containers, filesystems, formats, records, volumes
from attesta.sources.bytesio import FileBytes, Joined, MemoryBytes, View

DISK = bytes(random.Random(1).randbytes(70_000)) + bytes(30_000) + b"end" * 1000
DISK += bytes(-len(DISK) % 512)


def same(image, disk=DISK):
    assert image.size == len(disk)
    rng = random.Random(2)
    for _ in range(60):
        at, n = rng.randrange(len(disk)), rng.randrange(9000)
        assert image.read_at(at, n) == disk[at : at + n]
    assert image.read_at(0, len(disk) + 5) == disk
    assert image.read_at(len(disk), 1) == b""
    assert image.read_at(-1, 4) == b""


def test_views_and_parts():
    same(Joined([MemoryBytes(DISK[:1000]), MemoryBytes(b""), MemoryBytes(DISK[1000:])]))
    v = View(MemoryBytes(DISK), 100, 50)
    assert v.read_at(40, 99) == DISK[140:150]
    assert v.read_at(-5, 9) == b""
    with pytest.raises(ValueError):
        View(MemoryBytes(DISK), -1, 5)


def test_split_raw(tmp_path):
    for i in range(3):
        (tmp_path / f"d.00{i + 1}").write_bytes(DISK[i * 40_000 : (i + 1) * 40_000])
    same(containers.open_image(str(tmp_path / "d.001")))


def dynamic_vhd(disk, block=4096, kind=3, skip=()):
    def footer():
        return b"conectix" + struct.pack(">IIQ", 2, 0x10000, 512) + bytes(24) + struct.pack(">QI", len(disk), 0)[:8] + bytes(4) + struct.pack(">I", kind) + bytes(512 - 64)

    n = -(-len(disk) // block)
    table_at, at, table, body = 1536, 0, [], b""
    at = table_at + -(-n * 4 // 512) * 512
    for i in range(n):
        part = disk[i * block : (i + 1) * block]
        if i in skip or not any(part):
            table.append(0xFFFFFFFF)
            continue
        table.append((at + len(body)) // 512)
        body += b"\xff" * 512 + part.ljust(block, b"\0")
    head = b"cxsparse" + struct.pack(">QQIII", 0xFFFFFFFFFFFFFFFF, table_at, 0x10000, n, block)
    raw = footer() + head.ljust(1024, b"\0") + struct.pack(f">{n}I", *table)
    return raw.ljust(table_at + -(-n * 4 // 512) * 512, b"\0") + body + footer()


def test_vhd():
    same(containers.Vhd(MemoryBytes(dynamic_vhd(DISK))))
    old = bytes(x ^ 255 for x in DISK)
    child = containers.Vhd(MemoryBytes(dynamic_vhd(DISK, kind=4, skip={1, 2})), MemoryBytes(old))
    assert child.read_at(0, 4096) == DISK[:4096]
    assert child.read_at(5000, 100) == old[5000:5100]
    with pytest.raises(ValueError):
        containers.Vhd(MemoryBytes(dynamic_vhd(DISK, kind=4)))
    with pytest.raises(ValueError):
        containers.Vhd(MemoryBytes(b"x" * 2000))


def test_vdi():
    n = -(-len(DISK) // 8192)
    blocks = [DISK[i * 8192 : (i + 1) * 8192].ljust(8192, b"\0") for i in range(n)]
    table, body = [], b""
    for b in reversed(blocks):
        table.insert(0, len(body) // 8192 if any(b) else 0xFFFFFFFF)
        body += b if any(b) else b""
    head = bytearray(1024)
    struct.pack_into("<I", head, 0x40, 0xBEDA107F)
    struct.pack_into("<II", head, 0x154, 512, 1024)
    struct.pack_into("<QIII", head, 0x170, len(DISK), 8192, 0, n)
    struct.pack_into(f"<{n}I", head, 512, *table)
    same(containers.Vdi(MemoryBytes(bytes(head) + body)))


def test_qcow2():
    size, n = 1 << 12, -(-len(DISK) // (1 << 12))
    body, l2 = bytearray(size * 3), []
    for i in range(n):
        part = DISK[i * size : (i + 1) * size].ljust(size, b"\0")
        if not any(part):
            l2.append(0)
        elif i % 3 == 0:
            c = zlib.compressobj(9, zlib.DEFLATED, -15)
            packed = c.compress(part) + c.flush()
            at = len(body)
            sectors = -(-len(packed) // 512)
            body += packed.ljust(sectors * 512, b"\0")
            l2.append(1 << 62 | sectors - 1 << 62 - 4 | at)
        else:
            body += bytes(-len(body) % size)
            l2.append(1 << 63 | len(body))
            body += part
    struct.pack_into(">IIQIIQIIQ", body, 0, 0x514649FB, 2, 0, 0, 12, len(DISK), 0, 1, size)
    struct.pack_into(">Q", body, size, 1 << 63 | 2 * size)
    struct.pack_into(f">{n}Q", body, 2 * size, *l2)
    same(containers.Qcow2(MemoryBytes(bytes(body))))


@pytest.mark.parametrize("packed", [False, True])
def test_vmdk(packed):
    grain, n = 8, -(-len(DISK) // 4096)
    table, body = [], b""
    at = 4
    for i in range(n):
        part = DISK[i * 4096 : (i + 1) * 4096].ljust(4096, b"\0")
        if not any(part):
            table.append(0)
            continue
        raw = struct.pack("<QI", i * 8, len(z := zlib.compress(part))) + z if packed else part
        table.append(at + len(body) // 512)
        body += raw + bytes(-len(raw) % 512)
    head = b"KDMV" + struct.pack("<IIQQQQIQQ", 1, 0x10000 if packed else 0, len(DISK) // 512, grain, 0, 0, 512, 0, 1)
    raw = head.ljust(512, b"\0") + struct.pack("<I", 2).ljust(512, b"\0") + struct.pack(f"<{n}I", *table).ljust(1024, b"\0")
    assert len(raw) == 2048
    same(containers.VmdkSparse(MemoryBytes(raw + body)))


def ewf(disk, path):
    sector_per, chunks = 8, []
    out = bytearray(b"EVF\x09\x0d\x0a\xff\x00\x01\x01\x00\x00\x00")

    def section(kind, body, last=False):
        at = len(out)
        out.extend(kind.encode().ljust(16, b"\0") + struct.pack("<QQ", at if last else at + 76 + len(body), 76 + len(body)) + bytes(44) + body)

    section("volume", struct.pack("<IIIIQ", 1, -(-len(disk) // 4096), sector_per, 512, len(disk) // 512).ljust(94, b"\0"))
    base, body = len(out) + 76, b""
    for i in range(0, len(disk), 4096):
        part = disk[i : i + 4096]
        z = zlib.compress(part)
        small = len(z) < len(part)
        chunks.append(base + len(body) | (1 << 31 if small else 0))
        body += z if small else part + struct.pack("<I", zlib.adler32(part))
    section("sectors", body)
    section("table", struct.pack("<IIQII", len(chunks), 0, 0, 0, 0) + struct.pack(f"<{len(chunks)}I", *chunks))
    section("hash", b"\x11" * 16)
    section("done", b"", True)
    path.write_bytes(out)


def test_ewf(tmp_path):
    ewf(DISK, tmp_path / "case.E01")
    image = containers.open_image(str(tmp_path / "case.E01"))
    same(image)
    assert image.digests == {"md5": "11" * 16}


def test_dmg():
    runs, data = [], b""
    for i, (kind, pack) in enumerate(((0x80000005, zlib.compress), (0x80000006, bz2.compress), (1, bytes))):
        raw = DISK[i * 8192 : (i + 1) * 8192]
        runs.append((kind, i * 16, 16, len(data), len(z := pack(raw))))
        data += z
    runs.append((2, 48, 4, 0, 0))
    blk = b"mish".ljust(200, b"\0") + struct.pack(">I", len(runs) + 1) + b"".join(struct.pack(">IIQQQQ", k, 0, s, n, at, z) for k, s, n, at, z in runs) + struct.pack(">IIQQQQ", 0xFFFFFFFF, 0, 52, 0, 0, 0)
    xml = plistlib.dumps({"resource-fork": {"blkx": [{"Data": blk}]}})
    trailer = bytearray(512)
    trailer[:4] = b"koly"
    struct.pack_into(">QQ", trailer, 216, len(data), len(xml))
    same(containers.Dmg(MemoryBytes(data + xml + bytes(trailer))), DISK[: 3 * 8192] + bytes(2048))


def test_raid():
    stripe, n = 512, 3
    disk = DISK[: stripe * 2 * 40]
    members = [bytearray() for _ in range(n)]
    for row in range(40):
        a, b = (disk[(row * 2 + k) * stripe :][:stripe] for k in (0, 1))
        p = bytes(x ^ y for x, y in zip(a, b, strict=True))
        parity = n - 1 - row % n
        for k, part in enumerate((p, a, b)):
            members[(parity + k) % n] += part
    held = [MemoryBytes(bytes(m)) for m in members]
    same(containers.Raid(held, 5, stripe), disk)
    for lost in range(n):
        same(containers.Raid([None if i == lost else m for i, m in enumerate(held)], 5, stripe), disk)
    same(containers.Raid([MemoryBytes(disk), None], 1, stripe), disk)
    with pytest.raises(ValueError):
        containers.Raid([None, None, held[2]], 5, stripe)


def mbr(*entries):
    raw = bytearray(512)
    for i, (kind, start, count) in enumerate(entries):
        raw[446 + 16 * i + 4] = kind
        struct.pack_into("<II", raw, 446 + 16 * i + 8, start, count)
    raw[510:] = b"\x55\xaa"
    return bytes(raw)


def test_partitions():
    disk = bytearray(400 * 512)
    disk[:512] = mbr((7, 10, 50), (5, 100, 200))
    disk[100 * 512 : 101 * 512] = mbr((0x83, 5, 20), (5, 50, 100))
    disk[150 * 512 : 151 * 512] = mbr((0x83, 5, 20))
    disk[10 * 512 + 3 : 10 * 512 + 11] = b"NTFS    "
    got = [(p["kind"], p["offset"] // 512, p["size"] // 512, p["fs"]) for p in volumes.scan(MemoryBytes(bytes(disk)))]
    assert got == [("gap", 0, 10, None), ("partition", 10, 50, "ntfs"), ("gap", 60, 45, None), ("partition", 105, 20, None), ("gap", 125, 30, None), ("partition", 155, 20, None), ("gap", 175, 225, None)]


def test_gpt():
    disk = bytearray(200 * 512)
    disk[:512] = mbr((0xEE, 1, 199))
    kind = uuid.UUID("ebd0a0a2-b9e5-4433-87c0-68b6b72699c7")
    disk[1024 : 1024 + 128] = kind.bytes_le + bytes(16) + struct.pack("<QQQ", 40, 99, 0) + "Data".encode("utf-16-le").ljust(72, b"\0")
    head = bytearray(b"EFI PART" + struct.pack("<II", 0x10000, 92) + bytes(76))
    struct.pack_into("<QII", head, 72, 2, 4, 128)
    struct.pack_into("<I", head, 16, zlib.crc32(bytes(head)))
    disk[512 : 512 + 92] = head
    got = [p for p in volumes.scan(MemoryBytes(bytes(disk))) if p["kind"] == "partition"]
    assert [(p["offset"] // 512, p["size"] // 512, p["type"], p["name"], p["note"]) for p in got] == [(40, 60, str(kind), "Data", "")]
    disk[512 + 40] ^= 1
    assert [p["note"] for p in volumes.scan(MemoryBytes(bytes(disk))) if p["kind"] == "partition"] == ["header checksum differs"]


def fat12():
    """One FAT12 volume with a file under a long name, a directory with a file in two clusters, and a deleted file."""
    disk = bytearray(512 * 200)
    struct.pack_into("<HBHBHH", disk, 11, 512, 1, 1, 1, 16, 200)
    struct.pack_into("<H", disk, 22, 1)
    disk[54:62] = b"FAT12   "
    table = [0xFF8, 0xFFF, 0xFFF, 0xFFF, 5, 0xFFF]
    for i, v in enumerate(table):
        at = 512 + i * 3 // 2
        old = int.from_bytes(disk[at : at + 2], "little")
        disk[at : at + 2] = (old & 0xF | v << 4 if i & 1 else old & 0xF000 | v).to_bytes(2, "little")

    def short(name, attribute, cluster, size):
        return name + bytes([attribute, 0, 0]) + struct.pack("<HHHHHHHI", 0x6000, 0x5821, 0x5821, 0, 0x6000, 0x5821, cluster, size)

    check = 0
    for x in b"LONGNA~1TXT":
        check = (check >> 1 | (check & 1) << 7) + x & 0xFF
    u = "long name.txt".encode("utf-16-le") + b"\0\0" + b"\xff" * 40
    long = [bytes([1, *u[:10], 0x0F, 0, check, *u[10:22], 0, 0, *u[22:26]]), bytes([0x42, *u[26:36], 0x0F, 0, check, *u[36:48], 0, 0, *u[48:52]])]
    root = long[1] + long[0] + short(b"LONGNA~1TXT", 0x20, 2, 5) + short(b"SUB        ", 0x10, 3, 0) + short(b"\xe5ONE    DAT", 0x20, 9, 700)
    disk[1024 : 1024 + len(root)] = root
    data = 1024 + 512
    disk[data : data + 5] = b"hello"
    sub = short(b".          ", 0x10, 3, 0) + short(b"TWO     BIN", 0x20, 4, 600)
    disk[data + 512 : data + 512 + len(sub)] = sub
    disk[data + 1024 : data + 1624] = b"z" * 600
    return bytes(disk)


def test_fat():
    fs = filesystems.open_filesystem(MemoryBytes(fat12()))
    got = {e["path"]: e for e in fs.entries()}
    assert set(got) == {"/long name.txt", "/SUB", "/SUB/TWO.BIN", "/_ONE.DAT"}
    assert fs.read(got["/long name.txt"]["runs"], 5) == b"hello"
    assert fs.read(got["/SUB/TWO.BIN"]["runs"], 600) == b"z" * 600
    assert got["/_ONE.DAT"]["deleted"]
    assert got["/SUB"]["is_dir"]
    assert got["/long name.txt"]["created"] == "2024-01-01T12:00:00"


def ntfs():
    """A small NTFS volume: root, a directory, a file in it with a stream, and a deleted file."""
    cluster, disk = 1024, bytearray(1024 * 64)
    disk[3:11] = b"NTFS    "
    struct.pack_into("<HB", disk, 11, 512, 2)
    struct.pack_into("<Q", disk, 48, 4)
    disk[64] = 256 - 10

    def resident(kind, value, name=""):
        n = name.encode("utf-16-le")
        start = 24 + len(n) + -len(n) % 8
        size = start + len(value) + -(start + len(value)) % 8
        return (struct.pack("<IIBBHHHIHH", kind, size, 0, len(name), 24, 0, 0, len(value), start, 0) + n).ljust(start, b"\0") + value.ljust(size - start, b"\0")

    def away(kind, size, runs):
        return struct.pack("<IIBBHHHQQHHIQQQ", kind, 64 + 8, 1, 0, 64, 0, 0, 0, 0, 64, 0, 0, size, size, size) + runs.ljust(8, b"\0")

    def named(parent, name, space=1):
        t = 133_500_000_000_000_000
        return struct.pack("<Q4QQQII", parent | 1 << 48, t, t, t, t, 0, 0, 0, 0) + bytes([len(name), space]) + name.encode("utf-16-le")

    def record(n, flags, attributes):
        raw = bytearray(1024)
        struct.pack_into("<4sHH", raw, 0, b"FILE", 48, 3)
        struct.pack_into("<HH", raw, 20, 56, flags)
        body = b"".join(attributes) + struct.pack("<I", 0xFFFFFFFF)
        raw[56 : 56 + len(body)] = body
        raw[48:50] = b"\x07\x00"
        raw[50:52], raw[52:54] = raw[510:512], raw[1022:1024]
        raw[510:512] = raw[1022:1024] = b"\x07\x00"
        disk[(4 + n) * cluster : (5 + n) * cluster] = raw

    si = resident(0x10, struct.pack("<4Q", *[133_490_000_000_000_000] * 4) + bytes(16))
    record(0, 1, [si, resident(0x30, named(5, "$MFT")), away(0x80, 10 * 1024, b"\x11\x0a\x04")])
    record(5, 3, [si, resident(0x30, named(5, "."))])
    record(6, 3, [si, resident(0x30, named(5, "Docs"))])
    record(7, 1, [si, resident(0x30, named(6, "REPORT~1.TXT", 2)), resident(0x30, named(6, "report 1.txt")), away(0x80, 1500, b"\x11\x02\x14"), resident(0x80, b"abc", "Zone.Identifier")])
    record(8, 0, [si, resident(0x30, named(6, "gone.txt")), resident(0x80, b"xy")])
    disk[20 * cluster : 20 * cluster + 1500] = b"r" * 1500
    return bytes(disk)


def test_ntfs_through_spark(spark, tmp_path):
    (tmp_path / "n.dd").write_bytes(ntfs())
    formats.register(spark)
    df = formats.with_paths(spark.read.format("evidence_entries").option("evidenceId", 3).load(str(tmp_path / "n.dd")))
    got = {r["path"]: r for r in df.collect()}
    assert {"/Docs", "/Docs/report 1.txt", "/Docs/gone.txt"} <= set(got)
    e = got["/Docs/report 1.txt"]
    assert (e["size"], e["deleted"], e["evidence_id"], [s["name"] for s in e["streams"]]) == (1500, False, 3, ["Zone.Identifier"])
    assert got["/Docs/gone.txt"]["deleted"]
    assert e["created"] < e["fn_created"]
    fs = filesystems.open_filesystem(FileBytes(str(tmp_path / "n.dd")))
    assert fs.read([r.asDict() for r in e["runs"]], 1500) == b"r" * 1500


def test_blocks_and_volumes_through_spark(spark, tmp_path):
    ewf(DISK, tmp_path / "case.E01")
    formats.register(spark)
    df = spark.read.format("evidence_blocks").option("blockBytes", 8192).option("partitionBytes", 32768).load(str(tmp_path / "case.E01"))
    assert b"".join(bytes(r["data"]) for r in df.orderBy("offset").collect()) == DISK
    assert df.rdd.getNumPartitions() == -(-len(DISK) // 32768)
    (tmp_path / "d.dd").write_bytes(mbr((7, 1, 5)) + bytes(20 * 512))
    assert spark.read.format("evidence_volumes").load(str(tmp_path / "d.dd")).where("kind = 'partition'").count() == 1


def files(spark, **named):
    return spark.createDataFrame([(n, bytearray(b)) for n, b in named.items()], "path string, content binary")


def usn_record(name, seq, reason, mft=40):
    n = name.encode("utf-16-le")
    size = 60 + len(n) + -(60 + len(n)) % 8
    return struct.pack("<IHHQQqqIIIIHH", size, 2, 0, mft | 3 << 48, 5 | 1 << 48, seq, 133_500_000_000_000_000, reason, 0, 7, 0x20, len(n), 60).ljust(60, b"\0")[:60] + n.ljust(size - 60, b"\0")


def test_journal(spark):
    raw = usn_record("a.txt", 8, 0x100) + bytes(64) + b"\x99" * 16 + usn_record("b.txt", 16, 0x80000200 | 1 << 27)
    got = formats.decode(files(spark, j=raw), "usn").orderBy("usn").collect()
    assert [(r["name"], r["mft"], r["seq"], r["reasons"]) for r in got] == [("a.txt", 40, 3, ["created"]), ("b.txt", 40, 3, ["deleted", "close", "unknown 0x8000000"])]


def test_sqlite(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "x.db")
    con.execute('CREATE TABLE "t" (id INTEGER PRIMARY KEY, name TEXT, f REAL, b BLOB, UNIQUE(name))')
    rows = [(i, f"n{i}" * (i % 900 + 1), i / 3, bytes(i % 50)) for i in range(1, 3000)]
    con.executemany("INSERT INTO t VALUES (?,?,?,?)", rows)
    con.execute("ALTER TABLE t ADD COLUMN extra")
    con.commit()
    con.close()
    raw = (tmp_path / "x.db").read_bytes()
    got = [(r["id"], r["name"], r["f"], r["b"]) for r in records.Sqlite(raw).read("t")]
    assert got == rows
    df = formats.decode(files(spark, good=raw, bad=b"nothing"), "sqlite", "t")
    assert df.where("error is null").count() == 2999
    assert df.where("file = 'bad'").first()["error"].startswith("ValueError")
    assert json.loads(df.where("rowid = 3").first()["row"])["name"] == "n3" * 4


def hive(tree=None):
    cells = bytearray(32)

    def cell(body):
        at = len(cells)
        size = 4 + len(body) + -(4 + len(body)) % 8
        cells.extend(struct.pack("<i", -size) + body.ljust(size - 4, b"\0"))
        return at

    def key(name, children=(), vals=()):
        listed = cell(b"lf" + struct.pack("<H", len(children)) + b"".join(struct.pack("<I4s", c, b"") for c in children)) if children else 0xFFFFFFFF
        held = cell(struct.pack(f"<{len(vals)}I", *vals)) if vals else 0xFFFFFFFF
        return cell(b"nk" + struct.pack("<HQIIIIIIIIII", 0x20, 133_500_000_000_000_000, 0, 0, len(children), 0, listed, 0xFFFFFFFF, len(vals), held, 0, 0).ljust(70, b"\0") + struct.pack("<HH", len(name), 0) + name.encode())

    def value(name, kind, raw):
        where, size = (int.from_bytes(raw.ljust(4, b"\0"), "little"), len(raw) | 1 << 31) if len(raw) <= 4 else (cell(raw), len(raw))
        return cell(b"vk" + struct.pack("<HIIIHH", len(name), size, where, kind, 1, 0) + name.encode())

    if tree:
        root = tree(key, value)
        return b"regf".ljust(36, b"\0") + struct.pack("<I", root) + bytes(4096 - 40) + bytes(cells)
    leaf = key("Run", vals=(value("App", 1, "C:\\a.exe\0".encode("utf-16-le")), value("N", 4, struct.pack("<I", 7))))
    root = key("ROOT", children=(key("Software", children=(leaf,)), key("Empty")))
    return b"regf".ljust(36, b"\0") + struct.pack("<I", root) + bytes(4096 - 40) + bytes(cells)


def test_hive(spark):
    got = {(r["path"], r["name"], r["value"]) for r in formats.decode(files(spark, h=hive()), "hive").collect()}
    assert got == {("", None, None), ("Software", None, None), ("Software\\Run", "App", "C:\\a.exe"), ("Software\\Run", "N", "7"), ("Empty", None, None)}


def test_event_log(spark):
    chunk = bytearray(65536)
    chunk[:8] = b"ElfChnk\0"

    def name(at, text):
        return struct.pack("<IHH", 0, 0, len(text)) + text.encode("utf-16-le") + b"\0\0"

    base = 512 + 24
    body = bytearray(b"\x0f\x01\x01\x00\x0c\x01" + struct.pack("<II", 1, base + 14))
    template_at = base + 14
    inner = bytearray(b"\x0f\x01\x01\x00")

    def element(text, content):
        at = template_at + 24 + len(inner) + 11
        inner.extend(b"\x01\xff\xff" + struct.pack("<II", 0, at) + name(at, text) + b"\x02")
        content()
        inner.extend(b"\x04")

    element("Event", lambda: [element("EventID", lambda: inner.extend(b"\x0d\x00\x00\x06")), element("Data", lambda: inner.extend(b"\x0e\x01\x00\x01")), element("Data", lambda: inner.extend(b"\x05\x01\x02\x00" + "hi".encode("utf-16-le")))])
    inner += b"\x00"
    values = struct.pack("<H", 4624) + "Bob".encode("utf-16-le")
    body += bytes(20) + struct.pack("<I", len(inner)) + inner + struct.pack("<IHBBHBB", 2, 2, 6, 0, 6, 1, 0) + values
    size = 24 + len(body) + 4
    chunk[512 : 512 + size] = struct.pack("<4sIQQ", b"\x2a\x2a\0\0", size, 9, 133_500_000_000_000_000) + body + struct.pack("<I", size)
    raw = b"ElfFile\0".ljust(4096, b"\0") + bytes(chunk)
    r = formats.decode(files(spark, e=raw), "evtx").first()
    assert (r["record_id"], r["undecoded"]) == (9, False)
    assert r["fields"] == {"Event/EventID": "4624", "Event/Data": "Bob", "Event/Data#2": "hi"}
    chunk[base + 20 : base + 90] = b"\xee" * 70
    assert formats.decode(files(spark, e=raw[:4096] + bytes(chunk)), "evtx").first()["undecoded"]


def test_small_records(spark, tmp_path):
    path = "C:\\x\\y.txt\0".encode("utf-16-le")
    item = struct.pack("<QQQI", 2, 77, 133_500_000_000_000_000, len(path) // 2) + path
    assert formats.decode(files(spark, i=item), "recycle").first()["original_path"] == "C:\\x\\y.txt"
    link = bytes.fromhex("4c0000000114020000000000c000000000000046") + struct.pack("<IIQQQI", 0x80 | 8 | 32, 0, 0, 0, 133_500_000_000_000_000, 5).ljust(56, b"\0")
    for t in ("..\\a.exe", "-x"):
        link += struct.pack("<H", len(t)) + t.encode("utf-16-le")
    r = formats.decode(files(spark, s=link), "shortcut").first()
    assert (r["relative_path"], r["arguments"], r["target_created"], r["target_size"]) == ("..\\a.exe", "-x", None, 5)
    names = "\\A\\B.DLL\0\\C\0".encode("utf-16-le")
    pf = bytearray(320)
    struct.pack_into("<I4s", pf, 0, 23, b"SCCA")
    pf[16:30] = "APP.EXE".encode("utf-16-le")
    struct.pack_into("<I", pf, 76, 0xABCD)
    struct.pack_into("<II", pf, 100, 320, len(names))
    struct.pack_into("<Q", pf, 128, 133_500_000_000_000_000)
    struct.pack_into("<I", pf, 152, 12)
    r = formats.decode(files(spark, p=bytes(pf) + names), "prefetch").first()
    assert (r["program"], r["hash"], r["run_count"], r["files"]) == ("APP.EXE", "0000ABCD", 12, ["\\A\\B.DLL", "\\C"])
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a/b.txt", "text")
    assert formats.decode(files(spark, z=(tmp_path / "z.zip").read_bytes()), "zip").first()["name"] == "a/b.txt"
    (tmp_path / "m.mbox").write_text("From a Mon Jan  1 00:00:00 2024\nFrom: A <a@x>\nSubject: =?utf-8?q?caf=C3=A9?=\nDate: Mon, 01 Jan 2024 10:00:00 +0000\n\nbody\n\n")
    m = next(records.mbox(str(tmp_path / "m.mbox")))
    assert (m["subject"], m["sent_at"], m["text"].strip()) == ("café", "2024-01-01T10:00:00+00:00", "body")


def test_leveldb(spark):
    batch = struct.pack("<QI", 5, 2) + b"\x01\x01a\x02xy" + b"\x00\x01b"
    log = bytes(4) + struct.pack("<HB", len(batch), 1) + batch
    got = [(r["sequence"], bytes(r["key"]), r["value"] and bytes(r["value"]), r["deleted"]) for r in formats.decode(files(spark, g=log), "leveldb_log").collect()]
    assert got == [(5, b"a", b"xy", False), (6, b"b", None, True)]

    def block(pairs):
        return b"".join(bytes([0, len(k), len(v)]) + k + v for k, v in pairs) + struct.pack("<II", 0, 1)

    data = block([(b"k" + struct.pack("<Q", 9 << 8 | 1), b"v")])
    index = block([(b"k", bytes([0, len(data)]))])
    table = data + b"\0" * 5 + index + b"\0" * 5
    foot = bytes([0, 0, len(data) + 5, len(index)]).ljust(40, b"\0") + bytes.fromhex("57fb808b247547db")
    assert list(records.leveldb_table(table + foot)) == [{"sequence": 9, "key": b"k", "value": b"v", "deleted": False}]


def test_codecs():
    assert codecs.inflate(zlib.compress(b"abc" * 1000), 50) == (b"abc" * 17)[:50]
    assert codecs.snappy(b"\x0a\x08abc\x0d\x03") == b"abcabcabca"
    with pytest.raises(ValueError):
        codecs.snappy(b"\x0a\x0d\x03")
    packed = b"\x08abc" + struct.pack("<H", 2 << 12 | 4)
    assert codecs.lznt1(struct.pack("<H", 0xB000 | len(packed) - 1) + packed) == b"abcabcabca"
    stored = b"plain"
    assert codecs.lznt1(struct.pack("<H", 0x3000 | len(stored) - 1) + stored) == stored


def test_stix_and_folder(spark, tmp_path):
    bundle = {"objects": [
        {"type": "attack-pattern", "id": "b", "name": "Late", "external_references": [{"external_id": "T1"}], "kill_chain_phases": [{"phase_name": "x"}]},
        {"type": "attack-pattern", "id": "a", "name": "First", "external_references": [{"external_id": "T1"}], "kill_chain_phases": [{"phase_name": "y"}]},
        {"type": "attack-pattern", "id": "c", "name": "Gone", "revoked": True, "external_references": [{"external_id": "T2"}], "kill_chain_phases": []},
        {"type": "identity", "id": "d", "name": "Who"},
    ]}
    (tmp_path / "s.json").write_text(json.dumps(bundle))
    assert [tuple(r) for r in formats.read_stix(spark, str(tmp_path / "s.json")).collect()] == [("T1", "First", "y")]
    assert formats.listing_of(spark, str(tmp_path)).where(F.col("name") == "s.json").count() == 1


def test_vhdx():
    block, n = 1 << 20, 3
    disk = random.Random(5).randbytes(block) + bytes(block) + random.Random(6).randbytes(block)
    raw = bytearray(8 << 20)
    raw[:8] = b"vhdxfile"
    raw[64 << 10 : (64 << 10) + 4] = b"head"
    reg = b"regi" + struct.pack("<III", 0, 2, 0)
    reg += uuid.UUID("2dc27766f62342009d64115e9bfd4a08").bytes_le + struct.pack("<QII", 2 << 20, 64, 1) + uuid.UUID("8b7ca20647904b9ab8fe575f050f886e").bytes_le + struct.pack("<QII", 3 << 20, 1 << 20, 1)
    raw[192 << 10 : (192 << 10) + len(reg)] = reg
    meta = b"metadata" + struct.pack("<HH", 0, 3) + bytes(20)
    for i, (g, size) in enumerate((("caa16737fa364d43b3b633f0aa44e76b", 8), ("2fa54224cd1b4876b2115dbed83bf4b8", 8), ("8141bf1da96f4709ba47f233a8faab5f", 4))):
        meta += uuid.UUID(g).bytes_le + struct.pack("<IIII", 65536 + 16 * i, size, 0, 0)
    raw[3 << 20 : (3 << 20) + len(meta)] = meta
    struct.pack_into("<Q", raw, (3 << 20) + 65536, block)
    struct.pack_into("<Q", raw, (3 << 20) + 65552, n * block)
    struct.pack_into("<I", raw, (3 << 20) + 65568, 512)
    struct.pack_into("<3Q", raw, 2 << 20, 5 << 20 | 6, 0, 4 << 20 | 6)
    raw[5 << 20 : 6 << 20] = disk[:block]
    raw[4 << 20 : 5 << 20] = disk[2 * block :]
    same(containers.Vhdx(MemoryBytes(bytes(raw))), disk)
    raw[(64 << 10) + 48] = 1
    with pytest.raises(ValueError):
        containers.Vhdx(MemoryBytes(bytes(raw)))


def test_exfat():
    disk = bytearray(512 * 40)
    disk[3:11] = b"EXFAT   "
    struct.pack_into("<IIIII", disk, 80, 2, 1, 4, 30, 2)
    disk[108], disk[109] = 9, 0
    struct.pack_into("<8I", disk, 1024, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 6, 0, 0xFFFFFFFF, 0)

    def entries(name, attributes, start, size, straight=False, live=True):
        n = name.encode("utf-16-le")
        top = 0x80 if live else 0
        count = 1 + -(-len(n) // 30)
        out = bytes([top | 5, count]) + bytes(2) + struct.pack("<HHIII", attributes, 0, 0x58216000, 0x58216000, 0x58210000).ljust(28, b"\0")
        out += bytes([top | 0x40, 3 if straight else 1, 0, len(name)]) + bytes(16) + struct.pack("<IQ", start, size)
        for i in range(0, len(n), 30):
            out += bytes([top | 0x41, 0]) + n[i : i + 30].ljust(30, b"\0")
        return out

    data = 4 * 512
    root = entries("A directory with a long name", 0x10, 3, 512) + entries("two.bin", 0x20, 4, 700) + entries("gone", 0x20, 9, 600, live=False)
    disk[data : data + len(root)] = root
    sub = entries("s.txt", 0x20, 8, 3, straight=True)
    disk[data + 512 : data + 512 + len(sub)] = sub
    disk[data + 1024 : data + 1536], disk[data + 2048 : data + 2236] = b"x" * 512, b"y" * 188
    disk[data + 3072 : data + 3075] = b"abc"
    fs = filesystems.open_filesystem(MemoryBytes(bytes(disk)))
    got = {e["path"]: e for e in fs.entries()}
    assert set(got) == {"/A directory with a long name", "/A directory with a long name/s.txt", "/two.bin", "/gone"}
    assert fs.read(got["/two.bin"]["runs"], 700) == b"x" * 512 + b"y" * 188
    assert fs.read(got["/A directory with a long name/s.txt"]["runs"], 3) == b"abc"
    assert got["/gone"]["deleted"]
    assert got["/two.bin"]["created"] == "2024-01-01T12:00:00"


def test_ext():
    disk = bytearray(1024 * 64)
    struct.pack_into("<II", disk, 1024, 32, 64)
    struct.pack_into("<III", disk, 1024 + 20, 1, 0, 0)
    struct.pack_into("<I", disk, 1024 + 40, 32)
    disk[1024 + 56 : 1024 + 58] = b"\x53\xef"
    struct.pack_into("<I", disk, 1024 + 76, 1)
    struct.pack_into("<H", disk, 1024 + 88, 256)
    struct.pack_into("<I", disk, 1024 + 96, 0x40)
    struct.pack_into("<I", disk, 2048 + 8, 4)

    def inode(n, mode, size, flags, body, deleted=0, links=1):
        raw = bytearray(256)
        struct.pack_into("<HHIIIIIHH", raw, 0, mode, 0, size, 1704110400, 1704110400, 1704110400, deleted, 0, links)
        struct.pack_into("<I", raw, 32, flags)
        raw[40 : 40 + len(body)] = body
        struct.pack_into("<H", raw, 128, 28)
        struct.pack_into("<I", raw, 132 + 12, 1704110401)
        disk[4096 + (n - 1) * 256 : 4096 + n * 256] = raw

    def names(*pairs):
        out = b""
        for i, (n, name) in enumerate(pairs):
            size = 8 + len(name) + -len(name) % 4
            out += struct.pack("<IHBB", n, 1024 - len(out) if i == len(pairs) - 1 else size, len(name), 0) + name.encode().ljust(size - 8, b"\0")
        return out.ljust(1024, b"\0")

    extent = lambda *rows: struct.pack("<HHHHI", 0xF30A, len(rows), 4, 0, 0) + b"".join(struct.pack("<IHHI", f, c, 0, b) for f, c, b in rows)
    inode(2, 0x41ED, 1024, 0x80000, extent((0, 1, 20)))
    inode(11, 0x41ED, 1024, 0x80000, extent((0, 1, 21)))
    inode(12, 0x81A4, 3500, 0x80000, extent((0, 1, 22), (3, 1, 23)))
    inode(13, 0x81A4, 1500, 0, struct.pack("<2I", 24, 30))
    disk[20 * 1024 : 21 * 1024] = names((2, "."), (2, ".."), (11, "dir"), (12, "sparse.bin"))
    disk[21 * 1024 : 22 * 1024] = names((11, "."), (2, ".."), (13, "mapped"))
    for b, c in ((22, b"a"), (23, b"b"), (24, b"c"), (30, b"d")):
        disk[b * 1024 : (b + 1) * 1024] = c * 1024
    fs = filesystems.open_filesystem(MemoryBytes(bytes(disk)))
    got = {e["path"]: e for e in fs.entries()}
    assert set(got) == {"/dir", "/sparse.bin", "/dir/mapped"}
    assert fs.read(got["/sparse.bin"]["runs"], 3500) == b"a" * 1024 + bytes(2048) + b"b" * 428
    assert fs.read(got["/dir/mapped"]["runs"], 1500) == b"c" * 1024 + b"d" * 476
    assert got["/dir/mapped"]["created"] == "2024-01-01T12:00:01.000000Z"


def test_hfs_plus():
    block, disk = 512, bytearray(512 * 120)
    head = bytearray(512)
    head[:2] = b"H+"
    struct.pack_into(">I", head, 40, block)

    def fork(size, *extents):
        return struct.pack(">QII", size, 0, sum(n for _, n in extents)) + b"".join(struct.pack(">II", *e) for e in extents).ljust(64, b"\0")

    head[192:272] = fork(1024, (10, 2))
    head[272:352] = fork(1536, (20, 3))
    disk[1024:1536] = head

    def tree(at, *records):
        top = struct.pack(">IIBBHH", 0, 0, 1, 0, 3, 0) + struct.pack(">HIIIIH", 1, 1, len(records), 1 if records else 0, 1, 512)
        disk[at * 512 : at * 512 + len(top)] = top
        node, offsets = bytearray(512), [14]
        struct.pack_into(">IIBBH", node, 0, 0, 0, 0xFF, 1, len(records))
        for r in records:
            node[offsets[-1] : offsets[-1] + len(r)] = r
            offsets.append(offsets[-1] + len(r))
        for i, o in enumerate(offsets):
            struct.pack_into(">H", node, 510 - 2 * i, o)
        disk[(at + 1) * 512 : (at + 2) * 512] = node

    def key(parent, name):
        n = name.encode("utf-16-be")
        return struct.pack(">HIH", 6 + len(n), parent, len(name)) + n

    when = 3786912000
    folder = key(2, "Docs") + struct.pack(">HHIIIIII", 1, 0, 1, 16, when, when, 0, 0).ljust(88, b"\0")
    file = key(16, "a/b") + struct.pack(">HHIIIIII", 2, 0, 0, 17, when, when, 0, 0).ljust(88, b"\0") + fork(512 * 9, *[(40 + 2 * i, 1) for i in range(8)], (0, 1))[:80] + bytes(80)
    tree(20, folder, file)
    tree(10, struct.pack(">HBBII", 10, 0, 0, 17, 8) + struct.pack(">II", 90, 1).ljust(64, b"\0"))
    for i in range(8):
        disk[(40 + 2 * i) * 512 : (41 + 2 * i) * 512] = bytes([i + 1]) * 512
    disk[90 * 512 : 91 * 512] = b"\x09" * 512
    fs = filesystems.open_filesystem(MemoryBytes(bytes(disk)))
    got = {e["name"]: e for e in fs.entries()}
    assert (got["Docs"]["node"], got["a:b"]["parent"], got["a:b"]["created"]) == ("16", "16", "2024-01-01T00:00:00.000000Z")
    assert fs.read(got["a:b"]["runs"], got["a:b"]["size"]) == b"".join(bytes([i + 1]) * 512 for i in range(9))


def test_ntfs_log(spark):
    def record(lsn, redo, undo, body=b""):
        data = struct.pack("<6H", redo, undo, 32, len(body), 0, 0).ljust(32, b"\0") + body
        return (struct.pack("<QQQIIII", lsn, 0, 0, len(data), 0, 1, 7).ljust(48, b"\0") + data).ljust(48 + len(data) + -len(data) % 8, b"\0")

    name = "gone.txt".encode("utf-16-le")
    entry = struct.pack("<QHH", 40, 16 + 66 + len(name), 66 + len(name)).ljust(16, b"\0") + bytes(64) + bytes([8, 1]) + name
    page = bytearray(4096)
    page[:4] = b"RCRD"
    struct.pack_into("<HH", page, 4, 40, 9)
    body = record(300, 15, 14, entry) + record(200, 2, 0)
    page[64 : 64 + len(body)] = body
    page[40:42] = b"\x05\0"
    for i in range(1, 9):
        page[40 + 2 * i : 42 + 2 * i] = page[512 * i - 2 : 512 * i]
        page[512 * i - 2 : 512 * i] = b"\x05\0"
    torn = bytearray(page)
    torn[510] = 9
    got = formats.decode(files(spark, g=bytes(page) + bytes(torn)), "ntfs_log").collect()
    assert [(r["lsn"], r["redo"], r["undo"], r["names"]) for r in got] == [(200, "InitializeFileRecordSegment", "Noop", []), (300, "DeleteIndexEntryAllocation", "AddIndexEntryAllocation", ["gone.txt"])]


def test_shim_cache_and_shellbags(spark):
    path = "C:\\x.exe".encode("utf-16-le")
    one = b"10ts" + bytes(4) + struct.pack("<IH", 2 + len(path) + 8 + 4, len(path)) + path + struct.pack("<QI", 133_500_000_000_000_000, 0)
    got = formats.decode(files(spark, s=bytes(52) + one + one), "shim_cache").collect()
    assert [r["program"] for r in got] == ["C:\\x.exe"] * 2
    item = lambda kind, rest: struct.pack("<HBB", 4 + len(rest), kind, 0) + rest + b"\0\0"
    volume = struct.pack("<HB", 3 + 4, 0x2F) + b"C:\\\0" + b"\0\0"
    folder = item(0x31, struct.pack("<IHHH", 0, 0x5821, 0x6000, 0) + b"USERS\0")
    bags = hive(lambda key, value: key("ROOT", children=(key("BagMRU", children=(key("0", vals=(value("0", 3, folder),)),), vals=(value("0", 3, volume), value("MRUListEx", 3, b"\0" * 8))),)))
    got = formats.decode(files(spark, h=bags), "shellbags").collect()
    assert [(r["folder"], r["kind"]) for r in got] == [("C:\\", "volume"), ("C:\\\\USERS", "folder")]


def test_aff4(tmp_path):
    base, size = "aff4://1f-2", 4096
    stream = f"{base}/stream"
    turtle = f"""@prefix aff4: <http://aff4.org/Schema#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .

<{base}> a aff4:DiskImage ;
    aff4:dataStream <aff4://1f-2/map> ;
    aff4:size "{len(DISK)}"^^xsd:long .
<aff4://1f-2/map> a aff4:Map ;
    aff4:size "{len(DISK)}"^^xsd:long .
<{stream}> a aff4:ImageStream ;
    aff4:chunkSize "{size}"^^xsd:int ;
    aff4:chunksInSegment "4"^^xsd:int ;
    aff4:compressionMethod <https://www.ietf.org/rfc/rfc1950.txt> .
"""
    held, spans, at = b"", [], 0
    for a in range(0, len(DISK), 10_000):
        part = DISK[a : a + 10_000]
        if any(part):
            spans.append((a, len(part), len(held), 0))
            held += part
        else:
            spans.append((a, len(part), 0, 1))
    with zipfile.ZipFile(tmp_path / "d.aff4", "w") as z:
        z.writestr("information.turtle", turtle)
        z.writestr("aff4%3A//1f-2/map/map", b"".join(struct.pack("<QQQI", *s) for s in spans))
        z.writestr("aff4%3A//1f-2/map/idx", f"{stream}\naff4:Zero")
        for bevy in range(-(-len(held) // (4 * size))):
            body, index = b"", b""
            for c in range(4):
                raw = held[(bevy * 4 + c) * size :][:size]
                packed = zlib.compress(raw)
                packed = raw if len(packed) >= size and len(raw) == size else packed
                index += struct.pack("<QI", len(body), len(packed))
                body += packed
            z.writestr(f"aff4%3A//1f-2/stream/{bevy:08d}", body)
            z.writestr(f"aff4%3A//1f-2/stream/{bevy:08d}.index", index)
    same(containers.open_image(str(tmp_path / "d.aff4")))


def test_apfs(spark, tmp_path):
    block = 4096
    disk = bytearray(block * 32)

    def put(n, raw):
        disk[n * block : n * block + len(raw)] = raw

    def obj(oid, xid):
        return bytes(8) + struct.pack("<QQII", oid, xid, 0, 0)

    def leaf(records, fixed, oid=1, xid=5, level=0):
        raw = bytearray(block)
        raw[:32] = obj(oid, xid)
        width = 4 if fixed else 8
        toc = width * len(records)
        struct.pack_into("<HHIHH", raw, 32, 1 | (0 if level else 2) | (4 if fixed else 0), level, len(records), 0, toc)
        key_at, value_at = 0, 0
        for i, (k, v) in enumerate(records):
            value_at += len(v)
            raw[56 + toc + key_at : 56 + toc + key_at + len(k)] = k
            end = block - 40 - value_at
            raw[end : end + len(v)] = v
            struct.pack_into("<HH" if fixed else "<HHHH", raw, 56 + width * i, *((key_at, value_at) if fixed else (key_at, len(k), value_at, len(v))))
            key_at += len(k)
        return bytes(raw)

    def superblock(xid, omap):
        raw = bytearray(block)
        raw[:32] = obj(1, xid)
        raw[32:36] = b"NXSB"
        struct.pack_into("<IQ", raw, 36, block, 32)
        struct.pack_into("<I", raw, 104, 2)
        struct.pack_into("<Q", raw, 112, 1)
        struct.pack_into("<Q", raw, 160, omap)
        struct.pack_into("<Q", raw, 184, 1026)
        return bytes(raw)

    def omap(tree):
        return (obj(9, 5) + struct.pack("<IIII", 0, 0, 0, 0) + struct.pack("<Q", tree)).ljust(block, b"\0")

    mapped = lambda *rows: leaf([(struct.pack("<QQ", o, x), struct.pack("<IIQ", 0, block, p)) for o, x, p in rows], True)
    put(0, superblock(3, 30))
    put(1, superblock(5, 4))
    put(2, superblock(4, 30))
    put(4, omap(5))
    put(5, mapped((1026, 4, 29), (1026, 5, 6), (1026, 9, 28)))
    vol = bytearray(block)
    vol[:32], vol[32:36] = obj(1026, 5), b"APSB"
    struct.pack_into("<QQ", vol, 128, 7, 77)
    vol[704:708] = b"Data"
    put(6, bytes(vol))
    put(7, omap(8))
    put(8, mapped((77, 5, 9), (78, 5, 10)))

    def inode(parent, private, mode, size=None):
        raw = struct.pack("<QQ4Q", parent, private, *[1_704_110_400_000_000_000] * 4).ljust(80, b"\0") + struct.pack("<H", mode) + bytes(10)
        return raw + (struct.pack("<HHBBH", 2, 0, 4, 0, 3) + struct.pack("<BBH", 8, 0, 40) + b"nm\0".ljust(8, b"\0") + struct.pack("<Q", size).ljust(40, b"\0") if size is not None else struct.pack("<HH", 0, 0))

    def key(oid, kind, rest=b""):
        return struct.pack("<Q", kind << 60 | oid) + rest

    def named(text):
        n = text.encode() + b"\0"
        return struct.pack("<I", len(n) | 0x12345 << 10) + n

    drec = lambda child: struct.pack("<QQH", child, 1_704_110_401_000_000_000, 4)
    rows = [(key(2, 9, named("dir")), drec(20)), (key(20, 3), inode(2, 20, 0x41ED)), (key(20, 9, named("f\u00e9.bin")), drec(21)), (key(21, 3), inode(20, 21, 0x81A4, 9000)), (key(21, 8, struct.pack("<Q", 0)), struct.pack("<QQQ", 4096, 15, 0)), (key(21, 8, struct.pack("<Q", 8192)), struct.pack("<QQQ", 4096, 17, 0))]
    put(10, leaf(rows, False))
    put(9, leaf([(key(2, 9), struct.pack("<Q", 78))], False, level=1))
    put(15, b"a" * block)
    put(17, b"b" * block)
    (tmp_path / "a.dd").write_bytes(bytes(disk))
    formats.register(spark)
    df = formats.with_paths(spark.read.format("evidence_entries").load(str(tmp_path / "a.dd")), root="2")
    got = {r["path"]: r for r in df.collect()}
    assert set(got) == {"/dir", "/dir/f\u00e9.bin"}
    e = got["/dir/f\u00e9.bin"]
    assert (e["size"], e["created"], e["added"]) == (9000, "2024-01-01T12:00:00.000000Z", "2024-01-01T12:00:01.000000Z")
    fs = filesystems.open_filesystem(MemoryBytes(bytes(disk)))
    assert fs.name == "Data"
    assert fs.read([r.asDict() for r in e["runs"]], 9000) == b"a" * 4096 + bytes(4096) + b"b" * 808
