"""Partition tables: MBR with its chain of logical partitions, and GPT."""

from __future__ import annotations

import struct
import uuid
import zlib

SECTOR = 512
# Type bytes of a partition that holds others.
EXTENDED = (0x05, 0x0F, 0x85)
# First bytes by which a volume shows its kind: (kind, offset, bytes), fixed values.
PROBES = (("ntfs", 3, b"NTFS    "), ("exfat", 3, b"EXFAT   "), ("fat32", 82, b"FAT32   "), ("fat16", 54, b"FAT16   "), ("fat12", 54, b"FAT12   "), ("bitlocker", 3, b"-FVE-FS-"), ("luks", 0, b"LUKS\xba\xbe"), ("apfs", 32, b"NXSB"), ("hfs+", 1024, b"H+"), ("hfsx", 1024, b"HX"), ("ext", 1080, b"\x53\xef"), ("xfs", 0, b"XFSB"), ("lvm", 536, b"LVM2 001"))


def probe(source, offset: int) -> str | None:
    head = source.read_at(offset, 2048)
    return next((k for k, at, magic in PROBES if head[at : at + len(magic)] == magic), None)


def _entries(sector: bytes):
    for i in range(4):
        kind = sector[446 + 16 * i + 4]
        start, count = struct.unpack_from("<II", sector, 446 + 16 * i + 8)
        if kind and count:
            yield kind, start, count


def scan(source) -> list[dict]:
    """Partitions and gaps of a disk in order: kind, offset, size, type, name, file system, note."""
    first, found = source.read_at(0, SECTOR), []
    add = lambda offset, size, kind, **more: found.append({"kind": "partition", "offset": offset, "size": size, "type": kind, "name": "", "fs": probe(source, offset), "note": ""} | more)
    table = list(_entries(first)) if first[510:512] == b"\x55\xaa" and not probe(source, 0) else []
    if any(kind == 0xEE for kind, *_ in table):
        for at in (SECTOR, source.size - SECTOR):
            head = source.read_at(at, SECTOR)
            if head[:8] != b"EFI PART":
                continue
            size, crc = struct.unpack_from("<II", head, 12)
            entries_at, count, each = struct.unpack_from("<QII", head, 72)
            good = zlib.crc32(head[:16] + b"\0\0\0\0" + head[20:size]) == crc
            for i in range(min(count, 1024)):
                e = source.read_at(entries_at * SECTOR + i * each, each)
                if len(e) >= 128 and any(e[:16]):
                    a, z = struct.unpack_from("<QQ", e, 32)
                    add(a * SECTOR, (z - a + 1) * SECTOR, str(uuid.UUID(bytes_le=e[:16])), name=e[56:128].decode("utf-16-le", "replace").rstrip("\0"), note="" if good else "header checksum differs")
            break
    else:
        for kind, start, count in table:
            if kind not in EXTENDED:
                add(start * SECTOR, count * SECTOR, f"{kind:#04x}")
                continue
            link, seen = start, set()
            while link not in seen and len(seen) < 256:
                seen.add(link)
                sector, following = source.read_at(link * SECTOR, SECTOR), None
                if sector[510:512] != b"\x55\xaa":
                    break
                for inner, at, size in _entries(sector):
                    if inner in EXTENDED:
                        following = start + at
                    else:
                        add((link + at) * SECTOR, size * SECTOR, f"{inner:#04x}", note="logical")
                if following is None:
                    break
                link = following
    if not found and probe(source, 0):
        add(0, source.size, "whole")
    found.sort(key=lambda p: p["offset"])
    out, at = [], 0
    for p in found:
        if p["offset"] > at:
            out.append({"kind": "gap", "offset": at, "size": p["offset"] - at, "type": "", "name": "", "fs": None, "note": ""})
        if p["offset"] < at:
            p["note"] = (p["note"] + " overlaps").strip()
        if p["offset"] + p["size"] > source.size:
            p["note"] = (p["note"] + " beyond the disk").strip()
        out.append(p)
        at = max(at, p["offset"] + p["size"])
    if at < source.size:
        out.append({"kind": "gap", "offset": at, "size": source.size - at, "type": "", "name": "", "fs": None, "note": ""})
    return out
