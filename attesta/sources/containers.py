"""Disk-image containers: which file holds which bytes of a disk.

Every container gives ``size`` and ``read_at(offset, length)``.  ``open_image`` tells them apart by
signature.  Formats are those that their makers or the open-source community have published.
"""

from __future__ import annotations

import bz2
import glob
import lzma
import os
import plistlib
import re
import struct
import zlib
from bisect import bisect_right
from functools import lru_cache

from .aff4 import Aff4
from .bytesio import FileBytes, Joined


class _Blocks:
    """A disk cut into equal blocks, each found by its number; None is a block of zeros."""

    size: int
    block: int

    def locate(self, n: int):
        raise NotImplementedError

    def load(self, n: int) -> bytes:
        raise NotImplementedError

    def read_at(self, offset: int, length: int) -> bytes:
        if offset < 0 or length <= 0 or offset >= self.size:
            return b""
        end, out = min(self.size, offset + length), []
        while offset < end:
            n, at = divmod(offset, self.block)
            take = min(self.block - at, end - offset)
            out.append(self.load(n)[at : at + take].ljust(take, b"\0"))
            offset += take
        return b"".join(out)


class Vhd(_Blocks):
    """Virtual PC disks, fixed or dynamic; a differencing disk reads through to its parent."""

    def __init__(self, source, parent=None):
        footer = source.read_at(source.size - 512, 512)
        if footer[:8] != b"conectix":
            footer = source.read_at(0, 512)
        if footer[:8] != b"conectix":
            raise ValueError("not a VHD")
        self.source, self.parent = source, parent
        self.size, self.kind = struct.unpack_from(">Q", footer, 48)[0], struct.unpack_from(">I", footer, 60)[0]
        if self.kind == 2:
            self.block, self.table = 1 << 21, None
            return
        if self.kind == 4 and parent is None:
            raise ValueError("a differencing VHD needs its parent")
        head = source.read_at(struct.unpack_from(">Q", footer, 16)[0], 1024)
        if head[:8] != b"cxsparse":
            raise ValueError("no dynamic VHD header")
        at, entries, self.block = struct.unpack_from(">Q", head, 16)[0], *struct.unpack_from(">II", head, 28)
        if self.block < 512 or self.block % 512 or entries * 4 > source.size:
            raise ValueError("a VHD table larger than its file")
        self.table = struct.unpack(f">{entries}I", source.read_at(at, entries * 4))

    def load(self, n: int) -> bytes:
        if self.table is None:
            return self.source.read_at(n * self.block, self.block)
        below = self.parent.read_at(n * self.block, self.block).ljust(self.block, b"\0") if self.parent else b"\0" * self.block
        at = self.table[n] if n < len(self.table) else 0xFFFFFFFF
        if at == 0xFFFFFFFF:
            return below
        map_size = -(-self.block // 512 // 8 // 512) * 512
        bits, data = self.source.read_at(at * 512, map_size), self.source.read_at(at * 512 + map_size, self.block)
        if self.parent is None:
            return data
        sectors = [data[s * 512 : s * 512 + 512] if bits[s >> 3] & 0x80 >> (s & 7) else below[s * 512 : s * 512 + 512] for s in range(self.block // 512)]
        return b"".join(sectors)


class Vhdx(_Blocks):
    """Hyper-V disks without a parent; a log that was not replayed is refused."""

    REGIONS = {"2dc27766f62342009d64115e9bfd4a08": "table", "8b7ca20647904b9ab8fe575f050f886e": "meta"}
    ITEMS = {"caa16737fa364d43b3b633f0aa44e76b": "file", "2fa54224cd1b4876b2115dbed83bf4b8": "size", "8141bf1da96f4709ba47f233a8faab5f": "sector"}

    def __init__(self, source):
        import uuid

        if source.read_at(0, 8) != b"vhdxfile":
            raise ValueError("not a VHDX")
        heads = [h for at in (64 << 10, 128 << 10) if (h := source.read_at(at, 4096))[:4] == b"head"]
        newest = max(heads, key=lambda h: struct.unpack_from("<Q", h, 8)[0], default=None)
        if newest is None or any(newest[48:64]):
            raise ValueError("a VHDX whose log holds changes")
        found = {}
        for at in (192 << 10, 256 << 10):
            raw = source.read_at(at, 64 << 10)
            if raw[:4] == b"regi":
                for i in range(min(struct.unpack_from("<I", raw, 8)[0], 2047)):
                    name = self.REGIONS.get(uuid.UUID(bytes_le=raw[16 + 32 * i : 32 + 32 * i]).hex)
                    if name:
                        found[name] = struct.unpack_from("<QI", raw, 32 + 32 * i)
                break
        meta_at, meta_size = found["meta"]
        raw, values = source.read_at(meta_at, min(meta_size, 1 << 20)), {}
        for i in range(min(struct.unpack_from("<H", raw, 10)[0], 2047)):
            name = self.ITEMS.get(uuid.UUID(bytes_le=raw[32 + 32 * i : 48 + 32 * i]).hex)
            if name:
                at, n = struct.unpack_from("<II", raw, 48 + 32 * i)
                values[name] = int.from_bytes(source.read_at(meta_at + at, min(n, 8)), "little")
        self.source, self.size, self.block = source, values["size"], values["file"] & 0xFFFFFFFF
        if values["file"] >> 32 & 2:
            raise ValueError("a VHDX with a parent")
        self.ratio = (1 << 23) * values["sector"] // self.block
        at, n = found["table"]
        self.table = struct.unpack(f"<{n // 8}Q", source.read_at(at, n // 8 * 8))

    def load(self, n: int) -> bytes:
        entry = self.table[n + n // self.ratio]
        return self.source.read_at(entry >> 20 << 20, self.block) if entry & 7 in (6, 7) else b""


class Vdi(_Blocks):
    """VirtualBox disks."""

    def __init__(self, source):
        head = source.read_at(0, 512)
        if struct.unpack_from("<I", head, 0x40)[0] != 0xBEDA107F:
            raise ValueError("not a VDI")
        blocks_at, self.data = struct.unpack_from("<II", head, 0x154)
        self.size, self.block, _, count = struct.unpack_from("<QIII", head, 0x170)
        if not self.block or count * 4 > source.size:
            raise ValueError("a VDI table larger than its file")
        self.source, self.table = source, struct.unpack(f"<{count}I", source.read_at(blocks_at, count * 4))

    def load(self, n: int) -> bytes:
        at = self.table[n] if n < len(self.table) else 0xFFFFFFFF
        return b"" if at >= 0xFFFFFFFE else self.source.read_at(self.data + at * self.block, self.block)


class Qcow2(_Blocks):
    """QEMU copy-on-write disks, versions 2 and 3, without backing file or encryption."""

    def __init__(self, source):
        head = source.read_at(0, 104)
        magic, version, backing = struct.unpack_from(">IIQ", head)
        if magic != 0x514649FB or version not in (2, 3):
            raise ValueError("not a QCOW2")
        self.bits, self.size, crypt, l1_size, l1_at = struct.unpack_from(">IQIIQ", head, 20)
        if backing or crypt:
            raise ValueError("a QCOW2 with a backing file or encryption")
        if not 9 <= self.bits <= 21 or l1_size * 8 > source.size:
            raise ValueError("a damaged QCOW2")
        self.source, self.block = source, 1 << self.bits
        self.l1 = struct.unpack(f">{l1_size}Q", source.read_at(l1_at, l1_size * 8))
        self._l2 = lru_cache(64)(self._read_l2)

    def _read_l2(self, at: int):
        return struct.unpack(f">{self.block // 8}Q", self.source.read_at(at, self.block).ljust(self.block, b"\0"))

    def load(self, n: int) -> bytes:
        i, j = divmod(n, self.block // 8)
        at = self.l1[i] & 0x00FFFFFFFFFFFE00 if i < len(self.l1) else 0
        entry = self._l2(at)[j] if at else 0
        if entry >> 62 & 1:
            shift = 62 - (self.bits - 8)
            where, sectors = entry & (1 << shift) - 1, (entry >> shift & (1 << self.bits - 8) - 1) + 1
            return zlib.decompressobj(-15).decompress(self.source.read_at(where, sectors * 512), self.block)
        where = entry & 0x00FFFFFFFFFFFE00
        return b"" if not where or entry & 1 else self.source.read_at(where, self.block)


class VmdkSparse(_Blocks):
    """VMware sparse extents, plain or stream-optimised."""

    def __init__(self, source):
        head = source.read_at(0, 512)
        if head[:4] != b"KDMV":
            raise ValueError("not a sparse VMDK")
        if struct.unpack_from("<Q", head, 56)[0] == 0xFFFFFFFFFFFFFFFF:
            head = source.read_at(source.size - 1024, 512)
        flags, capacity, grain, _, _, per_table, _, directory = struct.unpack_from("<IQQQQIQQ", head, 8)
        self.packed = bool(flags & 0x10000)
        self.size, self.block, self.source = capacity * 512, grain * 512, source
        if not self.block or not per_table:
            raise ValueError("a damaged VMDK")
        tables = -(-capacity // (grain * per_table))
        self.per_table, self.directory = per_table, struct.unpack(f"<{tables}I", source.read_at(directory * 512, tables * 4))
        self._table = lru_cache(64)(lambda at: struct.unpack(f"<{per_table}I", source.read_at(at * 512, per_table * 4)))

    def load(self, n: int) -> bytes:
        i, j = divmod(n, self.per_table)
        at = self._table(self.directory[i])[j] if i < len(self.directory) and self.directory[i] else 0
        if at < 2:
            return b""
        if not self.packed:
            return self.source.read_at(at * 512, self.block)
        size = struct.unpack("<I", self.source.read_at(at * 512 + 8, 4))[0]
        return zlib.decompressobj().decompress(self.source.read_at(at * 512 + 12, size), self.block)


class Ewf(_Blocks):
    """Expert Witness files, version 1, in any number of segments."""

    def __init__(self, paths: list[str]):
        self.digests: dict[str, str] = {}
        self.chunks: list[tuple[int, int, int, bool]] = []
        self.size = self.block = 0
        self.files = [FileBytes(p) for p in paths]
        for k, f in enumerate(self.files):
            if f.read_at(0, 8) not in (b"EVF\x09\x0d\x0a\xff\x00", b"LVF\x09\x0d\x0a\xff\x00"):
                raise ValueError("not an EWF segment")
            at, sectors_end = 13, 0
            while True:
                head = f.read_at(at, 76)
                if len(head) < 76:
                    break
                kind = head[:16].rstrip(b"\0").decode("ascii", "replace")
                following, size = struct.unpack_from("<QQ", head, 16)
                body = at + 76
                if kind in ("volume", "disk", "data") and not self.size:
                    sectors_per, sector, count = struct.unpack_from("<IIQ", f.read_at(body, 24), 8)
                    self.block, self.size = sectors_per * sector, count * sector
                elif kind == "sectors":
                    sectors_end = at + size
                elif kind == "table":
                    count, _, base = struct.unpack_from("<IIQ", f.read_at(body, 16))
                    raw = struct.unpack(f"<{count}I", f.read_at(body + 24, count * 4))
                    starts = [base + (x & 0x7FFFFFFF) for x in raw]
                    ends = [*starts[1:], sectors_end or at]
                    self.chunks += [(k, s, e - s, bool(x >> 31)) for s, e, x in zip(starts, ends, raw, strict=True)]
                elif kind == "hash":
                    self.digests["md5"] = f.read_at(body, 16).hex()
                elif kind == "digest":
                    raw = f.read_at(body, 36)
                    self.digests |= {"md5": raw[:16].hex(), "sha1": raw[16:36].hex()}
                if kind in ("done", "next") or following <= at:
                    break
                at = following
        self._chunk = lru_cache(64)(self._decode)

    def _decode(self, n: int) -> bytes:
        k, at, size, packed = self.chunks[n]
        raw = self.files[k].read_at(at, size)
        return zlib.decompressobj().decompress(raw, self.block) if packed else raw[: self.block]

    def load(self, n: int) -> bytes:
        return self._chunk(n) if n < len(self.chunks) else b""


class Dmg:
    """Apple disk images with a trailer and block maps; zlib, bzip2, LZMA, raw and empty runs."""

    def __init__(self, source):
        trailer = source.read_at(source.size - 512, 512)
        if trailer[:4] != b"koly":
            raise ValueError("not a UDIF image")
        xml_at, xml_size = struct.unpack_from(">QQ", trailer, 216)
        self.source, self.runs = source, []
        for table in plistlib.loads(source.read_at(xml_at, xml_size))["resource-fork"]["blkx"]:
            data = table["Data"]
            first, data_at, count = struct.unpack_from(">Q", data, 8)[0], struct.unpack_from(">Q", data, 24)[0], struct.unpack_from(">I", data, 200)[0]
            for i in range(count):
                kind, _, sector, sectors, at, size = struct.unpack_from(">IIQQQQ", data, 204 + 40 * i)
                if kind not in (0xFFFFFFFF, 0x7FFFFFFE):
                    self.runs.append(((first + sector) * 512, sectors * 512, kind, data_at + at, size))
        self.runs.sort()
        self.starts = [r[0] for r in self.runs]
        self.size = max((r[0] + r[1] for r in self.runs), default=0)
        self._run = lru_cache(32)(self._decode)

    def _decode(self, i: int) -> bytes:
        _, length, kind, at, size = self.runs[i]
        raw = self.source.read_at(at, size)
        if kind == 1:
            return raw
        if kind == 0x80000005:
            return zlib.decompressobj().decompress(raw, length)
        if kind == 0x80000006:
            return bz2.decompress(raw)[:length]
        if kind == 0x80000008:
            return lzma.decompress(raw)[:length]
        if kind in (0, 2):
            return b""
        raise ValueError(f"run of kind {kind:#x}")

    def read_at(self, offset: int, length: int) -> bytes:
        if offset < 0 or length <= 0 or offset >= self.size:
            return b""
        end, out = min(self.size, offset + length), []
        while offset < end:
            i = bisect_right(self.starts, offset) - 1
            start, size = self.runs[i][:2] if i >= 0 else (0, 0)
            if offset >= start + size:
                take = min(end, self.starts[i + 1] if i + 1 < len(self.starts) else end) - offset
                out.append(b"\0" * take)
            else:
                take = min(end, start + size) - offset
                out.append(self._run(i)[offset - start : offset - start + take].ljust(take, b"\0"))
            offset += take
        return b"".join(out)


class Raid:
    """Striped (0), mirrored (1) or rotating-parity (5) sets; one missing member of 5 is rebuilt."""

    def __init__(self, members: list, level: int, stripe: int):
        if level not in (0, 1, 5) or stripe < 512 or (level == 5 and len(members) < 3) or sum(m is None for m in members) > (level == 5) + (level == 1) * (len(members) - 1):
            raise ValueError("a set that cannot be read")
        self.members, self.level, self.stripe = members, level, stripe
        least = min(m.size for m in members if m is not None) // stripe * stripe
        self.size = least * {0: len(members), 1: 1, 5: len(members) - 1}[level]

    def _piece(self, member: int, at: int, size: int) -> bytes:
        m = self.members[member]
        if m is not None:
            return m.read_at(at, size)
        total = 0
        for x in self.members:
            total ^= int.from_bytes(x.read_at(at, size), "big") if x is not None else 0
        return total.to_bytes(size, "big")

    def read_at(self, offset: int, length: int) -> bytes:
        if offset < 0 or length <= 0 or offset >= self.size:
            return b""
        if self.level == 1:
            return next(m for m in self.members if m is not None).read_at(offset, min(length, self.size - offset))
        end, out, n = min(self.size, offset + length), [], len(self.members)
        while offset < end:
            s, at = divmod(offset, self.stripe)
            row, k = divmod(s, n if self.level == 0 else n - 1)
            member = k if self.level == 0 else (n - 1 - row % n + 1 + k) % n
            take = min(self.stripe - at, end - offset)
            out.append(self._piece(member, row * self.stripe + at, take))
            offset += take
        return b"".join(out)


def segments(path: str) -> list[str]:
    """All files of a split set that ``path`` begins, in order."""
    stem, ext = os.path.splitext(path)
    if re.fullmatch(r"\.[eElL][xX]?01", ext):
        found = [p for p in glob.glob(glob.escape(stem) + ".*") if re.fullmatch(r"\.[e-zE-Z][0-9a-zA-Z]{2}", os.path.splitext(p)[1])]
        return sorted(found, key=lambda p: (os.path.splitext(p)[1][1:].upper().replace("L", "E", 1)[:1], len(p), os.path.splitext(p)[1][2:].isalpha(), p.upper()))
    if re.fullmatch(r"\.0+[01]?|\.aa", ext):
        return sorted(p for p in glob.glob(glob.escape(stem) + ".*") if len(p) == len(path) and (os.path.splitext(p)[1][1:].isdigit() or ext == ".aa"))
    return [path]


def open_image(path: str):
    """The container at ``path``; a file without a known signature is a raw disk."""
    parts = segments(path)
    first = FileBytes(parts[0])
    head, tail = first.read_at(0, 512), first.read_at(max(0, first.size - 512), 512)
    if head[:8] in (b"EVF\x09\x0d\x0a\xff\x00", b"LVF\x09\x0d\x0a\xff\x00"):
        return Ewf(parts)
    if head[:4] == b"KDMV":
        return VmdkSparse(first)
    if head[:4] == b"QFI\xfb":
        return Qcow2(first)
    if head[:4] == b"PK\x03\x04" and path.lower().endswith((".aff4", ".af4")):
        return Aff4(path)
    if head[:8] == b"vhdxfile":
        return Vhdx(first)
    if head[:8] == b"conectix" or tail[:8] == b"conectix":
        return Vhd(first)
    if len(head) > 0x44 and struct.unpack_from("<I", head, 0x40)[0] == 0xBEDA107F:
        return Vdi(first)
    if tail[:4] == b"koly":
        return Dmg(first)
    return Joined([FileBytes(p) for p in parts]) if len(parts) > 1 else first
