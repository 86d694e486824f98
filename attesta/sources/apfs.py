"""APFS volumes: inodes, directory records and extents from the newest checkpoint of a container."""

from __future__ import annotations

import struct
from datetime import UTC, datetime, timedelta

from .filesystems import entry

_LOW = (1 << 60) - 1


def nanos(v: int) -> str | None:
    """Nanoseconds since 1970; zero and what no calendar holds are no time."""
    if not 0 < v < 1 << 62:
        return None
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=v // 1000)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


class _Tree:
    """Records of a B-tree; ``place`` turns what an inner node holds into a block."""

    def __init__(self, container, place, root: int):
        self.container, self.place, self.root = container, place, root

    def records(self):
        todo, seen = [self.root], set()
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            n = self.container.read_block(at)
            if len(n) < 56:
                continue
            flags, _, count, toc, toc_size = struct.unpack_from("<HHIHH", n, 32)
            keys, end = 56 + toc + toc_size, len(n) - (40 if flags & 1 else 0)
            inner = []
            for i in range(min(count, len(n) // 4)):
                if flags & 4:
                    k, v = struct.unpack_from("<HH", n, 56 + toc + 4 * i)
                    key, value = n[keys + k : keys + k + 16], n[end - v : end - v + 16] if v != 0xFFFF else b""
                else:
                    k, kn, v, vn = struct.unpack_from("<HHHH", n, 56 + toc + 8 * i)
                    key, value = n[keys + k : keys + k + kn], n[end - v : end - v + vn] if v != 0xFFFF else b""
                if flags & 2:
                    yield key, value
                elif len(value) >= 8:
                    child = self.place(struct.unpack_from("<Q", value)[0])
                    if child is not None:
                        inner.append(child)
            todo += reversed(inner)


class Container:
    """The newest whole superblock, and the map from object ids to blocks."""

    def __init__(self, source):
        head = source.read_at(0, 4096)
        if head[32:36] != b"NXSB":
            raise ValueError("not an APFS container")
        self.source, self.block = source, struct.unpack_from("<I", head, 36)[0]
        if self.block < 4096 or self.block > 65536:
            raise ValueError("a damaged APFS container")
        blocks, base = struct.unpack_from("<I", head, 104)[0] & 0x7FFFFFFF, struct.unpack_from("<Q", head, 112)[0]
        tried = [self.read_block(0), *(self.read_block(base + i) for i in range(min(blocks, 4096)))]
        self.head = max((h for h in tried if h[32:36] == b"NXSB"), key=lambda h: struct.unpack_from("<Q", h, 16)[0])
        self.xid = struct.unpack_from("<Q", self.head, 16)[0]
        self.map = self.object_map(struct.unpack_from("<Q", self.head, 160)[0])

    def read_block(self, n: int) -> bytes:
        return self.source.read_at(n * self.block, self.block)

    def object_map(self, at: int) -> dict[int, int]:
        """The newest block of each object up to this checkpoint."""
        root, best = struct.unpack_from("<Q", self.read_block(at), 48)[0], {}
        for key, value in _Tree(self, lambda x: x, root).records():
            oid, xid = struct.unpack_from("<QQ", key)
            flags, _, where = struct.unpack_from("<IIQ", value) if len(value) >= 16 else (1, 0, 0)
            if xid <= self.xid and not flags & 1 and xid >= best.get(oid, (0, 0))[0]:
                best[oid] = (xid, where)
        return {oid: where for oid, (_, where) in best.items()}

    def volumes(self) -> list[int]:
        """Blocks of the volumes' superblocks."""
        ids = struct.unpack_from("<100Q", self.head, 184)
        return [self.map[i] for i in ids if i and i in self.map]


class Apfs:
    """One volume; entries name their parent, and ``ROOT`` is the root folder's."""

    ROOT = "2"

    def __init__(self, source, number: int = 0):
        self.container = Container(source)
        found = self.container.volumes()
        if number >= len(found):
            raise ValueError("no such volume")
        head = self.container.read_block(found[number])
        if head[32:36] != b"APSB":
            raise ValueError("not an APFS volume")
        omap, root = struct.unpack_from("<QQ", head, 128)
        self.name = head[704:960].split(b"\0")[0].decode("utf-8", "replace")
        self.map, self.source = self.container.object_map(omap), source
        self.tree = _Tree(self.container, self.map.get, self.map[root])

    def read(self, runs: list[dict], size: int) -> bytes:
        out, left = [], size
        for r in runs:
            n = min(left, r["length"])
            out.append(b"\0" * n if r["sparse"] else self.source.read_at(r["offset"], n))
            left -= n
        return b"".join(out)

    @staticmethod
    def _fields(v: bytes) -> dict[int, bytes]:
        if len(v) < 96:
            return {}
        n, at, out = struct.unpack_from("<H", v, 92)[0], 96, {}
        data = at + 4 * n
        for i in range(n):
            if at + 4 * i + 4 > len(v):
                break
            kind, _, size = struct.unpack_from("<BBH", v, at + 4 * i)
            out[kind] = v[data : data + size]
            data += size + -size % 8
        return out

    def entries(self):
        inodes, names, extents = {}, [], {}
        size = self.container.block
        for key, v in self.tree.records():
            if len(key) < 8:
                continue
            word = struct.unpack_from("<Q", key)[0]
            oid, kind = word & _LOW, word >> 60
            if kind == 3 and len(v) >= 92:
                inodes[oid] = v
            elif kind == 9 and len(v) >= 16:
                short = len(key) < 12 or struct.unpack_from("<H", key, 8)[0] == len(key) - 10
                names.append((oid, key[10 if short else 12 :].split(b"\0")[0].decode("utf-8", "replace"), *struct.unpack_from("<QQ", v)))
            elif kind == 8 and len(key) >= 16 and len(v) >= 16:
                length, block = struct.unpack_from("<QQ", v)
                extents.setdefault(oid, []).append((struct.unpack_from("<Q", key, 8)[0], length & (1 << 56) - 1, block))
        for parent, name, child, added in names:
            v = inodes.get(child)
            if v is None:
                continue
            private = struct.unpack_from("<Q", v, 8)[0]
            made, modified, changed, read = map(nanos, struct.unpack_from("<4Q", v, 16))
            is_dir = struct.unpack_from("<H", v, 80)[0] >> 12 == 4
            stream = self._fields(v).get(8, b"")
            length = struct.unpack_from("<Q", stream)[0] if len(stream) >= 8 else 0
            runs, at = [], 0
            for first, n, block in sorted(extents.get(private, [])):
                if first > at:
                    runs.append({"offset": 0, "length": first - at, "sparse": True})
                runs.append({"offset": block * size, "length": n, "sparse": not block})
                at = first + n
            yield entry(node=str(child), parent=str(parent), name=name, is_dir=is_dir, size=0 if is_dir else length, created=made, modified=modified, changed=changed, accessed=read, runs=runs) | {"added": nanos(added)}
