"""AFF4 standard images: ZIP volumes whose metadata describe maps over compressed streams."""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from bisect import bisect_right
from functools import lru_cache
from urllib.parse import unquote

from .codecs import snappy

SCHEMA = "http://aff4.org/Schema#"


def triples(turtle: str):
    """(subject, property, value) of the plain Turtle that imagers write."""
    prefixes = {m[1]: m[2] for m in re.finditer(r"@prefix\s+(\S*):\s+<([^>]*)>\s*\.", turtle)}
    body = re.sub(r"@prefix[^\n]*\n", "", turtle)

    def full(token):
        if token[0] == "<":
            return token[1:-1]
        if token[0] == '"':
            return token[1 : token.rfind('"')]
        head, colon, tail = token.partition(":")
        return prefixes[head] + tail if colon and head in prefixes else token

    subject = prop = None
    for m in re.finditer(r'<[^>]+>|"(?:[^"\\]|\\.)*"(?:\^\^(?:<[^>]+>|[\w:]+))?|[\w:#/+-]+(?:\.[\w:#/+-]+)*|[;,.]', body):
        t = m[0]
        if t == ".":
            subject = prop = None
        elif t == ";":
            prop = None
        elif t == ",":
            continue
        elif subject is None:
            subject = full(t)
        elif prop is None:
            prop = SCHEMA.replace("Schema#", "type") if t == "a" else full(t)
        else:
            yield subject, prop, full(t)


class Aff4:
    """The first image of a volume, as one disk."""

    def __init__(self, path: str):
        self.zip = zipfile.ZipFile(path)
        self.names = {unquote(n): n for n in self.zip.namelist()}
        known: dict[str, dict[str, list[str]]] = {}
        for s, p, v in triples(self.zip.read("information.turtle").decode("utf-8", "replace")):
            known.setdefault(s, {}).setdefault(p.rpartition("#")[2] if "#" in p else p, []).append(v)
        self.known = known
        kinds = {s: {x.rpartition("#")[2] for v in ps.values() for x in v if x.startswith(SCHEMA)} for s, ps in known.items()}
        image = next((s for s, k in kinds.items() if k & {"DiskImage", "Image", "ContiguousImage"}), None)
        target = next(iter(known.get(image, {}).get("dataStream", [])), None) or next(s for s, k in kinds.items() if "Map" in k or "ImageStream" in k)
        self.size = int(known[target]["size"][0])
        self.spans: list[tuple[int, int, int, str | None]] = []
        if "Map" in kinds[target]:
            targets = self._read(target, "idx").decode().split("\n")
            for at, size, to, i in struct.iter_unpack("<QQQI", self._read(target, "map")):
                name = targets[i].strip() if i < len(targets) else ""
                self.spans.append((at, size, to, name if name in known and "chunkSize" in known[name] else None))
            self.spans.sort()
        else:
            self.spans = [(0, self.size, 0, target)]
        self.starts = [s[0] for s in self.spans]
        self._chunk = lru_cache(64)(self._decode)
        self._index = lru_cache(64)(self._bevy_index)

    def _read(self, subject: str, part: str) -> bytes:
        for name in (f"{subject}/{part}", f"{subject.rpartition('/')[2]}/{part}"):
            if name in self.names:
                return self.zip.read(self.names[name])
        raise KeyError(f"{subject}/{part}")

    def _bevy_index(self, stream: str, bevy: int):
        return [e for e in struct.iter_unpack("<QI", self._read(stream, f"{bevy:08d}.index"))]

    def _decode(self, stream: str, n: int) -> bytes:
        told = self.known[stream]
        size, per = int(told["chunkSize"][0]), int(told.get("chunksInSegment", ["2048"])[0])
        bevy, i = divmod(n, per)
        at, length = self._index(stream, bevy)[i]
        raw = self._read(stream, f"{bevy:08d}")[at : at + length]
        if length == size:
            return raw
        method = next(iter(told.get("compressionMethod", [""])), "")
        if "snappy" in method:
            return snappy(raw, size)
        return zlib.decompressobj().decompress(raw, size) if "1950" in method or "zlib" in method else zlib.decompressobj(-15).decompress(raw, size) if "1951" in method else raw

    def _stream(self, stream: str, offset: int, length: int) -> bytes:
        size, out = int(self.known[stream]["chunkSize"][0]), []
        while length > 0:
            n, at = divmod(offset, size)
            part = self._chunk(stream, n)[at : at + length]
            if not part:
                break
            out.append(part)
            offset, length = offset + len(part), length - len(part)
        return b"".join(out)

    def read_at(self, offset: int, length: int) -> bytes:
        if offset < 0 or length <= 0 or offset >= self.size:
            return b""
        end, out = min(self.size, offset + length), []
        while offset < end:
            i = bisect_right(self.starts, offset) - 1
            at, size, to, stream = self.spans[i] if i >= 0 else (0, 0, 0, None)
            if offset >= at + size:
                take = min(end, self.starts[i + 1] if i + 1 < len(self.starts) else end) - offset
                out.append(b"\0" * take)
            else:
                take = min(end, at + size) - offset
                part = self._stream(stream, to + offset - at, take) if stream else b""
                out.append(part.ljust(take, b"\0"))
            offset += take
        return b"".join(out)
