"""Text and metadata of documents and pictures: office files, PDF, compound files, EXIF."""

from __future__ import annotations

import re
import struct
import zipfile
from io import BytesIO
from xml.etree import ElementTree

from .codecs import inflate

CAP = 8 << 20


def office(data: bytes) -> dict | None:
    """kind, text, title, author and times of OOXML or OpenDocument files."""
    try:
        z = zipfile.ZipFile(BytesIO(data))
        names = set(z.namelist())
    except (zipfile.BadZipFile, ValueError):
        return None

    def read(name):
        with z.open(name) as f:
            return ElementTree.fromstring(f.read(CAP))

    def text(root, breaks):
        out = []
        for e in root.iter():
            tag = e.tag.rpartition("}")[2]
            if tag in breaks:
                out.append("\n")
            if e.text and tag in ("t", "p", "span", "h", "v", "a"):
                out.append(e.text)
            if e.tail and tag in ("span", "a", "s", "tab", "line-break"):
                out.append(e.tail)
        return re.sub(r"\s*\n\s*", "\n", "".join(out)).strip()

    kind, parts = None, []
    if "word/document.xml" in names:
        kind, parts = "docx", ["word/document.xml"]
    elif "xl/workbook.xml" in names:
        kind, parts = "xlsx", sorted(n for n in names if n == "xl/sharedStrings.xml" or re.fullmatch(r"xl/worksheets/[^/]+\.xml", n))
    elif "ppt/presentation.xml" in names:
        kind, parts = "pptx", sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    elif "content.xml" in names and "mimetype" in names:
        kind, parts = z.read("mimetype").decode("ascii", "replace").rpartition(".")[2][:20], ["content.xml"]
    if kind is None:
        return None
    out = {"kind": kind, "text": "", "title": None, "author": None, "created": None, "modified": None}
    texts = []
    for p in parts:
        try:
            texts.append(text(read(p), {"p", "h", "row", "si"}))
        except (ElementTree.ParseError, zipfile.BadZipFile, KeyError):
            continue
    out["text"] = "\n".join(t for t in texts if t)[:CAP]
    for meta in ("docProps/core.xml", "meta.xml"):
        if meta in names:
            try:
                for e in read(meta).iter():
                    key = {"title": "title", "creator": "author", "initial-creator": "author", "created": "created", "creation-date": "created", "modified": "modified", "date": "modified"}.get(e.tag.rpartition("}")[2])
                    if key and e.text and out[key] is None:
                        out[key] = e.text
            except (ElementTree.ParseError, zipfile.BadZipFile):
                pass
    return out


OFFICE_SCHEMA = "kind string, text string, title string, author string, created string, modified string"

_PDF_STRING = re.compile(rb"\((?:[^()\\]|\\.|\([^()]*\))*\)|<[0-9A-Fa-f\s]*>", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_text(raw: bytes) -> bytes:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) & 1)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], b"" if m[1] in (b"\n", b"\r", b"\r\n") else m[1]), raw[1:-1], flags=re.S)


def _decoded(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def pdf(data: bytes) -> dict | None:
    """Text of page streams that name their characters by code, and the information dictionary."""
    if data[:5] != b"%PDF-":
        return None
    texts = []
    for m in re.finditer(rb"<<(.{0,4000}?)>>\s*stream\r?\n", data, re.S):
        end = data.find(b"endstream", m.end())
        raw = data[m.end() : end if end >= 0 else len(data)]
        if b"FlateDecode" in m[1]:
            raw = inflate(raw, CAP)
        elif b"/Filter" in m[1]:
            continue
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", raw, re.S):
            line = []
            for op in re.finditer(rb"(\[(?:[^\]\\]|\\.)*\]|\((?:[^()\\]|\\.|\([^()]*\))*\)|<[0-9A-Fa-f\s]*>)\s*(?:TJ|Tj|'|\")|(T\*|Td\b|TD\b)", block, re.S):
                if op[2]:
                    line.append(b"\n")
                else:
                    line += [_pdf_text(s) for s in _PDF_STRING.findall(op[1])]
            texts.append(b"".join(line).decode("latin-1").strip())
    out = {"kind": "pdf", "text": "\n".join(t for t in texts if t)[:CAP], "title": None, "author": None, "created": None, "modified": None}
    for key, name in (("title", b"Title"), ("author", b"Author"), ("created", b"CreationDate"), ("modified", b"ModDate")):
        found = re.search(rb"/" + name + rb"\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)", data, re.S)
        if found:
            out[key] = _decoded(_pdf_text(found[1]))
    return out


# EXIF tags that are told, by number, fixed values.
EXIF_TAGS = {0x10F: "make", 0x110: "model", 0x132: "modified", 0x131: "software", 0x13B: "artist", 0x9003: "taken", 0x9004: "digitised", 0xA430: "owner", 0xA431: "serial"}


def exif(data: bytes) -> dict | None:
    """Camera, times and place of a JPEG or TIFF; None without EXIF."""
    at = 0
    if data[:2] == b"\xff\xd8":
        at, p = -1, 2
        while p + 4 <= len(data) and data[p] == 0xFF and data[p + 1] != 0xDA:
            n = int.from_bytes(data[p + 2 : p + 4], "big")
            if data[p + 1] == 0xE1 and data[p + 4 : p + 10] == b"Exif\0\0":
                at = p + 10
                break
            p += 2 + n
    if at < 0 or data[at : at + 4] not in (b"II*\0", b"MM\0*"):
        return None
    t = data[at:]
    o = "<" if t[:2] == b"II" else ">"
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}

    def directory(p):
        if p + 2 > len(t):
            return
        for i in range(min(struct.unpack_from(o + "H", t, p)[0], 512)):
            e = p + 2 + 12 * i
            if e + 12 > len(t):
                return
            tag, kind, count = struct.unpack_from(o + "HHI", t, e)
            size = sizes.get(kind, 0) * count
            raw = t[e + 8 : e + 8 + size] if size <= 4 else t[(s := struct.unpack_from(o + "I", t, e + 8)[0]) : s + size]
            if not size or len(raw) < size or size > 1 << 16:
                continue
            if kind in (5, 10):
                pairs = struct.unpack(f"{o}{2 * count}{'I' if kind == 5 else 'i'}", raw)
                yield tag, [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
            elif kind in (3, 4, 9):
                yield tag, list(struct.unpack(f"{o}{count}{ {3: 'H', 4: 'I', 9: 'i'}[kind] }", raw))
            else:
                yield tag, raw

    out = dict.fromkeys((*EXIF_TAGS.values(), "latitude", "longitude", "altitude"))
    first = dict(directory(struct.unpack_from(o + "I", t, 4)[0]))
    inner = dict(directory(first[0x8769][0])) if isinstance(first.get(0x8769), list) else {}
    for tag, v in {**first, **inner}.items():
        if tag in EXIF_TAGS and isinstance(v, bytes):
            out[EXIF_TAGS[tag]] = v.split(b"\0")[0].decode("latin-1").strip() or None
    gps = dict(directory(first[0x8825][0])) if isinstance(first.get(0x8825), list) else {}
    for key, ref, tag, minus in (("latitude", 1, 2, b"S"), ("longitude", 3, 4, b"W")):
        v = gps.get(tag)
        if isinstance(v, list) and len(v) == 3 and None not in v:
            degrees = round(v[0] + v[1] / 60 + v[2] / 3600, 7)
            out[key] = -degrees if isinstance(gps.get(ref), bytes) and gps[ref][:1] == minus else degrees
    v = gps.get(6)
    if isinstance(v, list) and v and v[0] is not None:
        below = gps.get(5)
        out["altitude"] = -v[0] if isinstance(below, bytes) and below[:1] == b"\x01" else v[0]
    return out


EXIF_SCHEMA = ", ".join(f"{n} string" for n in EXIF_TAGS.values()) + ", latitude double, longitude double, altitude double"


class Compound:
    """OLE2 compound files: a tree of streams in chains of sectors."""

    def __init__(self, data: bytes):
        if data[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
            raise ValueError("not a compound file")
        self.data, self.size = data, 1 << struct.unpack_from("<H", data, 30)[0]
        self.small = 1 << struct.unpack_from("<H", data, 32)[0]
        first_dir, _, self.limit, first_mini, _, first_difat, n_difat = struct.unpack_from("<IIIIIII", data, 48)
        difat = list(struct.unpack_from("<109I", data, 76))
        for _ in range(min(n_difat, 1 << 16)):
            part = struct.unpack(f"<{self.size // 4}I", self._sector(first_difat).ljust(self.size, b"\xff"))
            difat += part[:-1]
            first_difat = part[-1]
        self.fat = [x for s in difat if s < 0xFFFFFFFA for x in struct.unpack(f"<{self.size // 4}I", self._sector(s).ljust(self.size, b"\xff"))]
        raw = self._chain(first_dir)
        self.entries = [raw[i : i + 128] for i in range(0, len(raw) - 127, 128)]
        mini = self._chain(first_mini)
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini[: len(mini) // 4 * 4])
        self.mini = self._chain(struct.unpack_from("<I", self.entries[0], 116)[0]) if self.entries else b""

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size]

    def _chain(self, n: int) -> bytes:
        out, seen = [], set()
        while n < len(self.fat) and n not in seen:
            seen.add(n)
            out.append(self._sector(n))
            n = self.fat[n]
        return b"".join(out)

    def streams(self):
        """(path, size, entry number) of each stream."""
        todo, seen = [(struct.unpack_from("<I", self.entries[0], 76)[0], "")] if self.entries else [], set()
        while todo:
            i, above = todo.pop()
            if i in seen or i >= len(self.entries):
                continue
            seen.add(i)
            e = self.entries[i]
            name = e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le", "replace")
            left, right, child = struct.unpack_from("<III", e, 68)
            todo += [(left, above), (right, above)]
            if e[66] == 1:
                todo.append((child, f"{above}{name}/"))
            elif e[66] == 2:
                yield above + name, struct.unpack_from("<Q", e, 120)[0] & 0xFFFFFFFF, i

    def read(self, i: int) -> bytes:
        e = self.entries[i]
        n, size = struct.unpack_from("<I", e, 116)[0], struct.unpack_from("<Q", e, 120)[0] & 0xFFFFFFFF
        if size >= self.limit:
            return self._chain(n)[:size]
        out, seen = [], set()
        while n < len(self.mini_fat) and n not in seen:
            seen.add(n)
            out.append(self.mini[n * self.small : (n + 1) * self.small])
            n = self.mini_fat[n]
        return b"".join(out)[:size]


def jump_list(data: bytes):
    """Shortcuts of an automatic jump list (a compound file) or a custom one (links in a row)."""
    from .records import shortcut

    if data[:8] == bytes.fromhex("d0cf11e0a1b11ae1"):
        c = Compound(data)
        for path, _, i in sorted(c.streams()):
            found = shortcut(c.read(i)) if path != "DestList" else None
            if found:
                yield {"entry": path} | found
        return
    magic = bytes.fromhex("4c0000000114020000000000c000000000000046")
    at, n = data.find(magic), 0
    while at >= 0:
        found = shortcut(data[at:])
        if found:
            yield {"entry": str(n)} | found
        n, at = n + 1, data.find(magic, at + 1)


def quarantine(text: str) -> dict:
    """Parts of an Apple quarantine attribute."""
    parts = [*text.split(";"), "", "", "", ""]
    try:
        when = int(parts[1], 16) if parts[1] else None
    except ValueError:
        when = None
    return {"flags": parts[0] or None, "at": when, "agent": parts[2] or None, "event": parts[3] or None}
