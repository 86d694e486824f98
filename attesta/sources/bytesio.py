"""Byte access for decoders: ranges of a file in pieces, and views of a part of it."""

from __future__ import annotations


class FileBytes:
    """Ranged reads of one local or mounted file; reads past the end are short, never an error."""

    def __init__(self, path: str):
        import os

        self.path, self.size, self._file = path, os.path.getsize(path), None

    def read_at(self, offset: int, length: int) -> bytes:
        if offset < 0 or length <= 0 or offset >= self.size:
            return b""
        self._file = self._file or open(self.path, "rb")
        self._file.seek(offset)
        return self._file.read(min(length, self.size - offset))


class MemoryBytes:
    """The same over bytes in memory."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read_at(self, offset: int, length: int) -> bytes:
        return self.data[offset : offset + length] if offset >= 0 and length > 0 else b""


class Joined:
    """Parts one after another, as split images have them."""

    def __init__(self, parts: list):
        self.parts, self.size = parts, sum(p.size for p in parts)

    def read_at(self, offset: int, length: int) -> bytes:
        out, length = [], min(length, self.size - offset)
        if offset < 0 or length <= 0:
            return b""
        for p in self.parts:
            if length and offset < p.size:
                out.append(p.read_at(offset, min(length, p.size - offset)))
                length -= len(out[-1])
                offset = 0
            else:
                offset -= p.size
        return b"".join(out)


class View:
    """``size`` bytes of a source from ``offset``; never shows a neighbour's bytes."""

    def __init__(self, source, offset: int, size: int):
        if offset < 0:
            raise ValueError("a view starts at 0 or later")
        self.source, self.offset, self.size = source, offset, max(0, min(size, source.size - offset))

    def read_at(self, offset: int, length: int) -> bytes:
        if offset < 0 or offset >= self.size:
            return b""
        return self.source.read_at(self.offset + offset, min(length, self.size - offset))
