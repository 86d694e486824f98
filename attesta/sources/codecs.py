"""Content codecs: bytes in, bytes out, with a bound on what comes out."""

from __future__ import annotations

import zlib


def inflate(data: bytes, cap: int, raw: bool = False) -> bytes:
    """Deflated data up to ``cap`` bytes; a damaged end gives what came before it."""
    d = zlib.decompressobj(-15 if raw else 15)
    out = bytearray()
    try:
        out += d.decompress(data, cap)
        while len(out) < cap and d.unconsumed_tail:
            out += d.decompress(d.unconsumed_tail, cap - len(out))
    except zlib.error:
        pass
    return bytes(out)


def lznt1(data: bytes, cap: int = 1 << 30) -> bytes:
    """Chunks of 4 KiB, each stored or made of literals and back references."""
    out, at = bytearray(), 0
    while at + 2 <= len(data) and len(out) < cap:
        head = int.from_bytes(data[at : at + 2], "little")
        if not head:
            break
        end, packed = at + 3 + (head & 0xFFF), head & 0x8000
        at += 2
        if not packed:
            out += data[at:end]
            at = end
            continue
        begin = len(out)
        while at < min(end, len(data)):
            flags = data[at]
            at += 1
            for bit in range(8):
                if at >= min(end, len(data)):
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                pair = int.from_bytes(data[at : at + 2], "little")
                at += 2
                length_bits = 12
                while length_bits > 4 and len(out) - begin > 1 << 16 - length_bits:
                    length_bits -= 1
                back, length = (pair >> length_bits) + 1, (pair & (1 << length_bits) - 1) + 3
                if back > len(out) - begin:
                    return bytes(out[:cap])
                for _ in range(length):
                    out.append(out[-back])
    return bytes(out[:cap])


def snappy(data: bytes, cap: int = 1 << 30) -> bytes:
    """A raw Snappy block."""
    size = shift = at = 0
    while True:
        b = data[at]
        at += 1
        size |= (b & 0x7F) << shift
        if b < 0x80:
            break
        shift += 7
    if size > cap:
        raise ValueError("block larger than allowed")
    out = bytearray()
    while at < len(data) and len(out) < size:
        tag = data[at]
        at += 1
        if tag & 3 == 0:
            length = tag >> 2
            if length >= 60:
                extra = length - 59
                length = int.from_bytes(data[at : at + extra], "little")
                at += extra
            out += data[at : at + length + 1]
            at += length + 1
            continue
        if tag & 3 == 1:
            length, back = (tag >> 2 & 7) + 4, (tag >> 5) << 8 | data[at]
            at += 1
        else:
            width = 2 if tag & 3 == 2 else 4
            length, back = (tag >> 2) + 1, int.from_bytes(data[at : at + width], "little")
            at += width
        if not 0 < back <= len(out):
            raise ValueError("a reference before the start")
        for _ in range(length):
            out.append(out[-back])
    return bytes(out)


def fletcher64(data: bytes) -> int:
    """The checksum of APFS objects over what follows their first eight bytes."""
    low = high = 0
    for i in range(8, len(data) - 3, 4):
        low = (low + int.from_bytes(data[i : i + 4], "little")) % 0xFFFFFFFF
        high = (high + low) % 0xFFFFFFFF
    first = 0xFFFFFFFF - (low + high) % 0xFFFFFFFF
    return (0xFFFFFFFF - (low + first) % 0xFFFFFFFF) << 32 | first


def marvin32(data: bytes, seed: int = 0x82EF4D887A4E55C5) -> int:
    """The keyed checksum of registry logs, as a 64-bit number."""
    mask = 0xFFFFFFFF
    a, b = seed & mask, seed >> 32
    turn = lambda x, n: (x << n | x >> 32 - n) & mask

    def block(a, b):
        b ^= a
        a = turn(a, 20)
        a = a + b & mask
        b = turn(b, 9) ^ a
        a = turn(a, 27)
        a = a + b & mask
        return a, turn(b, 19)

    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        a, b = block(a + int.from_bytes(data[i : i + 4], "little") & mask, b)
    tail = data[whole:] + b"\x80"
    a, b = block(a + int.from_bytes(tail, "little") & mask, b)
    a, b = block(a, b)
    return b << 32 | a


def lzxpress_huffman(data: bytes, size: int) -> bytes:
    """Blocks of up to 64 KiB, each with a table of 512 code lengths before its bits (MS-XCA 2.1)."""
    out, at = bytearray(), 0
    while len(out) < size and at + 260 <= len(data):
        lengths = [n for b in data[at : at + 256] for n in (b & 15, b >> 4)]
        at += 256
        table, code = {}, 0
        for n in range(1, 16):
            for symbol, length in enumerate(lengths):
                if length == n:
                    table[n, code] = symbol
                    code += 1
            code <<= 1
        bits = int.from_bytes(data[at : at + 2], "little") << 16 | int.from_bytes(data[at + 2 : at + 4], "little")
        at, left = at + 4, 32
        end = min(size, len(out) + 65536)

        def drop(n):
            nonlocal bits, left, at
            bits, left = bits << n & 0xFFFFFFFF, left - n
            if left <= 16:
                bits |= int.from_bytes(data[at : at + 2], "little") << 16 - left
                at, left = at + 2, left + 16

        while len(out) < end:
            for n in range(1, 16):
                symbol = table.get((n, bits >> 32 - n))
                if symbol is not None:
                    break
            else:
                raise ValueError("a code that is not in the table")
            drop(n)
            if symbol < 256:
                out.append(symbol)
                continue
            length, width = symbol & 15, symbol - 256 >> 4
            if length == 15:
                length, at = data[at] + 15, at + 1
                if length == 270:
                    length, at = int.from_bytes(data[at : at + 2], "little"), at + 2
                    if not length:
                        length, at = int.from_bytes(data[at : at + 4], "little"), at + 4
            back = 1 << width | (bits >> 32 - width if width else 0)
            if width:
                drop(width)
            if back > len(out):
                raise ValueError("a reference before the start")
            for _ in range(min(length + 3, size - len(out))):
                out.append(out[-back])
    return bytes(out[:size])


def decmpfs(attribute: bytes, fork: bytes = b"", cap: int = 1 << 30) -> bytes:
    """A compressed file of HFS+ or APFS from its attribute (zlib within it) or its resource fork."""
    if attribute[:4] != b"fpmc":
        raise ValueError("not a compressed file's attribute")
    kind, size = int.from_bytes(attribute[4:8], "little"), int.from_bytes(attribute[8:16], "little")
    if size > cap:
        raise ValueError("larger than allowed")
    if kind == 3:
        body = attribute[16:]
        return body[1 : 1 + size] if body[:1] and body[0] & 15 == 15 else inflate(body, size)
    if kind != 4:
        raise ValueError(f"compression of kind {kind}")
    start = int.from_bytes(fork[:4], "big") + 4
    out = bytearray()
    for i in range(int.from_bytes(fork[start : start + 4], "little")):
        at, n = (int.from_bytes(fork[start + 4 + 8 * i + 4 * k : start + 8 + 8 * i + 4 * k], "little") for k in (0, 1))
        part = fork[start + at : start + at + n]
        out += part[1:] if part[:1] and part[0] & 15 == 15 else inflate(part, 65536)
    return bytes(out[:size])
