"""Carving by signatures, core samples of media, and user-made structure templates."""

from __future__ import annotations

import json
import re
import struct
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detect import block_class
from .scan import Ordered
from .search import few_at_once, with_edges

MAX_RULES, MAX_PATTERN, OVERLAP, LOOK_BACK = 50, 64, 1024, 64


@dataclass(frozen=True)
class Signature:
    """A header in hexadecimal with ``??`` for any byte, an optional footer, and the longest file."""

    name: str
    header: str
    footer: str | None = None
    max_length: int = 16 << 20
    offset: int = 0

    def __post_init__(self):
        fixed = re.sub(r"\s|\?\?", "", self.header)
        if len(fixed) < 4:
            raise ValueError(f"{self.name}: a header of two fixed bytes or more is needed")
        if self.header.strip().startswith("??"):
            raise ValueError(f"{self.name}: a header begins with a fixed byte")
        for p in (self.header, self.footer or ""):
            if len(re.sub(r"\s", "", p)) > 2 * MAX_PATTERN or not re.fullmatch(r"(?:\s*(?:[0-9a-fA-F]{2}|\?\?))*\s*", p):
                raise ValueError(f"{self.name}: a pattern is at most {MAX_PATTERN} bytes in hexadecimal")

    @staticmethod
    def pattern(text: str) -> re.Pattern:
        return re.compile(b"".join(b"." if x == "??" else re.escape(bytes.fromhex(x)) for x in re.findall(r"\?\?|[0-9a-fA-F]{2}", text)), re.S)


# Headers and footers of common formats, fixed values.
SIGNATURES = (
    Signature("jpeg", "ffd8ff", "ffd9", 32 << 20), Signature("png", "89504e470d0a1a0a", "49454e44ae426082", 64 << 20), Signature("gif", "47494638??61", "003b", 16 << 20), Signature("pdf", "255044462d", "2525454f46", 256 << 20),
    Signature("zip", "504b0304", "504b0506????????????????????????????????????", 512 << 20), Signature("rar", "526172211a07", None, 512 << 20), Signature("7z", "377abcaf271c", None, 512 << 20), Signature("ole", "d0cf11e0a1b11ae1", None, 64 << 20),
    Signature("sqlite", "53514c69746520666f726d6174203300", None, 512 << 20), Signature("evtx", "456c6646696c6500", None, 64 << 20), Signature("regf", "72656766", None, 128 << 20), Signature("riff", "52494646????????", None, 512 << 20),
)


def check_rules(rules: list[Signature]) -> list[Signature]:
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("rules of one name")
    return rules


def marks(blocks: DataFrame, signatures=SIGNATURES, overlap: int = OVERLAP) -> DataFrame:
    """(evidence_id, name, kind, offset, end) of headers and footers in raw blocks and across their edges."""
    wanted = [(s.name, kind, Signature.pattern(p), s.offset if kind == "header" else 0) for s in signatures for kind, p in (("header", s.header), ("footer", s.footer)) if p]

    def run(batches):
        for batch in few_at_once(batches):
            out = []
            for evidence, base, edge, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for name, kind, pattern, shift in wanted:
                    out += [(evidence, name, kind, base + m.start() - shift, base + m.end()) for m in pattern.finditer(data) if base + m.start() >= shift and (edge is None or m.start() < edge < m.end())]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["evidence_id", "name", "kind", "offset", "end"])

    return with_edges(blocks, overlap).mapInArrow(run, "evidence_id long, name string, kind string, offset long, end long")


def carve(blocks: DataFrame, sizes: DataFrame, signatures=SIGNATURES, overlap: int = OVERLAP) -> DataFrame:
    """(evidence_id, name, offset, length, method): files that headers begin in raw blocks.

    A file ends with the first footer of its kind within its longest length; without one it is bound
    by the next header of its kind, its longest length or the end of the evidence (``sizes``).
    """
    found = marks(blocks, signatures, overlap)
    rules = " ".join(f"WHEN '{s.name}' THEN {s.max_length}L" for s in signatures)
    footed = [s.name for s in signatures if s.footer]
    footer, header = F.when(F.col("kind") == "footer", F.col("end")), F.when(F.col("kind") == "header", F.col("offset"))
    near = Ordered(found, ["evidence_id", "name"], ["offset", "end"]).carry(ahead=True, foot=("near", footer), head=("near", header)).rows()
    most = F.expr(f"CASE name {rules} END")
    rows = near.where("kind = 'header'").join(sizes.select("evidence_id", "size"), "evidence_id").withColumn("most", most)
    closed = F.col("name").isin(footed) & (F.col("foot") - F.col("offset") <= F.col("most"))
    bound = F.least(F.col("most"), F.col("head") - F.col("offset"), F.col("size") - F.col("offset"))
    length = F.when(closed, F.col("foot") - F.col("offset")).otherwise(bound)
    method = F.when(closed, "footer").when(bound == F.col("head") - F.col("offset"), "next_header").when(bound == F.col("size") - F.col("offset"), "end").otherwise("limit")
    return rows.select("evidence_id", "name", "offset", length.alias("length"), method.alias("method"))


#: What bounds a file without a footer, of equal lengths the first.
BOUNDS = ("next_header", "allocated", "empty_sector", "limit")


def bounded(hits: DataFrame, allocated: DataFrame, empty: DataFrame) -> DataFrame:
    """(evidence_id, name, offset, length, method) of headers (evidence_id, name, offset, cap, stop_at_allocated, stop_at_zeros).

    A file ends at the next header of its kind, at the next allocated span (evidence_id, start) or at the first empty
    sector (evidence_id, at) after its header, or at its cap: at the least of them, of equal ones the first of
    ``BOUNDS``.  Spans and sectors count for kinds that stop at them only.  A length below 1 is 0 by method none.
    """
    none = lambda *names: [F.lit(None).cast(hits.schema[n].dataType).alias(n) for n in names]
    rest = [c for c in hits.columns if c not in ("evidence_id", "offset")]
    place = lambda at, what: (F.col("evidence_id"), F.col(at).cast("long").alias("at"), F.lit(what).alias("what"))
    sectors, spans, headers = -1, 0, 1
    marked = hits.select(*place("offset", headers), *rest).unionByName(allocated.select(*place("start", spans), *none(*rest))).unionByName(empty.select(*place("at", sectors), *none(*rest)))
    # What lies at the very offset of a header is no end of it, so it sorts before.  Headers are placed once for all bounds.
    of = lambda what: ("near", F.when(F.col("what") == what, F.col("at")))
    near = Ordered(marked, ["evidence_id"], ["at", "what"]).carry(ahead=True, s=of(spans), z=of(sectors))
    found = near.where(F.col("what") == headers).carry(ahead=True, within=("name",), head=("near", F.col("at"))).rows()
    at = F.col("at")
    lengths = (F.col("head") - at, F.when(F.col("stop_at_allocated"), F.col("s") - at), F.when(F.col("stop_at_zeros"), F.col("z") - at), F.col("cap"))
    bounds = F.filter(F.array(*(F.struct(n.cast("long").alias("length"), F.lit(rank).alias("rank")) for rank, n in enumerate(lengths))), lambda b: b["length"].isNotNull())
    least = found.withColumn("_l", F.array_min(bounds))
    positive = F.coalesce(F.col("_l.length") > 0, F.lit(False))
    method = F.when(positive, F.get(F.array(*map(F.lit, BOUNDS)), F.col("_l.rank"))).otherwise("none")
    return least.select("evidence_id", "name", at.alias("offset"), F.when(positive, F.col("_l.length")).otherwise(0).alias("length"), method.alias("method"))


def drop_nested(hits: DataFrame, look_back: int = LOOK_BACK) -> DataFrame:
    """Hits without those strictly smaller and inside one of the ``look_back`` kept before them.

    Only hits whose end is known can hold others, but all that are kept count among the ``look_back``.  Kept
    rows decide on later ones: hits are read in order by ranges, of one evidence in many tasks, and each range
    begins with the last ``look_back`` that the one before kept.
    """

    def fold(rows: pa.Table, state: str) -> tuple[pa.Table, str]:
        evidence, kept = json.loads(state) if state else (None, [])
        keep = []
        for at, (own, a, length, method) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("evidence_id", "offset", "length", "method")), strict=True)):
            z = a + length
            if own != evidence:
                evidence, kept = own, []
            if any(k[2] and k[0] <= a and z <= k[1] and k[1] - k[0] > length for k in kept):
                continue
            keep.append(at)
            kept = [*kept, (a, z, method == "footer")][-look_back:]
        return rows.take(pa.array(keep, pa.int64())), json.dumps([evidence, kept])

    return Ordered(hits, ["evidence_id"], ["offset", "-length"]).threaded(fold)


def core_sample(blocks: DataFrame, size: int | DataFrame, block_size: int, buckets: int = 256, windows: int = 16, whole: int = 64 << 20) -> DataFrame:
    """evidence_id, bucket, class, n and mean entropy: all blocks of a small medium, else ``windows`` a bucket.

    ``size`` is that of the one medium, or a table (evidence_id, size) of several.  Which blocks of one
    medium are read follows from offsets alone, so the filter reaches the source.
    """
    if isinstance(size, int):
        held = blocks.withColumn("size", F.lit(size).cast("long"))
    else:
        held = blocks.join(size.select("evidence_id", F.col("size").cast("long").alias("size")), "evidence_id")
    step = F.greatest(F.ceil(F.col("size") / buckets), F.lit(1))
    gap = F.greatest(F.lit(block_size), F.floor(step / windows))
    chosen = held.where((F.col("size") <= whole) | ((F.col("offset") % step) % gap < block_size))
    judged = chosen.select("evidence_id", F.floor(F.col("offset") / step).cast("int").alias("bucket"), block_class("data").alias("b"))
    return judged.groupBy("evidence_id", "bucket", "b.class").agg(F.count("*").alias("n"), F.avg("b.entropy").alias("entropy"))


# Field kinds of templates: struct formats, or a reader of raw bytes.
FIELDS = {"u8": "<B", "i8": "<b", "u16": "<H", "i16": "<h", "u32": "<I", "i32": "<i", "u64": "<Q", "i64": "<q"}
TEXTS = {"hex": bytes.hex, "sig": bytes.hex, "bytes": bytes.hex, "ascii": lambda b: b.decode("latin-1").rstrip("\0"), "utf16": lambda b: b.decode("utf-16-le", "replace").rstrip("\0"), "guid": lambda b: str(uuid.UUID(bytes_le=b))}
MAX_FIELDS, MAX_EXTENT = 512, 64 << 10


@dataclass(frozen=True)
class Template:
    """Named fields at offsets: (name, offset, kind, length); numbers are little-endian."""

    name: str
    fields: tuple[tuple[str, int, str, int], ...]

    def __post_init__(self):
        if not 1 <= len(self.fields) <= MAX_FIELDS or len({f[0] for f in self.fields}) < len(self.fields):
            raise ValueError(f"1 to {MAX_FIELDS} fields of different names are needed")
        for name, offset, kind, length in self.fields:
            if kind not in FIELDS and kind not in TEXTS:
                raise ValueError(f"{name}: unknown kind {kind}")
            width = struct.calcsize(FIELDS[kind]) if kind in FIELDS else 16 if kind == "guid" else length
            if offset < 0 or width < 1 or offset + width > MAX_EXTENT or (kind == "guid" and length != 16):
                raise ValueError(f"{name}: a field lies within {MAX_EXTENT} bytes")

    def decode(self, data: bytes) -> dict[str, str | None]:
        out = {}
        for name, offset, kind, length in self.fields:
            width = struct.calcsize(FIELDS[kind]) if kind in FIELDS else length
            raw = data[offset : offset + width]
            out[name] = None if len(raw) < width else str(struct.unpack(FIELDS[kind], raw)[0]) if kind in FIELDS else TEXTS[kind](raw)
        return out


# Built-in maps of a boot sector, fixed values.
MBR = Template("mbr", (("disk_signature", 440, "u32", 4), ("entry1_type", 450, "u8", 1), ("entry1_start", 454, "u32", 4), ("entry1_sectors", 458, "u32", 4), ("signature", 510, "sig", 2)))
GPT = Template("gpt", (("signature", 0, "ascii", 8), ("revision", 8, "u32", 4), ("header_size", 12, "u32", 4), ("current_lba", 24, "u64", 8), ("backup_lba", 32, "u64", 8), ("disk_guid", 56, "guid", 16), ("entries_lba", 72, "u64", 8), ("entries", 80, "u32", 4)))
NTFS_BOOT = Template("ntfs_boot", (("oem", 3, "ascii", 8), ("bytes_per_sector", 11, "u16", 2), ("sectors_per_cluster", 13, "u8", 1), ("total_sectors", 40, "u64", 8), ("mft_cluster", 48, "u64", 8), ("serial", 72, "hex", 8)))


def apply_template(files: DataFrame, template: Template, column: str = "content") -> DataFrame:
    """``files`` with a map of the template's fields over a binary column; a field beyond the end is null."""

    def run(data: pa.Array) -> pa.Array:
        return pa.array([None if b is None else list(template.decode(b).items()) for b in data.to_pylist()], pa.map_(pa.string(), pa.string()))

    # With postponed annotations the types are texts, which the UDF machinery resolves only at module level.
    run.__annotations__ = {"data": pa.Array, "return": pa.Array}
    return files.withColumn("fields", F.arrow_udf(run, "map<string,string>")(column))
