"""Spark data sources of evidence formats, and readers that decode files of a DataFrame.

``register(spark)`` makes them known as ``spark.read.format("evidence_...")``.  Image formats need a
path that every executor mounts, as images are read in ranges; record formats also decode the
``content`` of any ``binaryFile`` DataFrame through ``decode``, wherever Spark read it from.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from . import documents, records
from .containers import open_image
from .filesystems import SCHEMA as ENTRY_SCHEMA
from .filesystems import Ntfs, open_filesystem
from .volumes import scan

BLOCK = 4 << 20
RECORDS = 65_536


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def _order(schema: str) -> list[str]:
    """Field names of a schema text; parsed here, as workers have no session that could."""
    names, depth, held = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            names.append(held.split()[0])
            held = ""
        else:
            held += c
    return names


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.options = options.get("path"), options
        if not self.path:
            raise ValueError("path: which image is meant?")


class _Blocks(_Reader):
    """(evidence_id, offset, data) of a disk, one task per run of blocks."""

    def partitions(self):
        size, step = open_image(self.path).size, int(self.options.get("partitionBytes", 64 << 20))
        return [Range(a, min(size, a + step)) for a in range(0, size, step)]

    def read(self, part):
        source, block = open_image(self.path), int(self.options.get("blockBytes", BLOCK))
        for at in range(part.first, part.last, block):
            yield int(self.options.get("evidenceId", 0)), at, source.read_at(at, min(block, part.last - at))


class BlockSource(DataSource):
    @classmethod
    def name(cls):
        return "evidence_blocks"

    def schema(self):
        return "evidence_id long, offset long, data binary"

    def reader(self, schema):
        return _Blocks(self.options)


class _Volumes(_Reader):
    def read(self, part):
        for n, p in enumerate(scan(open_image(self.path))):
            yield n, p["kind"], p["offset"], p["size"], p["type"], p["name"], p["fs"], p["note"]


class VolumeSource(DataSource):
    @classmethod
    def name(cls):
        return "evidence_volumes"

    def schema(self):
        return "number int, kind string, offset long, size long, type string, name string, fs string, note string"

    def reader(self, schema):
        return _Volumes(self.options)


class _Entries(_Reader):
    """Entries of one volume; NTFS tables are cut into ranges of records."""

    def _open(self):
        return open_filesystem(open_image(self.path), int(self.options.get("offset", 0)), int(self.options["size"]) if "size" in self.options else None, int(self.options.get("volume", 0)))

    def partitions(self):
        fs = self._open()
        return [Range(a, a + RECORDS) for a in range(0, fs.count, RECORDS)] if isinstance(fs, Ntfs) else [Range(0, 0)]

    def read(self, part):
        fs, names = self._open(), _order(ENTRY_SCHEMA)
        known = {"evidence_id": int(self.options.get("evidenceId", 0)), "part": int(self.options.get("offset", 0))}
        found = fs.entries(part.first, part.last) if isinstance(fs, Ntfs) else fs.entries()
        for e in found:
            e = e | known
            e["runs"] = [(r["offset"], r["length"], r["sparse"]) for r in e["runs"]]
            e["streams"] = [(s["name"], s["size"]) for s in e["streams"]]
            yield tuple(e[n] for n in names)


class EntrySource(DataSource):
    @classmethod
    def name(cls):
        return "evidence_entries"

    def schema(self):
        return ENTRY_SCHEMA

    def reader(self, schema):
        return _Entries(self.options)


def register(spark: SparkSession) -> None:
    for source in (BlockSource, VolumeSource, EntrySource):
        spark.dataSource.register(source)


def with_paths(entries: DataFrame, root: str = "5", depth: int = 64) -> DataFrame:
    """Paths from parent links: every directory looks twice as far up each round.

    A directory that no chain leads to the root from keeps what is known, under ``/?``.
    """
    dirs = entries.where("is_dir").groupBy("evidence_id", "part", "node").agg(F.min_by("name", "name").alias("name"), F.min("parent").alias("parent"))
    at = dirs.select("evidence_id", "part", "node", F.when(F.col("node") == root, "").otherwise(F.concat(F.lit("/"), "name")).alias("tail"), F.when((F.col("node") == root) | (F.col("parent") == root), root).otherwise(F.col("parent")).alias("up"))
    step = 1
    while step < depth:
        above = at.select("evidence_id", "part", F.col("node").alias("up"), F.col("tail").alias("_tail"), F.col("up").alias("_up"))
        joined = at.join(above, ["evidence_id", "part", "up"], "left")
        done = (F.col("up") == root) | F.col("_up").isNull()
        at = joined.select("evidence_id", "part", "node", F.when(done, F.col("tail")).otherwise(F.concat("_tail", "tail")).alias("tail"), F.when(done, F.col("up")).otherwise(F.col("_up")).alias("up"))
        step *= 2
    full = at.select("evidence_id", "part", F.col("node").alias("parent"), F.when(F.col("up") == root, F.col("tail")).otherwise(F.concat(F.lit("/?"), "tail")).alias("_dir"))
    out = entries.drop("path").join(full, ["evidence_id", "part", "parent"], "left")
    return out.withColumn("path", F.concat(F.coalesce("_dir", F.when(F.col("parent") == root, ""), F.lit("/?")), F.lit("/"), "name")).drop("_dir")


def _sqlite_rows(table: str):
    import json

    def rows(data):
        for r in records.Sqlite(data).read(table):
            yield {"rowid": r.pop("_rowid"), "row": json.dumps({k: v.hex() if isinstance(v, bytes) else v for k, v in r.items()}, sort_keys=True)}

    return rows


SHORTCUT_SCHEMA = "target_created string, target_accessed string, target_modified string, target_size long, local_path string, name string, relative_path string, working_dir string, arguments string, icon string"

DECODERS = {
    "usn": (records.usn, records.USN_SCHEMA),
    "evtx": (records.evtx, records.EVTX_SCHEMA),
    "hive": (lambda data: records.Hive(data).rows(), records.HIVE_SCHEMA),
    "leveldb_log": (records.leveldb_log, records.LEVELDB_SCHEMA),
    "leveldb_table": (records.leveldb_table, records.LEVELDB_SCHEMA),
    "zip": (records.zip_members, records.ZIP_SCHEMA),
    "recycle": (lambda data: filter(None, [records.recycle_metadata(data)]), "recoverable_size long, deleted_at string, original_path string"),
    "shortcut": (lambda data: filter(None, [records.shortcut(data)]), SHORTCUT_SCHEMA),
    "ntfs_log": (records.log_records, records.LOG_SCHEMA),
    "shim_cache": (records.shim_cache, records.SHIM_SCHEMA),
    "shellbags": (lambda data: records.shellbags(records.Hive(data)), records.SHELLBAG_SCHEMA),
    "sqlite_deleted": (records.deleted_rows, records.DELETED_SCHEMA),
    "browser_cache": (lambda data: filter(None, [records.cache_entry(data)]), records.CACHE_SCHEMA),
    "office": (lambda data: filter(None, [documents.office(data)]), documents.OFFICE_SCHEMA),
    "pdf": (lambda data: filter(None, [documents.pdf(data)]), documents.OFFICE_SCHEMA),
    "exif": (lambda data: filter(None, [documents.exif(data)]), documents.EXIF_SCHEMA),
    "jump_list": (documents.jump_list, "entry string, " + SHORTCUT_SCHEMA),
    "prefetch": (lambda data: filter(None, [records.prefetch(data)]), "program string, hash string, run_count long, run_times array<string>, files array<string>"),
}


def decode(files: DataFrame, kind: str, table: str | None = None, batch: int = 4096) -> DataFrame:
    """Records of every file in ``files`` (path, content), one row each, with file, record and error.

    A file that cannot be decoded gives one row that holds the error and nothing else.
    """
    read, schema = (_sqlite_rows(table), "rowid long, row string") if kind == "sqlite" else DECODERS[kind]
    names = _order(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    whole = f"file string, record long, error string, {schema}"
    arrow = to_arrow_schema(StructType.fromDDL(whole))

    def run(batches):
        for got in batches:
            out = []
            for path, content in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                try:
                    for n, r in enumerate(read(content or b"")):
                        out.append({"file": path, "record": n, "error": None} | {c: r[c] for c in names})
                        if len(out) >= batch:
                            yield pa.RecordBatch.from_pylist(out, arrow)
                            out = []
                except Exception as e:  # the file is evidence and may hold anything
                    out.append({"file": path, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(out, arrow)

    return files.select("path", "content").mapInArrow(run, whole)


def read_stix(spark: SparkSession, path: str) -> DataFrame:
    """(technique, name, tactic) of a STIX bundle; withdrawn ones are left out, and of several entries the first by id counts."""
    objects = spark.read.option("multiLine", True).json(path).select(F.explode("objects").alias("o")).select("o.*")
    for c in ("revoked", "x_mitre_deprecated"):
        if c not in objects.columns:
            objects = objects.withColumn(c, F.lit(False))
    live = objects.where((F.col("type") == "attack-pattern") & ~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False)))
    external = F.get(F.filter("external_references", lambda r: r["external_id"].isNotNull()), F.lit(0))["external_id"]
    rows = live.select(external.alias("technique"), "id", "name", F.get("kill_chain_phases", F.lit(0))["phase_name"].alias("tactic")).where("technique is not null")
    return rows.groupBy("technique").agg(F.min_by(F.struct("name", "tactic"), "id").alias("r")).select("technique", "r.*")


def listing_of(spark: SparkSession, path: str) -> DataFrame:
    """A folder as evidence: one entry per file, through Spark's own reader, without the contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    return files.select(F.substring_index("path", "/", -1).alias("name"), "path", F.lit(False).alias("is_dir"), F.lit(False).alias("deleted"), F.col("length").alias("size"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"), F.col("path").alias("node"))
