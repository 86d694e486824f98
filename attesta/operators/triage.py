"""Triage: what a case holds and what nobody has looked for yet, from relations of what was read.

Each rule is an aggregate over its relation, so what reaches the union is a row a rule (journals: a row
a volume).  A relation that was never filled gives a finding with ``not_run``, which is not the
same as a finding of nothing.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .casebook import severity_rank

# Detected kinds of encrypted volumes, and the registry sections that are listed before others.
ENCRYPTED = ("BitLocker", "LUKS")
TELLING = ("USB storage attached", "Networks joined", "Auto-start programs (machine)", "Auto-start programs (user)", "Local accounts")
PROFILE_FOLDERS = ("users", "serviceprofiles", "documents and settings")

_FINDING = {"severity": "string", "kind": "string", "not_run": "boolean", "evidence_id": "long", "part": "long", "n": "long", "grave": "long", "measure": "long", "action": "string"}


def _finding(df: DataFrame, kind: str, action: str | None, severity: Column | str = "info", not_run: bool = False, **columns: Column) -> DataFrame:
    given = {"severity": F.lit(severity) if isinstance(severity, str) else severity, "kind": F.lit(kind), "not_run": F.lit(not_run), "action": F.lit(action)} | columns
    return df.select(*(given.get(name, F.lit(None)).cast(of).alias(name) for name, of in _FINDING.items()))


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _together(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row with the counters of both, which are a row each."""
    whole = a.unionByName(b, allowMissingColumns=True)
    return whole.agg(*(F.max(c).alias(c) for c in whole.columns))


def _volume_findings(volumes: DataFrame) -> list[DataFrame]:
    own = F.col("allocated") & ~F.coalesce("container", F.lit(False))
    encrypted = own & F.col("detected").isin(*ENCRYPTED)
    unknown = own & (F.coalesce("detected", F.lit("")) == "")
    gap = ~F.coalesce("allocated", F.lit(False))
    told = volumes.agg(
        _count(encrypted).alias("encrypted"), _count(encrypted & ~F.coalesce("unlocked", F.lit(False))).alias("locked"), _count(unknown).alias("unknown"),
        F.sum(F.when(unknown, F.col("size"))).alias("unknown_bytes"), _count(gap).alias("gaps"), F.sum(F.when(gap, F.col("size"))).alias("gap_bytes"),
    )
    return [
        _finding(told.where("encrypted > 0"), "encrypted", "unlock", F.when(F.col("locked") > 0, "high").otherwise("info"), n=F.col("encrypted"), grave=F.col("locked")),
        _finding(told.where("unknown > 0"), "unreadable", None, "medium", n=F.col("unknown"), measure=F.coalesce("unknown_bytes", F.lit(0))),
        _finding(told.where("gap_bytes > 0"), "unallocated", "index", n=F.col("gaps"), measure=F.col("gap_bytes")),
    ]


def _type_findings(scans: DataFrame, mismatches: DataFrame) -> list[DataFrame]:
    both = _together(
        scans.agg(F.count("*").alias("scans"), F.sum("checked").cast("long").alias("checked")),
        mismatches.agg(F.count("*").alias("wrong"), _count(F.col("severity") == "high").alias("high")),
    )
    return [
        _finding(both.where("scans = 0"), "filetype", "filetypes", not_run=True),
        _finding(both.where("scans > 0"), "filetype", "filetypes", F.when(F.col("high") > 0, "high").otherwise("info"), n=F.col("wrong"), grave=F.col("high"), measure=F.coalesce("checked", F.lit(0))),
    ]


def _journal_findings(volumes: DataFrame, journals: DataFrame, records: DataFrame) -> list[DataFrame]:
    """A row a volume of NTFS that has a journal: read (n records, deletions as ``grave``, points skipped as ``measure``) or not."""
    key = ["evidence_id", "part"]
    here = volumes.where(F.col("allocated") & (F.col("detected") == "NTFS")).select(*key).distinct().join(journals.dropDuplicates(key), key)
    told = records.groupBy(*key).agg(F.count("*").alias("records"), _count(F.array_contains("reasons", "deleted")).alias("deleted"))
    known = here.join(told, key, "left").withColumns({"records": F.coalesce("records", F.lit(0)), "deleted": F.coalesce("deleted", F.lit(0)), "resyncs": F.coalesce("resyncs", F.lit(0))})
    place = {"evidence_id": F.col("evidence_id"), "part": F.col("part")}
    read = F.coalesce("read", F.lit(False))
    return [
        _finding(known.where(read), "usn", "usn", F.when(F.col("resyncs") > 0, "medium").otherwise("info"), n=F.col("records"), grave=F.col("deleted"), measure=F.col("resyncs"), **place),
        _finding(known.where(~read), "usn", "usn", not_run=True, **place),
    ]


def _registry_findings(hives: DataFrame, sections: DataFrame) -> list[DataFrame]:
    told = hives.agg(F.count("*").alias("hives"), _count(F.col("unreadable") & ~F.coalesce("empty", F.lit(False))).alias("bad"))
    held = sections.join(hives.where(~F.coalesce("unreadable", F.lit(False))).select("hive_id").distinct(), "hive_id", "left_semi")
    both = _together(told, held.agg(_count(F.col("n") > 0).alias("sections")))
    return [
        _finding(both.where("hives = 0"), "registry", "registry", not_run=True),
        _finding(both.where("hives > 0"), "registry", "registry", F.when(F.col("bad") > 0, "medium").otherwise("info"), n=F.col("sections"), grave=F.col("bad"), measure=F.col("hives")),
    ]


def findings(volumes: DataFrame, scans: DataFrame, mismatches: DataFrame, journals: DataFrame, records: DataFrame, hives: DataFrame, sections: DataFrame, hash_sets: DataFrame, tags: DataFrame, indexes: DataFrame) -> DataFrame:
    """(severity, kind, not_run, evidence_id, part, n, grave, measure, action), gravest first, then by kind and place.

    volumes (evidence_id, part, allocated, container, detected, unlocked, size); scans (checked); mismatches
    (severity); journals (evidence_id, part, read, resyncs) that are present; records (evidence_id, part,
    reasons) of those that were read; hives (hive_id, unreadable, empty); sections (hive_id, n); hash_sets, tags
    and indexes a row each.  Extra columns are ignored.  ``n`` counts what was found, ``grave`` the part of it that
    is locked, high, deleted or damaged; ``measure`` is in bytes for volumes, files checked for types, points
    skipped for journals and hives for the registry.  Nulls of flags count as false and unknown kinds as none.
    A volume without a kind is unreadable; a container counts through its logical volumes alone.
    """
    rules = [
        *_volume_findings(volumes), *_type_findings(scans, mismatches), *_journal_findings(volumes, journals, records), *_registry_findings(hives, sections),
        _finding(hash_sets.agg(F.count("*").alias("k")).where("k = 0"), "hashsets", "hashes", not_run=True),
        _finding(tags.agg(F.count("*").alias("k")).where("k > 0"), "tagged", "tags", n=F.col("k")),
        _finding(indexes.agg(F.count("*").alias("k")).where("k = 0"), "index", "index", not_run=True),
    ]
    return functools.reduce(DataFrame.unionByName, rules).orderBy(severity_rank(F.col("severity")), "kind", "evidence_id", "part")


def _owner(path: Column) -> Column:
    """The folder after the first profile folder of a path, null where there is none."""
    steps = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda x: x != "")
    at = F.array_position(F.transform(F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0))), lambda x: F.lower(x).isin(*PROFILE_FOLDERS)), True)
    return F.when(at > 0, F.try_element_at(steps, (at + 1).cast("int")))


def registry_items(hives: DataFrame, sections: DataFrame) -> DataFrame:
    """(place, hive, evidence_id, section, note, n): damaged hives first, then sections with content, then hives never written.

    Hives are (hive_id, evidence_id, hive, kind, unreadable, empty, note, size), sections (hive_id, section, n).  Of the
    sections the telling ones are listed, all where there is none of those.  User hives carry the user's name.
    """
    hidden, empty = F.coalesce("unreadable", F.lit(False)), F.coalesce("empty", F.lit(False))
    named = F.coalesce(F.when(F.col("hive") != "", F.col("hive")), F.lit("(unnamed hive)"))
    text = F.when(empty, "allocated but never written").otherwise("would not parse")
    broken = hives.where(hidden).select(F.when(empty, 2).otherwise(0).alias("place"), named.alias("hive"), "evidence_id", text.alias("section"), "note", F.col("size").alias("n"))
    owner = F.when(F.col("kind").isin("NTUSER", "USRCLASS"), _owner(F.col("hive")))
    label = F.when(owner.isNotNull(), F.concat("kind", F.lit(" ("), owner, F.lit(")"))).otherwise(F.col("kind"))
    held = sections.where("n > 0").join(hives.where(~hidden).select("hive_id", "evidence_id", label.alias("hive")), "hive_id")
    rows = held.select(F.lit(1).alias("place"), "hive", "evidence_id", "section", F.lit(None).cast("string").alias("note"), "n", F.col("section").isin(*TELLING).alias("_telling"))
    some = rows.where("_telling").limit(1).select("place")
    listed = rows.where("_telling").unionByName(rows.where("not _telling").join(F.broadcast(some), "place", "left_anti"))
    return broken.unionByName(listed.drop("_telling")).orderBy("place", "evidence_id", "hive", "section")
