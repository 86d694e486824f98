"""The case record: append-only chains, current views, tags and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import Ordered
from .scratch import cut


def audit_hash(prev, at, examiner, action, detail):
    """SHA-256 of an entry and the hash before it; a null examiner is written as the word None."""
    said = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.sha2(F.concat(F.coalesce(prev, F.lit("")), F.lit("|"), said(at), F.lit("|"), said(examiner), F.lit("|"), said(action), F.lit("|"), said(detail)), 256)


def audit_checks(audit: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Entries with ``ok``: the hash is that of the entry, and it names the hash of the one before.

    Chains of several cases are kept apart by ``by``; one chain is verified in order by its ``seq``, by ranges of it in many tasks.
    """
    chained = Ordered(audit, by or [], ["seq"]).carry(_before=("near", F.struct("hash"))).rows()
    previous = F.coalesce("_before.hash", F.lit(""))
    own = audit_hash(F.col("prev_hash"), F.col("at"), F.col("examiner"), F.col("action"), F.col("detail"))
    return chained.withColumn("ok", (F.col("hash") == own) & (F.coalesce("prev_hash", F.lit("")) == previous)).drop("_before")


def audit_verdict(audit: DataFrame, by: list[str], heads: DataFrame | None = None) -> DataFrame:
    """entries, intact and the first broken seq of each chain; ``heads`` (by, seq, hash) is where it must end."""
    checked = audit_checks(audit, by)
    out = checked.groupBy(*by).agg(F.count("*").alias("entries"), F.min(F.when(~F.col("ok"), F.col("seq"))).alias("broken_at"), F.max(F.struct("seq", "hash")).alias("_end"))
    if heads is not None:
        out = out.join(heads.select(*by, F.struct(F.col("seq"), F.col("hash")).alias("_head")), by, "left")
        off = F.col("_head").isNotNull() & (F.col("_head") != F.col("_end"))
        out = out.withColumn("broken_at", F.when(F.col("broken_at").isNull() & off, F.col("_end.seq")).otherwise(F.col("broken_at"))).drop("_head")
    return out.select(*by, "entries", F.col("broken_at").isNull().alias("intact"), "broken_at")


def note_history(notes: DataFrame, rounds: int = 32) -> DataFrame:
    """Every note with the first version of its chain (root) and its place in it.

    Pointer doubling: each round a note looks as far again as it did before, so ``rounds`` of them
    reach 2**rounds versions; it ends when nothing moves.
    """
    at = notes.select("id", F.coalesce("replaces", "id").alias("root"), F.when(F.col("replaces").isNull(), 0).otherwise(1).cast("long").alias("version"))
    for _ in range(rounds):
        ahead = at.select(F.col("id").alias("root"), F.col("root").alias("_next"), F.col("version").alias("_more"))
        moved = cut(at.join(ahead, "root", "left"))
        if not moved.where("_next is not null and _next != root").limit(1).count():
            break
        at = moved.select("id", F.coalesce("_next", "root").alias("root"), (F.col("version") + F.coalesce("_more", F.lit(0))).alias("version"))
    return notes.join(at, "id")


def current_notes(notes: DataFrame) -> DataFrame:
    """Notes that no other replaces and that were not retracted, with the author of their first version."""
    history = note_history(notes)
    firsts = history.where("version = 0").select(F.col("id").alias("root"), F.col("examiner").alias("author"))
    replaced = notes.where("replaces is not null").select(F.col("replaces").alias("id")).distinct()
    return history.join(replaced, "id", "left_anti").where("retracted_at is null").join(firsts, "root", "left")


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy("tag")


def attack_summary(tags: DataFrame) -> DataFrame:
    """Asserted and proposed tags of each technique, with the name and tactic of the earliest."""
    return tags.groupBy("technique").agg(
        F.sum(F.when(F.col("status") == "asserted", 1).otherwise(0)).cast("long").alias("asserted"), F.sum(F.when(F.col("status") == "proposed", 1).otherwise(0)).cast("long").alias("proposed"),
        F.min_by(F.struct("tactic", "name"), F.struct("created_at", "id")).alias("_f"),
    ).select("technique", "_f.tactic", "_f.name", "asserted", "proposed")


def pulse(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


SEVERITIES = ("high", "medium", "low", "info")


def severity_rank(c):
    out = F.when(c == SEVERITIES[0], 0)
    for i, s in enumerate(SEVERITIES[1:], 1):
        out = out.when(c == s, i)
    return out.otherwise(len(SEVERITIES))


def triage(findings: DataFrame) -> DataFrame:
    """Findings per severity and kind, gravest first."""
    return findings.groupBy("severity", "kind").agg(F.count("*").alias("n")).orderBy(severity_rank(F.col("severity")), "kind")


def triage_over(parts: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """``triage`` over relations of findings, each with its severity and kind; kinds without a finding have no row."""
    out = None
    for severity, kind, df in parts:
        row = df.agg(F.count("*").alias("n")).select(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out.where("n > 0").orderBy(severity_rank(F.col("severity")), "kind")


def type_scan(judged: DataFrame, by: list[str]) -> DataFrame:
    """checked, mismatches and grave ones of files with a ``type_verdict`` in column ``v``."""
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    wrong = F.col("v.verdict") == "mismatch"
    return judged.groupBy(*by).agg(F.count("*").alias("checked"), count(wrong).alias("mismatches"), count(wrong & (F.col("v.severity") == "high")).alias("high"))


def storage(files: DataFrame, folder: str = "folder", size: str = "size") -> DataFrame:
    """files and bytes by folder, and those of all under a null folder."""
    return files.rollup(folder).agg(F.count("*").alias("files"), F.sum(size).cast("long").alias("bytes"))


# Techniques that an artefact of a kind may show, fixed values.
SUGGESTIONS = {
    "prefetch": ("T1204.002", "T1059.003"), "recyclebin": ("T1070.004",), "lnk": ("T1547.009", "T1204.002"), "browser": ("T1071.001", "T1105", "T1567.002"), "appcompat": ("T1204.002",), "shellbags": ("T1083",),
    "usn": ("T1070.004", "T1070.006"), "mail": ("T1114.001", "T1566.001"), "vss": ("T1490",), "evtx": ("T1070.001",), "registry": ("T1547.001", "T1112"), "leveldb": ("T1071.001",),
}


def suggestions(findings: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Techniques of ``catalogue`` (technique, name, ...) that the kinds of ``findings`` may show, with how many findings stand behind each."""
    known = F.create_map(*(x for k, ts in SUGGESTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, ts)))))
    seen = findings.groupBy("kind").agg(F.count("*").alias("findings")).withColumn("technique", F.explode(F.try_element_at(known, F.col("kind"))))
    return seen.join(catalogue, "technique").withColumn("status", F.lit("proposed"))


def reassociate(tags: DataFrame, identities: DataFrame) -> DataFrame:
    """Tags of evidence that is gone, moved to the only other evidence with the same volume key.

    ``tags``: evidence_id, part, node, tag; ``identities``: evidence_id, part, key, live.  Adds
    new_evidence, new_part and status: kept, moved, duplicate (the target has the tag), ambiguous
    (several targets) or lost (none).
    """
    gone = identities.where(~F.col("live")).select("evidence_id", "part", "key")
    targets = identities.where("live").groupBy("key").agg(F.count("*").alias("_n"), F.min(F.struct("evidence_id", "part")).alias("_to"))
    known = gone.join(targets, "key", "left").select("evidence_id", "part", F.coalesce("_n", F.lit(0)).alias("_n"), F.col("_to.evidence_id").alias("_e"), F.col("_to.part").alias("_p"), F.lit(True).alias("_gone"))
    out = tags.join(known, ["evidence_id", "part"], "left")
    there = tags.select(F.col("evidence_id").alias("_e"), F.col("part").alias("_p"), "node", "tag", F.lit(True).alias("_has")).distinct()
    out = out.join(there, ["_e", "_p", "node", "tag"], "left")
    status = F.when(F.col("_gone").isNull(), "kept").when(F.col("_n") == 0, "lost").when(F.col("_n") > 1, "ambiguous").when(F.col("_has"), "duplicate").otherwise("moved")
    one = F.col("_n") == 1
    return out.select("evidence_id", "part", "node", "tag", F.when(one, F.col("_e")).alias("new_evidence"), F.when(one, F.col("_p")).alias("new_part"), status.alias("status"))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those of the same keys."""
    return current.join(changes.select(*keys), keys, "left_anti").unionByName(changes)
