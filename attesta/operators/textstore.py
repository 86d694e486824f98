"""A text index on disk: immutable segments, and a log of versions that says which of them count.

Below a path, ``postings`` (term, id, field, pos, evidence, part) and ``documents`` (id, kind, size,
status, length, evidence, part) hold a folder a segment; postings are laid out by a hash of the term and
sorted by term, so a query opens the folders and row groups of its terms and no text is read again.
``live`` (evidence, part, segment) names the segments of each scope, ``dead`` (evidence, part, id,
segment) the documents of a segment that later ones replaced.  A version is one small file in ``log``
that names the segments, the ``live`` and the ``dead`` table; it is written last and under a new number,
so a change is seen whole or not at all, a failed one changes nothing, and a reader that began keeps its
version.  Segments that no version needs go with ``vacuum``.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textindex

BUCKETS = 8
SCOPE = ("evidence", "part")
_DOCUMENTS = "id long, kind string, size long, status string, length long, evidence string, part string, segment string"
_POSTINGS = "term string, id long, field string, pos int, evidence string, part string, segment string, bucket int"
_LIVE = "evidence string, part string, segment string"
_DEAD = "evidence string, part string, id long, segment string"
#: Rows of ``live`` or ``dead`` up to which they are broadcast.
FEW = 1_000_000
#: Bytes of stored postings that a task sorts anew; a posting takes about five bytes on disk and a hundred in a sort.
READ = 16 << 20
_SPLIT = "spark.sql.files.maxPartitionBytes"


@dataclass(frozen=True)
class Version:
    """One state of the index; ``dead`` is None where no document is."""

    number: int = 0
    buckets: int = BUCKETS
    segments: tuple[str, ...] = ()
    live: str | None = None
    n_live: int = 0
    dead: str | None = None
    n_dead: int = 0


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """Names below a folder with the seconds since they changed."""
    fs, at = _files(spark, path)
    if not fs.exists(at(path)):
        return []
    return [(f.getPath().getName(), time.time() - f.getModificationTime() / 1000) for f in fs.listStatus(at(path))]


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    return sorted(int(n.removesuffix(".json")) for n, _ in _names(spark, f"{path}/log") if n.removesuffix(".json").isdigit())


def opened(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The latest version, or the one with ``number``; an index never written is empty."""
    there = versions(spark, path)
    if number is None and not there:
        return Version()
    name = f"{(there[-1] if number is None else number):012d}.json"
    said = json.loads("".join(r[0] for r in spark.read.text(f"{path}/log/{name}", wholetext=True).collect()))
    return Version(**said | {"segments": tuple(said["segments"])})


def _commit(spark: SparkSession, path: str, after: Version) -> Version:
    """Makes ``after`` the next version; fails if another writer was first."""
    held = replace(after, number=after.number + 1)
    fs, at = _files(spark, path)
    draft, final = at(f"{path}/log/.{uuid.uuid4().hex}"), at(f"{path}/log/{held.number:012d}.json")
    out = fs.create(draft, False)
    out.write(json.dumps(held.__dict__).encode())
    out.close()
    jvm = spark._jvm
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    full = fs.makeQualified(final)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(full.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), full, none)
    except Exception as failure:
        fs.delete(draft, False)
        raise RuntimeError(f"version {held.number} of {path} exists: another writer was first") from failure
    return held


def bucket_of(term, buckets: int = BUCKETS):
    """The folder of a term."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def candidates(files: DataFrame) -> DataFrame:
    """``files`` (id, name, path, body, size, evidence, part, kind if there) with ``status``.

    empty: a size of zero or none; unreadable: a size but a null body; no_text: a body without one
    token; else indexed.  A null evidence or part is the empty text, a null kind is a file.
    """
    kind = F.coalesce(F.col("kind"), F.lit("file")) if "kind" in files.columns else F.lit("file")
    scope = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SCOPE}
    token = F.coalesce(F.col("body").rlike(textindex.TOKEN), F.lit(False))
    status = F.when(F.coalesce("size", F.lit(0)) == 0, "empty").when(F.col("body").isNull(), "unreadable").when(~token, "no_text").otherwise("indexed")
    return files.withColumns({**scope, "kind": kind, "status": status})


def _save(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    df.write.mode("error").partitionBy(*by).parquet(path)


@contextmanager
def _reads_of(spark: SparkSession, size: int | None):
    """What a task reads of files while the block runs; the session's own setting without a size, and again afterwards."""
    before = spark.conf.get(_SPLIT)
    if size:
        spark.conf.set(_SPLIT, size)
    try:
        yield
    finally:
        spark.conf.set(_SPLIT, before)


def _save_segment(postings: DataFrame, documents: DataFrame, path: str, buckets: int, placed: bool = False) -> str:
    """Writes both tables of a new segment.  Postings are exchanged once, by bucket; adaptive execution splits a folder
    that holds much (a very frequent term) over several tasks, which write a file each.  Postings that are ``placed``
    come from folders of the same buckets: a task reads few of them and sorts what it read, and nothing is exchanged."""
    segment = uuid.uuid4().hex
    dealt = postings if placed else postings.withColumn("bucket", bucket_of(F.col("term"), buckets)).hint("rebalance", F.col("bucket"))
    laid_out = dealt.sortWithinPartitions("bucket", "term", *SCOPE, "id")
    with _reads_of(postings.sparkSession, READ if placed else None):
        _save(laid_out, f"{path}/postings/segment={segment}", ("bucket",))
    _save(documents.hint("rebalance").sortWithinPartitions(*SCOPE, "id"), f"{path}/documents/segment={segment}")
    return segment


def _written(files: DataFrame, path: str, buckets: int) -> str:
    judged = candidates(files)
    sizes = judged.withColumn("length", F.when(F.col("status") == "indexed", textindex.token_count(judged)).otherwise(0).cast("long"))
    documents = sizes.select(F.col("id").cast("long").alias("id"), "kind", F.col("size").cast("long").alias("size"), "status", "length", *SCOPE)
    return _save_segment(textindex.postings(judged.where("status = 'indexed'"), scope=SCOPE), documents, path, buckets)


def _none(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, and no Python worker that is started for them."""
    return spark.range(0).select(F.from_json(F.lit(None).cast("string"), schema).alias("r")).select("r.*")


def _relation(spark: SparkSession, path: str, name: str | None, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}") if name else _none(spark, schema)


def _with_relations(spark: SparkSession, path: str, before: Version, segments: tuple[str, ...], live: DataFrame, dead: DataFrame | None) -> Version:
    """``before`` with new segments and tables; rows of segments that are left out go."""
    names, sizes = {}, {}
    for name, df in (("live", live), ("dead", dead)):
        names[name] = sizes[name] = None
        if df is not None:
            kept = f"{name}/{uuid.uuid4().hex}"
            _save(df, f"{path}/{kept}")
            sizes[name] = spark.read.parquet(f"{path}/{kept}").count()
            names[name] = kept if sizes[name] else None
    return replace(before, segments=segments, live=names["live"], n_live=sizes["live"] or 0, dead=names["dead"], n_dead=sizes["dead"] or 0)


def build(files: DataFrame, path: str, buckets: int | None = None, scopes: list[tuple[str, str]] = ()) -> Version:
    """Indexes ``files``; every scope that ``files`` has, and every one of ``scopes``, is replaced as a whole.

    ``scopes`` also empties scopes that no file is left of.  ``buckets`` counts for a new index only.
    """
    spark = files.sparkSession
    before = opened(spark, path)
    before = before if before.number or not buckets else replace(before, buckets=buckets)
    segment = _written(files, path, before.buckets)
    fresh = spark.read.schema(_DOCUMENTS).option("basePath", f"{path}/documents").parquet(f"{path}/documents/segment={segment}").select(*_clean_scope(), "segment").distinct()
    taken = fresh.select(*SCOPE)
    if scopes:
        taken = taken.unionByName(spark.createDataFrame([(str(e or ""), str(p or "")) for e, p in scopes], "evidence string, part string")).distinct()
    old = _relation(spark, path, before.live, _LIVE)
    live = old.join(taken, list(SCOPE), "left_anti").unionByName(fresh.select(*SCOPE, "segment"))
    dead = _relation(spark, path, before.dead, _DEAD).join(taken, list(SCOPE), "left_anti") if before.dead else None
    return _commit(spark, path, _with_relations(spark, path, before, (*before.segments, segment), live, dead))


def add(files: DataFrame, path: str) -> Version:
    """Indexes ``files`` beside what their scopes hold; a document whose evidence, part and id are there takes its place."""
    spark = files.sparkSession
    before = opened(spark, path)
    segment = _written(files, path, before.buckets)
    fresh = spark.read.schema(_DOCUMENTS).option("basePath", f"{path}/documents").parquet(f"{path}/documents/segment={segment}").select(*_clean_scope(), "id", "segment")
    live = _relation(spark, path, before.live, _LIVE).unionByName(fresh.select(*SCOPE, "segment").distinct())
    replaced = documents(spark, path, version=before).select(*SCOPE, "id", "segment").join(fresh.select(*SCOPE, "id").distinct(), [*SCOPE, "id"], "left_semi")
    dead = _relation(spark, path, before.dead, _DEAD).unionByName(replaced)
    return _commit(spark, path, _with_relations(spark, path, before, (*before.segments, segment), live, dead))


def remove(keys: DataFrame, path: str) -> Version:
    """Takes documents (evidence, part, id) out of the index."""
    spark = keys.sparkSession
    before = opened(spark, path)
    asked = keys.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in SCOPE), F.col("id").cast("long").alias("id")).distinct()
    gone = documents(spark, path, version=before).select(*SCOPE, "id", "segment").join(asked, [*SCOPE, "id"], "left_semi")
    dead = _relation(spark, path, before.dead, _DEAD).unionByName(gone)
    return _commit(spark, path, _with_relations(spark, path, before, before.segments, _relation(spark, path, before.live, _LIVE), dead))


def clear(spark: SparkSession, path: str, evidence: str | None = None, part: str | None = None) -> Version:
    """Removes a scope, all scopes of an evidence or a part, or all of the index, without reading a posting."""
    before = opened(spark, path)
    asked = F.lit(True)
    for name, value in zip(SCOPE, (evidence, part), strict=True):
        if value is not None:
            asked = asked & (F.col(name) == str(value))
    live, dead = (_relation(spark, path, n, s).where(~asked) for n, s in ((before.live, _LIVE), (before.dead, _DEAD)))
    held = _with_relations(spark, path, before, before.segments, live, dead if before.dead else None)
    return _commit(spark, path, held if held.live else replace(held, segments=()))


def compact(spark: SparkSession, path: str, buckets: int | None = None) -> Version:
    """Merges all segments into one that holds what counts; readers of earlier versions go on."""
    before = opened(spark, path)
    if not before.segments:
        return before
    after = replace(before, buckets=buckets or before.buckets)
    placed = after.buckets == before.buckets and max(before.n_live, before.n_dead) <= FEW
    held = postings(spark, path, version=before).drop("segment")
    segment = _save_segment(held if placed else held.drop("bucket"), documents(spark, path, version=before).drop("segment"), path, after.buckets, placed)
    live = _relation(spark, path, before.live, _LIVE).select(*SCOPE).distinct().withColumn("segment", F.lit(segment))
    return _commit(spark, path, _with_relations(spark, path, after, (segment,), live, None))


def vacuum(spark: SparkSession, path: str, keep: int = 1, older_than: float = 86_400.0) -> list[str]:
    """Deletes versions but the last ``keep`` and what only those need, if unchanged for ``older_than`` seconds, which
    leaves segments alone that a writer is making.  Returns what it deleted."""
    there = versions(spark, path)
    held = [opened(spark, path, n) for n in there[-keep:]]
    needed = {f"{t}/segment={s}" for v in held for s in v.segments for t in ("postings", "documents")} | {x for v in held for x in (v.live, v.dead) if x}
    needed |= {f"log/{v.number:012d}.json" for v in held}
    fs, at = _files(spark, path)
    gone = [f"{t}/{n}" for t in ("log", "postings", "documents", "live", "dead") for n, age in _names(spark, f"{path}/{t}") if age >= older_than and f"{t}/{n}" not in needed]
    for name in gone:
        fs.delete(at(f"{path}/{name}"), True)
    return gone


def _clean_scope() -> list:
    return [F.coalesce(c, F.lit("")).alias(c) for c in SCOPE]


def _held(spark: SparkSession, path: str, name: str, schema: str, version: Version, evidence: str | None, part: str | None) -> DataFrame:
    """Rows of a table that count in ``version``; only segments that hold the scope are opened."""
    live = _relation(spark, path, version.live, _LIVE)
    asked = [F.col(c) == str(v) for c, v in zip(SCOPE, (evidence, part), strict=True) if v is not None]
    for condition in asked:
        live = live.where(condition)
    segments = version.segments if not asked else sorted(r[0] for r in live.select("segment").distinct().collect())
    if not segments:
        return _none(spark, schema)
    rows = spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(*(f"{path}/{name}/segment={s}" for s in segments))
    rows = rows.where(" AND ".join(f"{c} = '{_quoted(v)}'" for c, v in zip(SCOPE, (evidence, part), strict=True) if v is not None)) if asked else rows
    few = lambda df, n: F.broadcast(df) if n <= FEW else df
    rows = rows.join(few(live, version.n_live), [*SCOPE, "segment"], "left_semi")
    if version.dead:
        rows = rows.join(few(_relation(spark, path, version.dead, _DEAD), version.n_dead), [*SCOPE, "id", "segment"], "left_anti")
    return rows


def _quoted(value) -> str:
    return str(value).replace("\\", "\\\\").replace("'", "\\'")


def postings(spark: SparkSession, path: str, terms: list[str] | None = None, evidence: str | None = None, part: str | None = None, version: Version | None = None) -> DataFrame:
    """Postings of a scope; with ``terms`` only the folders of their tokens are opened."""
    version = version or opened(spark, path)
    held = _held(spark, path, "postings", _POSTINGS, version, evidence, part)
    if terms is None:
        return held
    tokens = sorted({t for p in terms for t in textindex.tokens_of(p)})
    if not tokens:
        return held.limit(0)
    named = spark.range(1).select(F.array_distinct(F.array(*(bucket_of(F.lit(t), version.buckets) for t in tokens))).alias("b")).first()["b"]
    return held.where(F.col("bucket").isin(sorted(named)) & F.col("term").isin(tokens))


def documents(spark: SparkSession, path: str, evidence: str | None = None, part: str | None = None, version: Version | None = None) -> DataFrame:
    return _held(spark, path, "documents", _DOCUMENTS, version or opened(spark, path), evidence, part)


def ranked(spark: SparkSession, path: str, terms: list[str], mode: str = "any", evidence: str | None = None, part: str | None = None, version: Version | None = None) -> DataFrame:
    """(id, matched, score) as ``textindex.ranked`` gives them; statistics are those of the scope, all of one version."""
    version = version or opened(spark, path)
    sizes = documents(spark, path, evidence, part, version).where("status = 'indexed'").select("id", "length")
    return textindex.ranked(postings(spark, path, terms, evidence, part, version), terms, mode, sizes)


def build_report(held: DataFrame, by: list[str]) -> DataFrame:
    """What a build took and left out, by scope: candidates, indexed, with_content, the skips, coverage.

    ``coverage`` is indexed over with_content, which leaves out empty files; 1 where nothing had content.
    """
    count = lambda s: F.sum((F.col("status") == s).cast("long"))
    with_content = F.sum((F.col("status") != "empty").cast("long"))
    share = F.when(with_content == 0, 1.0).otherwise(F.round(count("indexed") / with_content, 4))
    skips = [count(s).alias(s) for s in ("empty", "unreadable", "no_text")]
    return held.groupBy(*by).agg(F.count("*").alias("candidates"), count("indexed").alias("indexed"), with_content.alias("with_content"), *skips, share.alias("coverage"))


def status(held: DataFrame) -> DataFrame:
    """One row: documents, those of files, of journals and of raw regions, and whether raw space was read."""
    rows = held.where("status = 'indexed'")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    kind = F.col("kind")
    out = rows.agg(F.count("*").alias("documents"), count(kind.isin("", "file")).alias("file_documents"), count(kind == "usn").alias("usn_documents"), count(~kind.isin("", "file", "usn")).alias("raw_documents"))
    return out.withColumn("complete", F.col("raw_documents") > 0)
