"""Full-text index: postings, phrases, ranked queries, snippets and coverage."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.detect import block_class
from .scratch import cut

TOKEN = r"[\p{L}\p{N}]+"
FIELDS = ("name", "path", "body")
K1, B = 1.2, 0.75


def tokens_of(text: str) -> list[str]:
    """Tokens of a query term, as the index has them."""
    return [t.lower() for t in re.findall(r"[^\W_]+", text)]


def postings(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "id", scope: tuple[str, ...] = ()) -> DataFrame:
    """(term, id, field, pos, and the columns of ``scope``) of every token; ``textstore`` keeps them on disk."""
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("text")) for f in fields if f in docs.columns))
    each = docs.select(F.col(key).alias("id"), *scope, F.explode(rows).alias("r"))
    return each.select("id", "r.field", *scope, F.posexplode(F.regexp_extract_all(F.lower("r.text"), F.lit(TOKEN), F.lit(0))).alias("pos", "term")).select("term", "id", "field", "pos", *scope)


def token_count(docs: DataFrame, fields: tuple[str, ...] = FIELDS):
    """A column: tokens of a document over its fields, counted where it stands."""
    return sum((F.size(F.regexp_extract_all(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))), F.lit(TOKEN), F.lit(0))) for f in fields if f in docs.columns), F.lit(0)).cast("long")


def document_sizes(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "id") -> DataFrame:
    """(id, length) as ``lengths`` gives them, without a row for each token; ``key`` is unique."""
    return docs.select(F.col(key).alias("id"), token_count(docs, fields).alias("length")).where("length > 0")


def lengths(index: DataFrame) -> DataFrame:
    """(id, length): tokens of each document."""
    return index.groupBy("id").agg(F.count("*").alias("length"))


def phrases_hits(index: DataFrame, phrases: list[str]) -> DataFrame:
    """(id, q, hits): how often the tokens of each phrase stand in a row within one field; ``q`` is its place in the list.

    Positions are shifted by the token's place in the phrase and counted together, so phrases of any
    number and length are one pass and one aggregate and no chain of joins.
    """
    split = [tokens_of(p) for p in phrases]
    wanted = [F.struct(F.lit(t).alias("t"), F.lit(q).alias("q"), F.lit(i).alias("i"), F.lit(len(ts)).alias("k")) for q, ts in enumerate(split) for i, t in enumerate(ts)]
    if not wanted:
        return index.select("id", F.lit(0).alias("q"), F.lit(0).cast("long").alias("hits")).limit(0)
    at = index.where(F.col("term").isin(sorted({t for ts in split for t in ts}))).withColumn("w", F.explode(F.filter(F.array(*wanted), lambda x: x["t"] == F.col("term"))))
    starts = at.groupBy("id", "w.q", "w.k", "field", (F.col("pos") - F.col("w.i")).alias("start")).agg(F.count("*").alias("n")).where(F.col("n") == F.col("k"))
    return starts.groupBy("id", "q").agg(F.count("*").alias("hits"))


def phrase_hits(index: DataFrame, phrase: str) -> DataFrame:
    """(id, hits) of one phrase."""
    return phrases_hits(index, [phrase]).select("id", "hits")


def ranked(index: DataFrame, terms: list[str], mode: str = "any", sizes: DataFrame | None = None) -> DataFrame:
    """(id, matched, score) of documents that hold any or all of the terms, each a phrase; BM25.

    Statistics are over the whole index, which is read once: what it has of the terms is kept, a row a document and phrase.
    """
    if mode not in ("any", "all"):
        raise ValueError("mode: any or all")
    phrases = [t for t in dict.fromkeys(terms) if tokens_of(t)]
    sizes = lengths(index) if sizes is None else sizes
    whole = sizes.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    if not phrases:
        return index.select("id", F.lit(0).cast("long").alias("matched"), F.lit(0.0).alias("score")).limit(0)
    hits = cut(phrases_hits(index, phrases))
    df = hits.groupBy("q").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("hits") * (K1 + 1) / (F.col("hits") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    one_row = F.broadcast(whole.withColumn("_one", F.lit(1)))
    scored = hits.join(F.broadcast(df), "q").join(sizes, "id").withColumn("_one", F.lit(1)).join(one_row, "_one")
    out = scored.groupBy("id").agg(F.count("*").alias("matched"), F.sum(part).alias("score"))
    return out.where(F.col("matched") == len(phrases)) if mode == "all" else out


def query(index: DataFrame, docs: DataFrame, terms: list[str], mode: str = "any", limit: int = 1000, scope=None, key: str = "id") -> DataFrame:
    """The best ``limit`` documents with their columns and a snippet, best first.

    Ranking runs on the narrow index; text is read for the documents that are returned only.
    """
    best = ranked(index, terms, mode)
    if scope is not None:
        best = best.join(docs.where(scope).select(F.col(key).alias("id")), "id", "left_semi")
    top = best.orderBy(F.desc("score"), "id").limit(limit)
    held = docs.withColumnRenamed(key, "id") if key != "id" else docs
    return top.join(held, "id").withColumn("snippet", snippet(terms)(F.col("body"))).orderBy(F.desc("score"), "id")


def snippet(terms: list[str], size: int = 12):
    """A column function: the ``size`` words round the first match, or the opening words without one."""
    words = sorted({t for p in terms for t in tokens_of(p)})

    @F.arrow_udf(T.StringType())
    def cut_out(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            found = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text or "")]
            if not found:
                out.append(None if text is None else "")
                continue
            at = next((i for i, f in enumerate(found) if f[2] in words), None)
            first = 0 if at is None else max(0, min(at - size // 2, len(found) - size))
            last = min(len(found), first + size)
            said = " ".join(text[found[first][0] : found[last - 1][1]].split())
            out.append(("…" if first else "") + said + ("…" if last < len(found) else ""))
        return pa.array(out, pa.string())

    return cut_out


def coverage(status: DataFrame) -> DataFrame:
    """Documents by kind of source, of (kind, indexed)."""
    return status.groupBy("kind").agg(F.count("*").alias("candidates"), F.sum(F.col("indexed").cast("long")).alias("indexed"))


# Runs of UTF-8 text; each kind of character is taken as far as it goes, and runs of fewer than four are left out after.
_NARROW = re.compile(rb"(?:[\t\x20-\x7e]++|[\xc3-\xdf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2})++")
_FOUR = re.compile(rb"(?:[\t\x20-\x7e]|[\xc3-\xdf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}){4}")
_SCRIPTS = ("latin", "letters", "ideographs")
_PAIR, _ALPHA, _BAD = 8, 16, 32


def _kinds() -> np.ndarray:
    """What each UTF-16 code unit is, in bits: of Latin text, of one other alphabet (Greek to Arabic, Georgian, Thai), of Han,
    kana and Hangul; two ASCII characters, a letter, and not printable."""
    low, high = np.tile(np.arange(256), 256), np.repeat(np.arange(256), 256)
    within = lambda c, *ranges: np.logical_or.reduce([(c >= a) & (c <= z) for a, z in ranges])
    text = [chr(i) for i in range(1 << 16)]
    bits = (
        within(low, (9, 9), (0x20, 0x7E), (0xA0, 0xFF)) & (high == 0) | (low <= 0x7F) & (high == 1),
        within(low, (0x20, 0x40), (0x5B, 0x60), (0x7B, 0x7E)) & (high == 0) | within(high, (3, 6), (0x0E, 0x0E), (0x10, 0x10)),
        within(high, (0x30, 0x30), (0x4E, 0x9F), (0xAC, 0xD7)) | within(low, (1, 0xEE)) & (high == 0xFF) | within(low, (0x20, 0x40)) & (high == 0),
        within(low, (0x20, 0x7E)) & within(high, (0x20, 0x7E)),
        np.array([c.isalpha() for c in text]),
        np.array([not c.isprintable() and c != "\t" for c in text]),
    )
    return sum(b.astype(np.uint8) << i for i, b in enumerate(bits)).astype(np.uint8)


_KINDS = _kinds()


def _wide_runs(data: bytes, shift: int):
    """(start, end, script) of runs of four or more UTF-16LE characters of a script that may be plausible."""
    if len(data) < shift + 8:
        return
    kinds = _KINDS[np.frombuffer(data, "<u2", (len(data) - shift) // 2, shift)]
    pairs = (kinds & _PAIR) != 0
    if pairs.all():  # ASCII only
        return
    sums = None
    for bit, script in enumerate(_SCRIPTS):
        inside = np.zeros(len(kinds) + 2, np.bool_)
        np.not_equal(kinds & (1 << bit), 0, out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        long = end - start >= 4
        if not long.any():
            continue
        start, end = start[long], end[long]
        if sums is None:
            sums = [np.concatenate(([0], np.cumsum(c))) for c in ((kinds & _ALPHA) != 0, (kinds & _BAD) != 0, pairs)]
        letters, bad, ascii_pairs = (c[end] - c[start] for c in sums)
        likely = (2 * letters >= end - start) & (bad == 0)
        if script == "ideographs":
            likely &= 2 * ascii_pairs < end - start
        for a, z in zip(start[likely].tolist(), end[likely].tolist(), strict=True):
            yield 2 * a + shift, 2 * z + shift, script


def _plausible(raw: bytes, text: str, script: str) -> bool:
    """Whether a run reads as text of its script, and not as other bytes taken in pairs."""
    letters = [c for c in text if c.isalpha()]
    if 2 * len(letters) < len(text) or not all(c.isprintable() or c == "\t" for c in text):
        return False
    if script == "latin":
        return sum(c < "\x7f" or "\xc0" <= c <= "\u017f" for c in letters) == len(letters) and sum(c < "\x80" for c in text) * 2 >= len(text)
    if script == "letters":
        return len({ord(c) >> 8 for c in letters}) == 1 and len(letters) >= 3
    # Han and kana do not mix with Hangul, and few of either come up by chance more often than many.
    hangul = sum("\uac00" <= c <= "\ud7a3" for c in letters)
    if hangul not in (0, len(letters)) or len(letters) < (5 if hangul else 8):
        return False
    # Two ASCII characters read as one ideograph: such pairs are rare in real ones.
    pairs = sum(0x20 <= x <= 0x7E and 0x20 <= y <= 0x7E for x, y in zip(raw[::2], raw[1::2], strict=True))
    return 2 * pairs < len(text)


def extract(data: bytes) -> str:
    """Readable runs of four or more characters in bytes: UTF-8, and UTF-16LE at either alignment.

    UTF-16 runs are of Latin letters, of one other alphabet, or of Han, kana and Hangul, and have to be
    plausible as such; of runs that overlap the longest counts.  Runs come in order, white space collapsed.
    """
    runs = [(m.start(), m.end(), m[0].decode("utf-8", "ignore")) for m in _NARROW.finditer(data) if m.end() - m.start() >= 12 or _FOUR.match(m[0])]
    for shift in (0, 1):
        for start, end, script in _wide_runs(data, shift):
            text = data[start:end].decode("utf-16-le", "replace")
            if _plausible(data[start:end], text, script):
                runs.append((start, end, text))
    taken, kept = bytearray(len(data)), []
    for start, end, text in sorted(runs, key=lambda r: (r[0] - r[1], r[0])):
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\1" * (end - start)
            kept.append((start, text))
    return " ".join(" ".join(t for _, t in sorted(kept)).split())


@F.arrow_udf(T.StringType())
def extracted(content: pa.Array) -> pa.Array:
    return pa.array([None if b is None else extract(b) for b in content.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _region_text(content: pa.Array) -> pa.Array:
    return pa.array([None if b is None else " ".join(w for w in extract(b).split(" ") if w) for b in content.to_pylist()], pa.string())


# A filter on a deterministic function is pushed below the projection, and the text would be looked for twice.
_region_text = _region_text.asNondeterministic()


def index_regions(blocks: DataFrame, most_entropy: float = 7.2, shortest: int = 8) -> DataFrame:
    """Documents (id, name, path, body, kind) of readable text in raw blocks.

    Zeroed blocks and those of an entropy above ``most_entropy`` hold none and are passed over before
    their text is looked for; runs under ``shortest`` characters are no text.
    """
    some = blocks.withColumn("_c", block_class("data")).where((F.col("_c.class") != "zero") & (F.col("_c.entropy") <= most_entropy))
    place = F.concat_ws("@", F.col("evidence_id"), F.col("offset"))
    return some.select(place.alias("id"), F.lit("").alias("name"), place.alias("path"), _region_text("data").alias("body"), F.lit("raw").alias("kind")).where(F.length("body") >= shortest)


def with_metadata(docs: DataFrame, metadata: DataFrame) -> DataFrame:
    """``docs`` with their metadata (id, name, value) before the body, so that a search finds both.

    Values stand in the order of their names; a document without metadata keeps its body.
    """
    said = F.array_sort(F.collect_list(F.concat_ws(" ", "name", F.col("value").cast("string"))))
    rows = metadata.groupBy("id").agg(F.array_join(said, " ").alias("_said"))
    return docs.join(rows, "id", "left").withColumn("body", F.when(F.col("_said").isNull(), F.col("body")).otherwise(F.concat_ws(" ", "_said", "body"))).drop("_said")


def index_all(*parts: DataFrame) -> DataFrame:
    """Documents of volumes, journals and raw regions as one relation to index."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def saved_search(hits: DataFrame, name: str, at: str, terms: list[str]) -> DataFrame:
    """Hits as rows of a record that is appended to and never changed."""
    return hits.select(F.lit(name).alias("search"), F.lit(at).alias("saved_at"), F.array(*map(F.lit, terms)).alias("terms"), F.struct(*hits.columns).alias("hit"))
