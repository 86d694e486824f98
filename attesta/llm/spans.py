"""Substring dedup over sliding spans of sentences.

A sentence ends at a closing mark before white space, at the end of a line, and at a comma, semicolon
or colon before white space as well.  So a passage that was set into running text has sentences of
its own from its first mark to its last, whatever stands around it; capitals tell nothing.  From
every sentence runs the shortest span of at least ``MIN_SENTENCES`` consecutive sentences with at
least ``MIN_WORDS`` words; any longer run is a union of such spans.  Spans are hashed to 128 bits over
their words with case and spacing folded, hashes are joined over all documents, and the sentences
that any span but the first of its hash covers are removed.

A run of fewer than ``MIN_WORDS`` words stays, as two short sentences often agree by chance.

A document names each hash once; what it repeats of its own is known to be no first span without an
exchange.  The minimum for each hash is pre-aggregated, and spans meet only the hashes that stand
more than once, in a join whose hot keys the adaptive skew join splits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, utf8

MIN_SENTENCES, MIN_WORDS = 2, 12
_BREAK = re.compile(r"\n\s*|(?<=[.!?…,;:])[\"'”’“»«)\]]*\s+|(?<=[。！？，；：])")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence that holds more than white space."""
    found, at = [], 0
    for m in _BREAK.finditer(text):
        if m.start() > at:
            found.append((at, m.start()))
        at = m.end()
    if len(text) > at:
        found.append((at, len(text)))
    return [(a, b) for a, b in found if not text[a:b].isspace()]


def spans(text: str, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> list[tuple[bytes, int, int]]:
    """(hash, first sentence, sentences) of the span from each sentence that has one."""
    words = [w for part in _BREAK.split(text.lower()) if (w := part.split())]
    folded = [" ".join(w).encode("utf-8", "surrogatepass") for w in words]
    total = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
    n, digest = len(words), xxhash.xxh3_128_digest
    ends = np.maximum(np.searchsorted(total, total[:-1] + min_words, side="left"), np.arange(n) + min_sentences)
    return [(digest(b" ".join(folded[i:j])), i, j - i) for i, j in enumerate(ends.tolist()) if j <= n]


def _own(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return documents.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("dig"), text.alias("text"))


def _hashed(docs: DataFrame, min_sentences: int, min_words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            hashes, ids, digs, at, own = [], [], [], [], []
            for doc_id, dig, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                seen = set()
                for h, i, n in spans(text.decode("utf-8", "replace"), min_sentences, min_words):
                    hashes.append(h)
                    ids.append(doc_id)
                    digs.append(dig)
                    at.append(i << 24 | n)
                    own.append(h in seen)
                    seen.add(h)
            halves = np.frombuffer(b"".join(hashes), dtype=">i8").astype(np.int64).reshape(-1, 2)
            arrays = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ids, pa.int64()), pa.array(digs, pa.int64()), pa.array(at, pa.int64()), pa.array(own, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["h1", "h2", "id", "dig", "at", "own"])

    return docs.mapInArrow(run, "h1 long, h2 long, id long, dig long, at long, own boolean")


def repeated_spans(documents: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal runs of sentences that non-first spans cover: doc_id, dig, start, n_sentences, first_doc_id.

    First is by doc_id, then by ``dig`` (a hash of the text), then by sentence.  ``first_doc_id`` is
    where the run's first span stands first.  Rows equal in id and text count as one document.
    Null and empty texts have no spans; an empty table gives an empty result; other columns are
    ignored.
    """
    docs = _own(documents, id_col, text_col)
    # A span's first sentence and its length are one number, ``at``, which orders as they do.
    hashed = _hashed(docs, min_sentences, min_words)
    place = F.struct("id", "dig", "at")
    first = hashed.where("not own").groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = cut(first.select("h1", "h2", "first"))
    # Spans known to be no first ones take part under a key that meets nothing, so one pass of the texts gives both.
    key = F.when(F.col("own"), F.xxhash64("h1", "dig", "at")).otherwise(F.col("h1"))
    met = hashed.withColumn("h1", key).join(first, ["h1", "h2"], "left").where(F.col("own") | (F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first"))))
    late = met.select("id", "dig", F.shiftright("at", 24).alias("at"), (F.col("at") % (1 << 24)).alias("size"), F.when(F.col("own"), F.col("id")).otherwise(F.col("first.id")).alias("first_id"))
    lists = late.groupBy("id", "dig").agg(F.collect_set(F.struct("at", "size", "first_id")).alias("covers"))

    def merge(batches):
        for batch in batches:
            out = []
            for doc_id, dig, covers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = end = first_id = None
                for c in sorted(covers, key=lambda c: (c["at"], c["size"], c["first_id"] is not None, c["first_id"] or 0)):
                    if start is not None and c["at"] <= end:
                        end = max(end, c["at"] + c["size"])
                        continue
                    if start is not None:
                        out.append((doc_id, dig, start, end - start, first_id))
                    start, end, first_id = c["at"], c["at"] + c["size"], c["first_id"]
                out.append((doc_id, dig, start, end - start, first_id))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "dig", "start", "n_sentences", "first_doc_id"])

    return lists.mapInArrow(merge, "doc_id long, dig long, start long, n_sentences long, first_doc_id long")


def dedup_spans(documents: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` without the sentences of ``repeated_spans``, plus n_removed (sentences).

    What stood between kept sentences stays.  Null texts stay null.  A column n_removed is replaced,
    all others are kept.
    """
    gone = repeated_spans(documents, min_sentences, min_words, id_col, text_col)
    gone = gone.groupBy(F.col("doc_id").alias("_sd_id"), F.col("dig").alias("_sd_dig")).agg(F.collect_list(F.struct("start", "n_sentences")).alias("_sd_runs"))
    docs = documents.drop("n_removed")
    text = F.col(text_col).cast("string")
    joined = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_sd_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_sd_dig")), "left")

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for raw, spots in zip(utf8(texts), runs.to_pylist(), strict=True):
            said = raw.decode("utf-8", "replace")
            bounds, kept, at = sentences(said), [], 0
            for r in sorted(spots, key=lambda r: r["start"]):
                kept.append(said[at : bounds[r["start"]][0]])
                last = r["start"] + r["n_sentences"]
                at = bounds[last][0] if last < len(bounds) else bounds[-1][1]
            out.append("".join([*kept, said[at:]]))
        return pa.array(out, pa.string())

    empty = F.array().cast("array<struct<start:bigint,n_sentences:bigint>>")
    clean = F.when(F.col("_sd_runs").isNotNull(), cleaned(F.coalesce(text, F.lit("")), F.coalesce("_sd_runs", empty))).otherwise(text)
    removed = F.coalesce(F.aggregate("_sd_runs", F.lit(0).cast("long"), lambda a, r: a + r["n_sentences"]), F.lit(0))
    return joined.select(*[(clean if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns], removed.alias("n_removed"))
