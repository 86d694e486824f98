"""Literal and regular-expression search in texts, files and raw blocks."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, excerpt
from .scratch import cut

PER_FILE, OVERLAP = 20, 1024
#: Rows of raw bytes that a task holds as Python objects at a time.
AT_ONCE = 64


def few_at_once(batches, rows: int = AT_ONCE):
    """Arrow batches in slices of ``rows``, so that what is found in a full batch of 10,000 blocks is never held at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def search_names(entries: DataFrame, terms: list[str], regex: bool = False) -> DataFrame:
    """Entries whose name holds any term without case, with the terms that hit."""
    test = (lambda t: F.lower("name").rlike("(?i)" + t)) if regex else (lambda t: F.contains(F.lower("name"), F.lit(t.lower())))
    hit = F.array_compact(F.array(*(F.when(test(t), F.lit(t)) for t in terms)))
    return entries.withColumn("terms", hit).where(F.size("terms") > 0)


def search_texts(docs: DataFrame, terms: list[str], per_file: int = PER_FILE, key: str = "id", body: str = "body", context: int = 32) -> DataFrame:
    """(id, term, offset, context, more): places of literal terms, A-Z without case, that do not overlap.

    ``offset`` counts characters from 0.  ``per_file`` places a document are shown, the earliest, and
    ``more`` on the last of them tells how many others there are.
    """
    held = docs.select(F.col(key).alias("id"), F.col(body).alias("body"), ascii_lower(F.col(body)).alias("low"))
    wanted = [t for t in dict.fromkeys(terms) if t]
    if not wanted:
        return held.select("id", F.lit("").alias("term"), F.lit(0).alias("offset"), F.lit("").alias("context"), F.lit(0).cast("long").alias("more")).limit(0)
    lows = [ascii_lower(F.lit(t)) for t in wanted]
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def places(term: str, low):
        # Pieces between the places give where each begins, in one pass of the text.
        pieces, size = F.split("low", F.concat(F.lit("\\Q"), low, F.lit("\\E")), -1), F.length(low)
        begin = lambda acc, x: F.struct((acc["at"] + F.length(x) + size).alias("at"), F.concat(acc["found"], F.array(acc["at"] + F.length(x))).alias("found"))
        found = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), zero, begin)["found"]
        return F.when(F.contains("low", low), F.transform(found, lambda x: F.struct(x.alias("offset"), F.lit(term).alias("term")))).otherwise(F.array().cast("array<struct<offset:int,term:string>>"))

    # Places are put in order, cut off and given their context within the row of their document; nothing is exchanged.
    some = held.where(functools.reduce(operator.or_, (F.contains("low", low) for low in lows)))
    every = some.select("id", "body", F.array_sort(F.concat(*(places(t, low) for t, low in zip(wanted, lows, strict=True)))).alias("all"))
    left = F.size("all") - per_file
    shown = F.transform(F.slice("all", 1, per_file), lambda h, i: F.struct(
        h["term"].alias("term"), h["offset"].alias("offset"), excerpt(F.col("body"), h["offset"] + 1, context, context + 32).alias("context"),
        F.when((i == per_file - 1) & (left > 0), left).otherwise(0).cast("long").alias("more"),
    ))
    return every.select("id", F.explode(shown).alias("h")).select("id", "h.*")


def search_regex(docs: DataFrame, pattern: str, key: str = "id", body: str = "body") -> DataFrame:
    """(id, match, n): what a regular expression finds in texts, and how often."""
    found = docs.select(F.col(key).alias("id"), F.explode(F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).alias("match"))
    return found.groupBy("id", "match").agg(F.count("*").alias("n"))


def _patterns(terms: list[str], encodings: tuple[str, ...], regex: bool, case_sensitive: bool):
    flags = 0 if case_sensitive else re.IGNORECASE
    for term in terms:
        for encoding in encodings:
            if not regex:
                yield term, encoding, re.compile(re.escape(term.encode(encoding)), flags), (0,)
            elif encoding == "ascii":
                yield term, encoding, re.compile(term.encode("latin-1"), flags), (0,)
            elif encoding == "utf-16-le":
                yield term, encoding, re.compile(term, flags), (0, 1)
            else:
                raise ValueError("regular expressions search ascii and utf-16-le only")


def with_edges(blocks: DataFrame, overlap: int) -> DataFrame:
    """(evidence_id, offset, edge, data): blocks as they are, and the bytes round each edge between two.

    ``edge`` is null for a block, else where in ``data`` the edge lies; what crosses it counts there.
    Only the ends of blocks are exchanged, never the blocks.  Blocks but the last of an evidence are
    ``overlap`` bytes or longer.
    """
    tails = blocks.select("evidence_id", (F.col("offset") + F.length("data")).alias("at"), F.substring(F.col("data"), F.greatest(F.length("data") - overlap + 1, F.lit(1)), F.lit(overlap)).alias("tail"))
    heads = blocks.select("evidence_id", F.col("offset").alias("at"), F.substring("data", 1, overlap).alias("head")).where(F.length("head") > 0)
    edges = tails.where(F.length("tail") > 0).join(heads, ["evidence_id", "at"])
    crossing = edges.select("evidence_id", (F.col("at") - F.length("tail")).alias("offset"), F.length("tail").alias("edge"), F.concat("tail", "head").alias("data"))
    return blocks.select("evidence_id", "offset", F.lit(None).cast("int").alias("edge"), "data").unionByName(crossing)


def search_blocks(blocks: DataFrame, terms: list[str], encodings: tuple[str, ...] = ("ascii", "utf-16-le"), regex: bool = False, case_sensitive: bool = False, overlap: int = OVERLAP, context: int | None = None) -> DataFrame:
    """(evidence_id, offset, encoding, term): places in raw blocks (evidence_id, offset, data).

    With ``context`` also the bytes up to that far on either side of a place, of the block or the edge it was found
    in, and the offset they begin at (context, context_offset).

    A match across the edge of two blocks is found in the bytes round it, up to ``overlap`` bytes on
    either side.
    """
    patterns = list(_patterns(terms, encodings, regex, case_sensitive))

    def run(batches):
        for batch in few_at_once(batches):
            rows = set()
            for evidence, base, edge, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for term, encoding, pattern, alignments in patterns:
                    wide = regex and encoding == "utf-16-le"
                    for shift in alignments:
                        text = data[shift : shift + (len(data) - shift) // 2 * 2].decode("utf-16-le", "surrogatepass") if wide else data
                        for m in pattern.finditer(text):
                            # A character beyond the first plane is two code units.
                            start, end = (shift + len(text[:k].encode("utf-16-le", "surrogatepass")) if wide else k for k in m.span())
                            if start < end and (edge is None or start < edge < end):
                                low = max(0, start - (context or 0))
                                rows.add((evidence, base + start, encoding, term, *(() if context is None else (data[low : end + context], base + low))))
            columns = list(zip(*sorted(rows), strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    kinds = {"evidence_id": pa.int64(), "offset": pa.int64(), "encoding": pa.string(), "term": pa.string()} | ({} if context is None else {"context": pa.binary(), "context_offset": pa.int64()})
    schema = "evidence_id long, offset long, encoding string, term string" + ("" if context is None else ", context binary, context_offset long")
    return with_edges(blocks, overlap).mapInArrow(run, schema).distinct()


def search_first(blocks: DataFrame, sizes: DataFrame, terms: list[str], max_hits: int = 5000, first: int = 64 << 20, context: int = 32, stop: Callable[[], bool] | None = None, **more) -> tuple[DataFrame, DataFrame]:
    """The earliest ``max_hits`` places of each evidence, and how far each was searched.

    Places (evidence_id, offset, encoding, term, context, context_offset) are those of ``search_blocks``, by offset,
    encoding and term, with the context that it gives.  Coverage
    is (evidence_id, hits, truncated, complete_to): every place before ``complete_to`` is among the rows and none at or
    after it; where more than ``max_hits`` are there it is the offset of the first that is left out, else the size.
    Places that share that offset are left out with it.

    Evidence is searched from its start in rounds that end at ``first`` bytes, then twice, four times as far; one with
    more places than asked for is not read further.  A round reads the blocks of its ranges alone.

    ``stop`` is asked before each round; once it says yes no more is read, what was found is given, and evidence not
    read to its end is complete to the end of the last round, short of its size and not truncated.
    """
    spark = blocks.sparkSession
    overlap = more.get("overlap", OVERLAP)
    left = cut(sizes.select("evidence_id", "size"))
    found, start, end = [], 0, first
    while not left.isEmpty() and not (stop and stop()):
        asked = blocks.where((F.col("offset") < end + overlap) & (F.col("offset") + F.length("data") > start - overlap)).join(left, "evidence_id", "left_semi")
        hits = search_blocks(asked, terms, context=context, **more).where((F.col("offset") >= start) & (F.col("offset") < end))
        found.append(cut(hits))
        counts = functools.reduce(DataFrame.unionByName, found).groupBy("evidence_id").count()
        full = counts.where(F.col("count") > max_hits)
        left = cut(left.where(F.col("size") > end).join(full, "evidence_id", "left_anti"))
        start, end = end, end * 2
    every = functools.reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "evidence_id long, offset long, encoding string, term string, context binary, context_offset long")
    order = Window.partitionBy("evidence_id").orderBy("offset", "encoding", "term")
    ranked = cut(every.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_hits + 1))
    stops = ranked.where(F.col("_n") == max_hits + 1).select("evidence_id", F.col("offset").alias("_stop"))
    rows = ranked.join(stops, "evidence_id", "left").where((F.col("_n") <= max_hits) & (F.col("_stop").isNull() | (F.col("offset") < F.col("_stop")))).drop("_n", "_stop")
    left = left.select("evidence_id", F.lit(start).cast("long").alias("_read"))
    told = sizes.join(stops, "evidence_id", "left").join(left, "evidence_id", "left").join(rows.groupBy("evidence_id").agg(F.count("*").alias("hits")), "evidence_id", "left")
    coverage = told.select("evidence_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.col("_stop").isNotNull().alias("truncated"), F.coalesce("_stop", F.least("_read", "size"), F.col("size")).alias("complete_to"))
    return rows, coverage
