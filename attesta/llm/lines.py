"""Line dedup by a suffix array over line-ID sequences, in DataFrame functions only.

A document is a sequence of line IDs (128-bit digests of its lines that are not blank), and a suffix
is what follows from one of its lines.  Suffixes are ranked by distributed prefix doubling.  Ranks by
one line come from a sort of the distinct lines; ranks by 2h lines come from a sort of the distinct
pairs (rank by h lines here, rank by h lines h further on), so each round compares twice as many
lines by one exchange of pairs.  The suffixes of one rank are an interval of the suffix array whose
longest common prefix is h lines at least.  A suffix that is alone in its rank repeats nothing any
longer and leaves the doubling, so rounds shrink fast and end when all are told apart, or at
``max_lines``.

The earliest suffix of an interval is its first copy, all others are later copies, and the lines that
later copies of ``min_lines`` or more cover are deleted.  Ranks are found by pre-aggregated groups and
a range-partitioned sort; suffixes join the ranks that occur more than once, and hot ranks are split
by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MIN_LINES, MAX_LINES = 2, 32
_PLACE = ("id", "dig", "at")


def _digest(col):
    return F.unhex(F.md5(col))


def _suffixes(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dig, at, line): a suffix for each line that is not blank, by the digest of that line."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = documents.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("dig", _digest("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"\S"))
    # The outer form: the plain one adds a filter on the array's size, for which the optimiser repeats
    # the whole expression of the array below.
    return docs.select("id", "dig", F.posexplode_outer(F.transform(lines, lambda x: _digest(x.cast("binary")))).alias("at", "line")).where("line is not null")


def _ranked(suffixes: DataFrame, by: list[str]) -> DataFrame:
    """(id, dig, at, rank, first): suffixes that share the columns ``by`` with others.

    ``rank`` is the same for equal ones and grows with them, ``first`` is the place of the earliest.
    """
    place = F.struct(*_PLACE)
    groups = suffixes.groupBy(*by).agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    ranks = cut(groups.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()))
    return cut(suffixes.join(ranks, by).select(*_PLACE, "rank", "first"))


def intervals(documents: DataFrame, min_lines: int = MIN_LINES, max_lines: int = MAX_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dig, at, rank, first, lines): the intervals of the suffix array by common prefixes.

    Each row is a suffix in an interval of two or more whose first ``lines`` lines are equal, for
    ``lines`` of ``min_lines``, twice, four times as many, and so on to ``max_lines``.  ``first`` is the place
    (id, dig, at) of the earliest suffix of the interval, by id, then by ``dig``, then by line.
    """
    known, h, found = _ranked(_suffixes(documents, id_col, text_col), ["line"]), 1, None
    while True:
        if h >= min_lines:
            level = known.withColumn("lines", F.lit(h))
            found = level if found is None else found.unionByName(level)
        if h >= max(min_lines, max_lines) or known.isEmpty():
            return known.withColumn("lines", F.lit(h)).limit(0) if found is None else found
        step = min(h, (min_lines if h < min_lines else max_lines) - h)
        ahead = Window.partitionBy("id", "dig").orderBy("at").rangeBetween(step, step)
        pairs = known.select(*_PLACE, F.col("rank").alias("here"), F.first("rank").over(ahead).alias("next")).where("next is not null")
        known, h = _ranked(pairs, ["here", "next"]), h + step


def later_copies(documents: DataFrame, min_lines: int = MIN_LINES, max_lines: int = MAX_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dig, at, lines, first_id): runs of ``lines`` lines from line ``at`` that stand earlier as well.

    ``at`` counts lines that are not blank, ``dig`` is the MD5 of the text.  Of a place the longest run
    that the doubling came upon is given.
    """
    late = intervals(documents, min_lines, max_lines, id_col, text_col).where(~F.struct(*_PLACE).eqNullSafe(F.col("first")))
    return late.groupBy(*_PLACE).agg(F.max(F.struct("lines", F.col("first.id").alias("first_id"))).alias("run")).select(*_PLACE, "run.lines", "run.first_id")


def repeated_runs(documents: DataFrame, min_lines: int = MIN_LINES, max_lines: int = MAX_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal runs of later copies: id, dig, start, n_lines (lines that are not blank)."""
    late = later_copies(documents, min_lines, max_lines, id_col, text_col)
    before = Window.partitionBy("id", "dig").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    opened = late.withColumn("opens", F.coalesce(F.max(F.col("at") + F.col("lines")).over(before) < F.col("at"), F.lit(True)))
    run = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("id", "dig").orderBy("at")).alias("run")
    runs = opened.select("id", "dig", "at", "lines", run).groupBy("id", "dig", "run").agg(F.min("at").alias("start"), F.max(F.col("at") + F.col("lines")).alias("end"))
    return runs.select("id", "dig", "start", (F.col("end") - F.col("start")).alias("n_lines"))


def dedup_lines(documents: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text", max_lines: int = MAX_LINES) -> DataFrame:
    """``documents`` without later copies of runs of ``min_lines`` or more lines, plus n_lines and n_removed.

    Lines are parted by ``\\n`` and equal as bytes; blank lines (white space only) belong to no run
    and stay.  The first copy, by id, then by the MD5 of the text, then by line, is kept.  A text all
    of whose lines go becomes empty; null stays null with 0 lines, and an empty text has one line.
    ``max_lines`` bounds the doubling and changes nothing in what goes, as the lines of a longer run are
    covered by shorter ones.  Rows equal in id and text count as one document and come out alike.  Columns of ``documents``
    named n_lines or n_removed are replaced, all others kept.  An empty table gives an empty result.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be 1 or more")
    gone = later_copies(documents, min_lines, max_lines, id_col, text_col).groupBy("id", "dig").agg(F.collect_list(F.struct("at", "lines")).alias("runs"))
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["at"], r["at"] + r["lines"] - 1))))
    gone = gone.select(F.col("id").alias("_ld_id"), F.col("dig").alias("_ld_dig"), covered.alias("_ld_gone"))
    docs = documents.drop("n_lines", "n_removed")
    text = F.col(text_col).cast("string")
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col("_ld_id")) & (_digest(F.coalesce(text, F.lit(""))) == F.col("_ld_dig")), "left")
    joined = joined.withColumn("_ld_lines", F.split(text, "\n", -1)).withColumn("_ld_gone", F.coalesce("_ld_gone", F.array().cast("array<int>")))
    every = F.sequence(F.lit(0), F.size("_ld_lines") - 1)
    # Positions among lines that are not blank, as positions among all.
    joined = joined.withColumn("_ld_real", F.when(F.size("_ld_gone") > 0, F.filter(every, lambda i: F.get("_ld_lines", i).rlike(r"\S"))))
    left = F.array_except(every, F.transform("_ld_gone", lambda p: F.get("_ld_real", p)))
    clean = F.array_join(F.transform(left, lambda i: F.get("_ld_lines", i)), "\n")
    n_lines = F.when(text.isNull(), 0).otherwise(F.size("_ld_lines")).cast("long")
    kept = [(F.when(F.size("_ld_gone") > 0, clean).otherwise(text) if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns]
    return joined.select(*kept, n_lines.alias("n_lines"), F.size("_ld_gone").cast("long").alias("n_removed"))


ORACLE = f"""
WITH d AS (SELECT DISTINCT doc_id, md5(coalesce(text, '')) AS dig, coalesce(text, '') AS text FROM documents
), l AS (
  SELECT doc_id, dig, i, line FROM (SELECT doc_id, dig, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, dig ORDER BY i) - 1 AS pos FROM l WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')
), w AS (
  SELECT doc_id, dig, pos, {" , ".join(f"lead(line, {k}) OVER (PARTITION BY doc_id, dig ORDER BY pos) AS l{k}" for k in range(MIN_LINES))} FROM r
), f AS (
  SELECT {", ".join(f"l{k}" for k in range(MIN_LINES))}, min({{'a': doc_id, 'b': dig, 'c': pos}}) AS first FROM w WHERE l{MIN_LINES - 1} IS NOT NULL GROUP BY ALL
), late AS (
  SELECT doc_id, dig, pos FROM w JOIN f USING ({", ".join(f"l{k}" for k in range(MIN_LINES))}) WHERE {{'a': doc_id, 'b': dig, 'c': pos}} <> first
), gone AS (
  SELECT DISTINCT doc_id, dig, pos + k AS pos FROM late, range({MIN_LINES}) t(k)
), out AS (
  SELECT l.doc_id, l.dig, count(*) AS n_lines, count(gone.pos) AS n_removed,
         coalesce(string_agg(CASE WHEN gone.pos IS NULL THEN l.line END, chr(10) ORDER BY l.i), '') AS text
  FROM l LEFT JOIN r USING (doc_id, dig, i) LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.dig = l.dig AND gone.pos = r.pos
  GROUP BY l.doc_id, l.dig
)
SELECT p.doc_id, CASE WHEN p.text IS NULL THEN 0 ELSE n_lines END AS n_lines, n_removed, CASE WHEN p.text IS NOT NULL THEN out.text END AS text
FROM documents p JOIN out ON out.doc_id = p.doc_id AND out.dig = md5(coalesce(p.text, ''))
"""
