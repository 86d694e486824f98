"""Interval algebra: merging, gaps, containment and points in intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import Ordered

BIN = 1 << 26


def _islands(spans: DataFrame, by: list[str], touching: bool, kind: str | None) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("start") > reach if touching else F.col("start") >= reach, F.lit(True))
    if kind:
        apart = apart | ~F.col(kind).eqNullSafe(F.lag(kind).over(order))
    islands = spans.withColumn("_new", apart.cast("long")).withColumn("_island", F.sum("_new").over(order))
    more = [F.first(kind).alias(kind)] if kind else []
    return islands.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), *more).drop("_island")


def merge(spans: DataFrame, by: list[str], touching: bool = True, kind: str | None = None, bin_size: int = BIN, tasks: int | None = None) -> DataFrame:
    """Overlapping (and touching) spans [start, end) of each group as one, with how many went in.

    Spans are merged within bins of the axis first, so a group with most of the rows is many tasks'
    work and what meets in its last step are islands.  With ``kind``, a change of that column starts
    a new span as well; neighbours decide then, and groups are merged whole.
    With ``tasks`` spans are dealt over that many, where adaptive execution decides otherwise.
    """
    deal = lambda df, *keys: df.repartition(tasks, *keys) if tasks else df
    held = spans.where("start < end").select(*by, "start", "end", *([kind] if kind else []), F.lit(1).cast("long").alias("n"))
    if kind is None:
        held = _islands(deal(held.withColumn("_bin", F.floor(F.col("start") / bin_size)), *by, "_bin"), [*by, "_bin"], touching, None).drop("_bin")
    return _islands(deal(held, *by) if by else held, by, touching, kind)


def gaps(spans: DataFrame, sizes: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """What spans leave free of [0, size) in each group, in pieces of ``least`` or more.

    ``sizes`` holds the size of each group; a group without spans is one gap.
    """
    merged = merge(spans, by)
    last = sizes.select(*by, F.col("size").alias("start"), F.col("size").alias("end"))
    order = Window.partitionBy(*by).orderBy("start", "end")
    edges = merged.select(*by, "start", "end").join(sizes, by).select(*by, F.least("start", "size").alias("start"), F.least("end", "size").alias("end")).unionByName(last)
    free = edges.select(*by, F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("from"), F.col("start").alias("to"))
    return free.select(*by, F.col("from").alias("start"), F.col("to").alias("end")).where(F.col("end") - F.col("start") >= least)


def contained(points: DataFrame, spans: DataFrame, by: list[str], at: str = "offset", bin_size: int = BIN) -> DataFrame:
    """``points`` that lie in some span of their group, by an equality join on bins of the axis.

    A span stands in every bin it touches, so a bin joins its own points and spans only; merge spans
    first where they overlap much.
    """
    keyed = points.withColumn("_bin", F.floor(F.col(at) / bin_size))
    dealt = spans.where("start < end").select(*by, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))).alias("_bin"))
    inside = (keyed[at] >= dealt["start"]) & (keyed[at] < dealt["end"])
    same = inside & (keyed["_bin"] == dealt["_bin"])
    for c in by:
        same = same & (keyed[c] == dealt[c])
    return keyed.join(dealt, same, "left_semi").drop("_bin")


def drop_contained(hits: DataFrame, by: list[str]) -> DataFrame:
    """Hits (offset, length) without those strictly smaller and inside another of their group."""
    order = Window.partitionBy(*by).orderBy("offset", F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("offset") + F.col("length")
    reach = F.max(F.struct(end.alias("end"), F.col("length").alias("length"))).over(order)
    kept = hits.withColumn("_r", reach).where(F.col("_r").isNull() | (F.col("_r.end") < end) | ((F.col("_r.end") >= end) & (F.col("_r.length") <= F.col("length"))))
    return kept.drop("_r")


def single_gap(hits: DataFrame, allocated: DataFrame, by: list[str], bin_size: int = BIN) -> DataFrame:
    """Hits [start, end) with exactly one allocated span strictly inside: the file in two fragments.

    Adds gap_start and gap_end.
    """
    h = hits.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))))
    a = allocated.select(*by, F.col("start").alias("gap_start"), F.col("end").alias("gap_end"), F.floor(F.col("start") / bin_size).alias("_bin"))
    inside = h.join(a, [*by, "_bin"]).where("gap_start > start and gap_start < end")
    found = inside.groupBy(*by, "start", "end").agg(F.count("*").alias("_n"), F.first("gap_start").alias("gap_start"), F.first("gap_end").alias("gap_end"))
    return found.where("_n = 1 and gap_end < end").drop("_n")


def bounds_by_next(hits: DataFrame, by: list[str], limit: str = "max_length") -> DataFrame:
    """Hits with the length up to the next hit of their kind, at most ``limit``, and which of both bound it."""
    near = Ordered(hits, by, ["offset"]).carry(ahead=True, _next=("near", F.col("offset"))).rows()
    return near.withColumn("_next", F.col("_next") - F.col("offset")).select(
        *hits.columns, F.least(F.col("_next"), F.col(limit)).alias("length"), F.when(F.col("_next") < F.col(limit), "next_header").otherwise("limit").alias("bounded_by")
    )


def volume_map(spans: DataFrame, sizes: DataFrame, by: list[str], limit: int = 192) -> DataFrame:
    """Named spans (family, kind, number, start, end) of each group, with neighbours of one kind as one.

    Spans outside [0, size) are left out and counted in ``dropped``; the ``limit`` first of a group
    are told, and ``total`` says how many there are.
    """
    sized = spans.join(sizes.select(*by, "size"), by).withColumn("_in", (F.col("start") >= 0) & (F.col("end") <= F.col("size")) & (F.col("start") < F.col("end")))
    out_of_range = sized.groupBy(*by).agg(F.sum((~F.col("_in")).cast("long")).alias("dropped"))
    before = F.struct("family", "kind", "end")
    placed = Ordered(sized.where("_in"), by, ["start", "end", "family"]).carry(_b=("near", before))
    same = F.col("family").eqNullSafe(F.col("_b.family")) & F.col("kind").eqNullSafe(F.col("_b.kind")) & (F.col("start") <= F.col("_b.end"))
    placed = placed.add(_new=(~F.coalesce(same, F.lit(False))).cast("long"))
    runs = placed.carry(_run=("sum", F.col("_new"))).rows().withColumn("_run", F.coalesce("_run", F.lit(0)) + F.col("_new"))
    merged = runs.groupBy(*by, "_run").agg(F.first("family").alias("family"), F.first("kind").alias("kind"), F.min("number").alias("first_number"), F.max("number").alias("last_number"), F.min("start").alias("start"), F.max("end").alias("end"))
    place = Window.partitionBy(*by).orderBy("start", "end", "family")
    told = merged.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= limit).join(merged.groupBy(*by).agg(F.count("*").alias("total")), by)
    return told.join(out_of_range, by).drop("_n", "_run")
