"""Replaying logs and layers as relations: which entry, page or layer says what a byte is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import Ordered
from .scratch import cut

#: Bytes before the bins of a hive.
BASE = 4096
#: Bytes of a range within which writes meet.
BIN = 1 << 16
#: Bytes of a sub-block of a layer, and the mask of all its sub-blocks.
SUB, ALL = 512, (1 << 32) - 1


def applied_entries(hives: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries that a replay reads: (hive, sequence, log, position, log_size, hbins_size).

    Of entries of one sequence the first by (log, position) counts.  A dirty hive (primary and secondary sequence
    differ) starts at its secondary sequence and goes on while the next sequence is there; it reads none where the
    start is missing.  ``hives`` has (hive, primary, secondary, size), hive being its key.
    """
    place = F.struct("log", "position")
    first = entries.groupBy("hive", "sequence").agg(F.min_by(F.struct("log", "position", "log_size", "hbins_size"), place).alias("e"))
    dirty = hives.where("primary != secondary").select("hive", "secondary")
    later = first.join(dirty, "hive").where("sequence >= secondary")
    counted = Ordered(later, ["hive"], ["sequence"]).carry(before=("sum", F.lit(1).cast("long"))).rows()
    # The sequences are distinct, so the number before one tells whether any is missing.
    return counted.where(F.col("sequence") - F.col("secondary") == F.coalesce("before", F.lit(0))).select("hive", "sequence", "e.*")


def _replayed(hives: DataFrame, entries: DataFrame, pages: DataFrame, keep=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(the report, the pages that are written with their entry); ``keep`` makes of the pages what is read again."""
    run = applied_entries(hives, entries)
    written = keep(pages.join(run.select("hive", "log", "position", "sequence", "log_size"), ["hive", "log", "position"]).select("hive", "sequence", "page", "offset", "length", "log_size"))
    by_entry = run.join(hives.select("hive", "size"), "hive").groupBy("hive").agg(
        F.count("*").alias("applied"), F.max("sequence").alias("sequence_after"), F.max(F.col("hbins_size") + BASE).alias("need"),
        F.max((F.col("hbins_size") + BASE > F.col("size") + F.col("log_size")).cast("int")).alias("big_entry"),
    )
    end = F.col("offset") + F.col("length") + BASE
    by_page = written.join(hives.select("hive", "size"), "hive").groupBy("hive").agg(F.count("*").alias("pages"), F.sum("length").alias("bytes"), F.max(end).alias("reach"), F.max((end > F.col("size") + F.col("log_size")).cast("int")).alias("big_page"))
    held = entries.groupBy("hive").agg(F.countDistinct("sequence").alias("entries"))
    out = hives.join(held, "hive", "left").join(by_entry, "hive", "left").join(by_page, "hive", "left")
    oversize = F.greatest(F.coalesce("big_entry", F.lit(0)), F.coalesce("big_page", F.lit(0))) == 1
    status = F.when(F.col("primary") == F.col("secondary"), "clean").when(F.col("entries").isNull(), "no_entries").when(F.col("applied").isNull(), "missing_start").when(oversize, "oversize").otherwise("replayed")
    done = F.col("status") == "replayed"
    zero = lambda c: F.when(done, F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    report = out.withColumn("status", status).select(
        "hive", "status", zero("applied").alias("applied"), F.when(done, F.col("sequence_after")).alias("sequence_after"), F.when(done, F.col("entries") - F.col("applied")).otherwise(0).cast("long").alias("beyond_gap"),
        zero("pages").alias("pages"), zero("bytes").alias("bytes"), F.when(done, F.greatest("size", "need", "reach")).otherwise(F.col("size")).cast("long").alias("size_after"),
    )
    return report, written


def replay_report(hives: DataFrame, entries: DataFrame, pages: DataFrame) -> DataFrame:
    """(hive, status, applied, sequence_after, beyond_gap, pages, bytes, size_after) of each hive.

    status: clean (nothing to replay), no_entries, missing_start, oversize (an entry or a page reaches beyond the hive
    and its log together, so nothing is replayed) or replayed.  ``entries`` has (hive, log, position, log_size,
    sequence, hbins_size), ``pages`` (hive, log, position, page, offset, length).
    """
    return _replayed(hives, entries, pages)[0]


def replayed_ranges(hives: DataFrame, entries: DataFrame, pages: DataFrame, bin_size: int = BIN) -> DataFrame:
    """(hive, start, end, sequence, page, skip): who wrote each byte of the replayed hives last.

    ``skip`` is where in the page the range begins.  Later sequences and later pages of one win, of pages
    of one number the one at the larger offset.  Writes meet within
    bins of the axis only, after equal ranges were reduced to their last writer, so a range that is written again
    and again costs one row.
    """
    report, written = _replayed(hives, entries, pages, cut)
    wins = F.struct("sequence", "page")
    done = written.where("length > 0").join(report.where("status = 'replayed'").select("hive"), "hive", "left_semi")
    bounds = done.select("hive", (F.col("offset") + BASE).alias("from"), (F.col("offset") + F.col("length") + BASE).alias("to"), "sequence", "page")
    # Writes are dealt by bin once; all that follows up to the ranges of a bin stays where its writes lie.
    bins = F.explode(F.sequence(F.floor(F.col("from") / bin_size), F.floor((F.col("to") - 1) / bin_size)))
    writes = bounds.withColumn("bin", bins).repartition("hive", "bin").groupBy("hive", "bin", "from", "to").agg(F.max(wins).alias("w"))
    dealt = cut(writes.withColumn("a", F.greatest("from", F.col("bin") * bin_size)).withColumn("z", F.least("to", (F.col("bin") + 1) * bin_size)))
    edges = dealt.select("hive", "bin", F.explode(F.array("a", "z")).alias("start")).distinct()
    pieces = edges.withColumn("end", F.lead("start").over(Window.partitionBy("hive", "bin").orderBy("start"))).where("end is not null")
    met = pieces.join(dealt, ["hive", "bin"]).where("a <= start and z >= end")
    last = met.groupBy("hive", "bin", "start", "end").agg(F.max(F.struct("w", "from")).alias("l")).select("hive", "start", "end", "l.w.sequence", "l.w.page", "l.from")
    before = Ordered(last, ["hive"], ["start"]).carry(b=("near", F.struct("end", "sequence", "page", "from")))
    same = (F.col("b.end") == F.col("start")) & (F.col("b.sequence") == F.col("sequence")) & (F.col("b.page") == F.col("page")) & (F.col("b.from") == F.col("from"))
    begun = before.add(new=(~F.coalesce(same, F.lit(False))).cast("long")).carry(runs=("sum", F.col("new"))).rows()
    run = F.coalesce("runs", F.lit(0)) + F.col("new")
    return begun.groupBy("hive", run.alias("run"), "sequence", "page", "from").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("hive", "start", "end", "sequence", "page", (F.col("start") - F.col("from")).alias("skip"))


def layered_blocks(layers: DataFrame, by: list[str]) -> DataFrame:
    """(by, block, layer, base, mask): where the 32 sub-blocks of each block that a layer describes are read.

    ``layers`` (by, layer, block, relative, target, forwarder, overlay, bitmap) has a row a described block, layer 0
    the newest.  A plain row answers the whole block at ``target``; an overlay the sub-blocks set in its bitmap, and
    deeper layers the others.  A forwarder takes what the next layer holds under ``relative``: that row answers as it
    would itself, what its bitmap leaves open goes on two layers below; without one, or if it forwards as well, the
    live volume answers, as it does for what no layer has (layer null, base the block).  Bit i of ``mask`` stands for
    the sub-block at base + i * 512.  A block has as many rows as layers, which is what meets in one place.
    """
    d2 = layers.select(*by, (F.col("layer") - 1).alias("layer"), F.col("block").alias("relative"), F.struct(F.col("target"), F.col("forwarder"), F.col("overlay"), F.col("bitmap")).alias("d"))
    found = layers.join(d2, [*by, "layer", "relative"], "left")
    hop, lost = F.col("forwarder"), F.col("d").isNull() | F.col("d.forwarder")
    live = hop & lost
    base = F.when(live, F.col("block")).when(hop, F.col("d.target")).otherwise(F.col("target"))
    bits = F.when(live, ALL).when(hop, F.when(F.col("d.overlay"), F.col("d.bitmap")).otherwise(ALL)).otherwise(F.when(F.col("overlay"), F.col("bitmap")).otherwise(ALL))
    row = F.struct(F.col("layer"), F.when(~live, F.when(hop, F.col("layer") + 1).otherwise(F.col("layer"))).cast("int").alias("of"), base.cast("long").alias("base"), bits.cast("long").bitwiseAND(F.lit(ALL)).alias("bits"), hop.alias("hop"))
    stacked = found.groupBy(*by, "block").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    pick = "struct<layer:int,base:bigint,mask:bigint>"
    zero = F.struct(F.lit(0).cast("long").alias("done"), F.lit(-1).alias("jump"), F.lit(0).cast("long").alias("over"), F.array().cast(f"array<{pick}>").alias("picks"))
    flipped = lambda mask: F.lit(ALL).bitwiseAND(F.bitwise_not(mask))

    def step(s, r):
        # Bits that a forwarder left open pass over the layer it looked into.
        asked = flipped(s["done"]).bitwiseAND(F.when(r["layer"] == s["jump"], flipped(s["over"])).otherwise(F.lit(ALL)))
        said = asked.bitwiseAND(r["bits"])
        picked = F.struct(r["of"].alias("layer"), r["base"].alias("base"), said.alias("mask"))
        return F.struct(
            s["done"].bitwiseOR(said).alias("done"), F.when(r["hop"], r["layer"] + 1).otherwise(-1).alias("jump"),
            F.when(r["hop"], asked.bitwiseAND(flipped(said))).otherwise(F.lit(0).cast("long")).alias("over"), F.when(said != 0, F.concat(s["picks"], F.array(picked))).otherwise(s["picks"]).alias("picks"),
        )

    folded = stacked.withColumn("s", F.aggregate("rows", zero, step))
    rest = flipped(F.col("s.done"))
    picks = F.when(rest != 0, F.concat("s.picks", F.array(F.struct(F.lit(None).cast("int").alias("layer"), F.col("block").cast("long").alias("base"), rest.alias("mask"))))).otherwise(F.col("s.picks"))
    told = folded.select(*by, "block", F.explode(picks).alias("p")).groupBy(*by, "block", "p.layer", "p.base").agg(F.bit_or("p.mask").alias("mask"))
    return told.select(*by, "block", "layer", "base", "mask")
