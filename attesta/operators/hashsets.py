"""Hash sets over their life: import of many at once, import again in place of the old, removal.

A set is (id, name, kind, source, imported_at, examiner, entries), known by its name; an entry is
(set_id, algo, digest, label).  Sets are a row a list; entries may be of any number and only join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import KINDS

SET = ("id", "name", "kind", "source", "imported_at", "examiner", "entries")


def judged(sets: DataFrame, digests: DataFrame) -> DataFrame:
    """``sets`` (name, kind, source, imported_at, examiner) with ``entries`` and ``refused``: null, ``kind``, ``empty``, ``name`` or ``replaced``.

    ``digests`` (name, source, algo, digest, label) are counted a list.  Of lists of one name the
    latest that can be taken stays, of equal times that of the larger source; the others are ``replaced``.
    """
    counts = digests.where("digest != ''").groupBy("name", "source").agg(F.count("*").alias("entries"))
    s, c = sets.select("name", "kind", "source", "imported_at", "examiner").alias("s"), counts.alias("c")
    listed = s.join(c, (F.col("s.name") == F.col("c.name")) & F.col("s.source").eqNullSafe(F.col("c.source")), "left").select("s.*", F.coalesce("c.entries", F.lit(0)).alias("entries"))
    wrong = F.when(F.coalesce(F.col("name"), F.lit("")) == "", "name").when(F.coalesce(~F.col("kind").isin(*KINDS), F.lit(True)), "kind").when(F.col("entries") == 0, "empty")
    newest = Window.partitionBy("name", wrong.isNull()).orderBy(F.desc_nulls_last("imported_at"), F.desc_nulls_last("source"), "kind", F.asc_nulls_last("examiner"))
    return listed.withColumn("refused", wrong).withColumn("_n", F.row_number().over(newest)).withColumn("refused", F.when(F.col("refused").isNull() & (F.col("_n") > 1), "replaced").otherwise(F.col("refused"))).drop("_n")


def imported(hash_sets: DataFrame, hash_entries: DataFrame, sets: DataFrame, digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All sets and all entries after an import.

    A set of a known name keeps its id and examiner and takes the new kind, source and time; all its
    old entries go.  A new one takes the next id in order of names.  Lists of an unknown kind, without
    a name or without digests are refused (``judged``) and change nothing.  Digests are kept in small
    letters, repeated ones each.  Other columns are left out.
    """
    good = judged(sets, digests).where("refused is null").drop("refused")
    known = hash_sets.select(F.col("id").alias("_id"), "name", F.col("examiner").alias("_examiner"))
    met = good.join(known, "name", "left")
    top = F.coalesce(hash_sets.agg(F.max("id")).scalar(), F.lit(0))
    # One row a new list of this import.
    fresh = met.where("_id is null").withColumn("id", top + F.row_number().over(Window.orderBy("name")))
    again = met.where("_id is not null").withColumn("id", F.col("_id")).withColumn("examiner", F.col("_examiner"))
    taken = again.select(*SET).unionByName(fresh.select(*SET))
    kept = hash_sets.select(*SET).join(taken.select("id"), "id", "left_anti").unionByName(taken)
    lists = taken.select(F.col("id").alias("set_id"), "name", "source")
    new = digests.where("digest != ''").alias("d").join(lists.alias("l"), (F.col("d.name") == F.col("l.name")) & F.col("d.source").eqNullSafe(F.col("l.source"))).select("set_id", "algo", F.lower("digest").alias("digest"), "label")
    entries = hash_entries.select("set_id", "algo", "digest", "label").join(lists.select("set_id"), "set_id", "left_anti").unionByName(new)
    return kept, entries


def removed(hash_sets: DataFrame, hash_entries: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All sets and all entries without the sets named in ``names`` (name); unknown names change nothing."""
    gone = hash_sets.join(names.select("name"), "name", "left_semi").select(F.col("id").alias("set_id"))
    return hash_sets.join(gone, hash_sets["id"] == gone["set_id"], "left_anti"), hash_entries.join(gone, "set_id", "left_anti")
