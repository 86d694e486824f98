"""Hash sets imported again: a nation is a set, customers are its entries; suppliers and parts come as new lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hashsets
from .base import query, table

_KIND = "['known_bad','known_good','notable','other']"


def _kind(at):
    return F.element_at(F.array(*map(F.lit, ("known_bad", "known_good", "notable", "other"))), (at % 4 + 1).cast("int"))


@query(
    "hash_set_import",
    f"""WITH cur AS (SELECT n_nationkey AS id, n_name AS name, {_KIND}[n_regionkey % 3 + 1] AS kind, 'first' AS source, 'a' AS examiner FROM nation),
    ent AS (SELECT c_nationkey AS set_id, md5(c_name) AS digest FROM customer),
    sets AS (SELECT n_name AS name, {_KIND}[n_nationkey % 4 + 1] AS kind, 'again' AS source FROM nation WHERE n_regionkey < 3 UNION ALL SELECT p_brand, {_KIND}[min(p_size) % 4 + 1], 'parts' FROM part GROUP BY p_brand),
    dig AS (SELECT n_name AS name, 'again' AS source, md5(s_name) AS digest FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT p_brand, 'parts', md5(p_name) FROM part),
    cnt AS (SELECT name, source, count(*) AS entries FROM dig GROUP BY ALL),
    good AS (SELECT sets.*, entries FROM sets JOIN cnt USING (name, source) WHERE kind <> 'other'),
    old AS (SELECT cur.id, good.name, good.kind, good.source, cur.examiner FROM good JOIN cur USING (name)),
    new AS (SELECT (SELECT max(id) FROM cur) + row_number() OVER (ORDER BY name) AS id, name, kind, source, 'b' AS examiner FROM good ANTI JOIN cur USING (name)),
    taken AS (FROM old UNION ALL FROM new), allsets AS (FROM taken UNION ALL SELECT * FROM cur ANTI JOIN taken USING (id)),
    allent AS (SELECT id AS set_id, digest FROM taken JOIN dig USING (name, source) UNION ALL SELECT * FROM ent WHERE set_id NOT IN (SELECT id FROM taken))
    SELECT id, name, kind, source, examiner, count(digest) AS entries, min(digest) AS first_digest FROM allsets LEFT JOIN allent ON id = set_id GROUP BY ALL""",
)
def hash_set_import(spark, d):
    nation, part = table(spark, d, "nation"), table(spark, d, "part")
    customers = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("set_id"), F.lit("md5").alias("algo"), F.md5("c_name").alias("digest"), F.lit("").alias("label"))
    counted = customers.groupBy("set_id").agg(F.count("*").alias("entries"))
    key = F.col("n_nationkey").cast("long").alias("id")
    current = nation.select(key, F.col("n_name").alias("name"), _kind(F.col("n_regionkey") % 3).alias("kind"), F.lit("first").alias("source"), F.lit(1).alias("imported_at"), F.lit("a").alias("examiner"))
    current = current.join(counted, F.col("id") == F.col("set_id"), "left").drop("set_id").fillna(0, ["entries"])
    made = (F.lit(2).alias("imported_at"), F.lit("b").alias("examiner"))
    again = nation.where("n_regionkey < 3").select(F.col("n_name").alias("name"), _kind(F.col("n_nationkey")).alias("kind"), F.lit("again").alias("source"), *made)
    lists = again.unionByName(part.groupBy("p_brand").agg(F.min("p_size").alias("s")).select(F.col("p_brand").alias("name"), _kind(F.col("s")).alias("kind"), F.lit("parts").alias("source"), *made))
    entry = lambda name, source, of: (F.col(name).alias("name"), F.lit(source).alias("source"), F.lit("md5").alias("algo"), F.upper(F.md5(of)).alias("digest"), F.lit("").alias("label"))
    suppliers = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    digests = suppliers.select(*entry("n_name", "again", "s_name")).unionByName(part.select(*entry("p_brand", "parts", "p_name")))
    sets, entries = hashsets.imported(current, customers, lists, digests)
    first = entries.groupBy("set_id").agg(F.min("digest").alias("first_digest"))
    return sets.join(first, F.col("id") == F.col("set_id"), "left").select("id", "name", "kind", "source", "examiner", "entries", "first_digest")
