"""Recovery phrases in documents, with the most frequent words of the corpus as the list."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import mnemonics
from .base import contents, query


def common_words(spark, d):
    """The 2048 most frequent words of the documents in alphabetical order: a list is that long by its standard."""
    words = contents(spark, d).select(F.explode(F.regexp_extract_all(F.lower("body"), F.lit("([a-z]{3,8})"), F.lit(1))).alias("word"))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(mnemonics.WORDS)
    return top.select((F.row_number().over(Window.orderBy("word")) - 1).alias("place"), "word")


@query(
    "mnemonic_phrases",
    r"""WITH RECURSIVE tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '(?s)(.*?)([a-z]{3,8})', 1)) AS gap, unnest(regexp_extract_all(lower(text), '(?s)(.*?)([a-z]{3,8})', 2)) AS word,
      generate_subscripts(regexp_extract_all(lower(text), '(?s)(.*?)([a-z]{3,8})', 2), 1) AS k FROM documents WHERE text IS NOT NULL),
    top AS (SELECT word FROM tok GROUP BY word ORDER BY count(*) DESC, word LIMIT 2048),
    list AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS place FROM top),
    put AS (SELECT tok.*, place, CAST(sum(length(gap) + length(tok.word)) OVER (PARTITION BY doc_id ORDER BY k) - length(tok.word) AS BIGINT) AS start FROM tok LEFT JOIN list USING (word)),
    mark AS (SELECT *, lag(place) OVER o IS NULL OR NOT regexp_full_match(gap, '[\s\x0b\x{85}\p{Z},;.:)(\[\]|/*_-]{0,12}|[\s\x0b\x{85}\p{Z}\p{Nd}.,;:)(\[\]#-]{0,12}') AS fresh FROM put WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
    isl AS (SELECT *, sum(CASE WHEN fresh OR place IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM mark),
    runs AS (SELECT doc_id, run, list(place ORDER BY k) AS places, list(word ORDER BY k) AS words, list(start ORDER BY k) AS starts FROM isl WHERE place IS NOT NULL GROUP BY ALL HAVING count(*) >= 12),
    win AS (SELECT doc_id, run, i, n, list_reduce(list_transform(places[i:i + n - 1], lambda p: lpad(bin(p), 11, '0')), lambda a, b: a || b) AS bits
      FROM (SELECT *, unnest(range(1, len(places) - 10)) AS i FROM runs), (VALUES (12), (15), (18), (21), (24)) AS l(n) WHERE i + n - 1 <= len(places)),
    said AS (SELECT *, bits[1:n * 32 // 3] AS entropy, bits[n * 32 // 3 + 1:] AS tail FROM win),
    sums AS (SELECT doc_id, run, i, n, tail, sha256(unhex(array_to_string(list_transform(range(0, n * 8 // 3), lambda q: substr('0123456789abcdef', 1 + 8 * CAST(entropy[4 * q + 1] AS INT) + 4 * CAST(entropy[4 * q + 2] AS INT) + 2 * CAST(entropy[4 * q + 3] AS INT) + CAST(entropy[4 * q + 4] AS INT), 1)), ''))) AS digest FROM said),
    good AS (SELECT doc_id, run, i, max(n) AS n FROM sums WHERE tail = lpad(bin(CAST('0x' || digest[1:2] AS BIGINT)), 8, '0')[1:n // 3] GROUP BY ALL),
    hit AS (SELECT doc_id, run, min(i) AS i, arg_min(n, i) AS n FROM good GROUP BY ALL
      UNION ALL SELECT g.doc_id, g.run, min(g.i), arg_min(g.n, g.i) FROM hit h JOIN good g ON g.doc_id = h.doc_id AND g.run = h.run AND g.i >= h.i + h.n GROUP BY g.doc_id, g.run)
    SELECT doc_id, starts[i] AS "offset", CAST(n AS INT) AS n_words, 'valid' AS state, array_to_string(words[i:i + n - 1], ' ') AS phrase FROM hit JOIN runs USING (doc_id, run)
    UNION ALL SELECT doc_id, starts[1], CAST(len(words) AS INT), 'unchecked', array_to_string(words, ' ') FROM runs ANTI JOIN good USING (doc_id, run)""",
)
def mnemonic_phrases(spark, d):
    found = mnemonics.find_phrases(contents(spark, d), common_words(spark, d))
    return found.select(F.col("id").alias("doc_id"), "offset", "n_words", "state", "phrase")


@query("mnemonic_near")
def mnemonic_near(spark, d):
    found = mnemonics.find_phrases(contents(spark, d), common_words(spark, d), typos=1)
    return found.where("state = 'near'").select(F.col("id").alias("doc_id"), "offset", "n_words", "written", "phrase", "fits")
