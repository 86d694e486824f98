"""Conversation prefix trie: which openings conversations share, and what sharing them saves.

A turn is known by a digest of its role and text, so texts are read once and never exchanged.
Conversations of equal turns become one path with their number.  Paths are hash-partitioned by the
digest of their first turn, and each partition builds pointer dictionary tries inside
``applyInPandas``, folded by an iterative postorder walk.  A first turn whose paths hold more turns
than one task should is not built there: its paths are partitioned again by the turns after it, until
every part is small.  The few nodes above the parts are counted by Spark and summed last.

A node is named by its smallest member and its depth, which tell it from every other node.
"""

from __future__ import annotations

import hashlib
from functools import partial, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, cut, parallelism

#: Turns that one part may hold whatever the cluster, and that make a part too small to divide.
MOST, LEAST = 500_000, 1024
#: Ids that are joined to one text before the texts of a node meet.
CHUNK = 4096
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NAMES = [*(x.split(" ")[0] for x in NODES.split(", ")), "top"]
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, digests and chars (code points of the text) of its turns in order.

    Turns go by ``turn``, null first; of equal numbers by role, by the first 32 code points of the text, by
    digest.  Equal rows are turns of their own.  Null roles and texts are empty; rows without a conv_id belong
    to no conversation.  A conversation is one row of 20 bytes a turn.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turn = F.struct(F.col("turn"), role.alias("role"), F.substring(text, 1, 32).alias("lead"), digest.alias("digest"), F.length(text).alias("chars"))
    gathered = conversations.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return gathered.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.chars").alias("chars"))


def share_heads(seqs: DataFrame, block: int = 100, modulus: int = 6) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of conversation c - c % ``block``,
    where h = crc32(c) % ``modulus``; fewer where that one has fewer, none where it is absent.

    The remainder is SQL's, which has the sign of c, so c - c % ``block`` lies between c and 0."""
    heads = seqs.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("_base"), F.slice("digests", 1, modulus - 1).alias("_d"), F.slice("chars", 1, modulus - 1).alias("_c"))
    h = (F.crc32(F.col("conv_id").cast("string")) % modulus).cast("int").alias("_h")
    based = seqs.select("*", h, (F.col("conv_id") - F.col("conv_id") % block).alias("_base")).join(heads, "_base", "left")

    def joined(head: str, own: str):
        first = F.when(F.col(head).isNotNull() & (F.col("_h") > 0), F.slice(F.col(head), F.lit(1), F.col("_h"))).otherwise(F.slice(F.col(own), 1, 0))
        return F.concat(first, F.slice(F.col(own), F.col("_h") + 1, F.size(own))).alias(own)

    return based.select("conv_id", joined("_d", "digests"), joined("_c", "chars"))


def _members(batches):
    """(key, conv_id) in order to texts of up to ``CHUNK`` ids of one key."""
    schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
    key, held = None, []
    for batch in batches:
        out = []
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (k != key or len(held) == CHUNK):
                out.append((key, held[0], len(held), ",".join(map(str, held))))
                held = []
            key = k
            held.append(c)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((key, held[0], len(held), ",".join(map(str, held))), schema.types, strict=True)], schema=schema)


def _digested(batches):
    """Texts of ids in the order of (key, first) to one digest a key, of all its ids with commas between."""
    schema = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
    key = None
    smallest = n = 0
    digest = hashlib.sha256()

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)

    for batch in batches:
        out = []
        for k, first, count, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if k != key:
                if key is not None:
                    out.append((smallest, n, digest.hexdigest()))
                key, smallest, n, digest = k, first, 0, hashlib.sha256()
            else:
                digest.update(b",")
            n += count
            digest.update(ids.encode())
        if out:
            yield batch_of(out)
    if key is not None:
        yield batch_of([(smallest, n, digest.hexdigest())])


def paths_of(seqs: DataFrame) -> DataFrame:
    """One row for all conversations of equal turns: conv_id (the smallest), n, ends (digest of their ids), digests, chars.

    Ids meet in ranges of (path, id), so a path that very many conversations share is spread, and reach the task
    that digests them, which has to see them in order, as texts of ``CHUNK`` ids each, a batch at a time.
    """
    key = F.unhex(F.substring(F.sha2(F.array_join(F.transform("digests", F.hex), ""), 256), 1, 32))
    seqs = cut(seqs)
    ranged = seqs.select(key.alias("key"), "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    texts = ranged.mapInArrow(_members, "key binary, first long, n long, ids string")
    ends = texts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digested, "conv_id long, n long, ends string")
    return cut(ends.join(seqs, "conv_id"))


class Trie:
    """Pointer dictionary tries of one partition, one top a (parent, first turn) pair."""

    def __init__(self):
        self.kids: list[dict] = []
        self.conv, self.depth, self.parent, self.n, self.chars, self.ends, self.top = [], [], [], [], [], [], []
        self.tops: dict = {}

    def node(self, conv: int, depth: int, parent: int, chars: int, top: bool) -> int:
        for column, value in zip((self.kids, self.conv, self.depth, self.parent, self.n, self.chars, self.ends, self.top), ({}, conv, depth, parent, 0, chars, None, top), strict=True):
            column.append(value)
        return len(self.kids) - 1

    def add(self, conv: int, n: int, ends: str, digests, chars, at: int, above: int) -> None:
        """Adds a path that begins below depth ``at`` of a node named ``above``; smaller ids come first."""
        first = (above, at, digests[at])
        v = self.tops.get(first)
        if v is None:
            v = self.tops[first] = self.node(conv, at + 1, above, int(chars[at]), True)
        self.n[v] += n
        for i in range(at + 1, len(digests)):
            kids, d = self.kids[v], digests[i]
            w = kids.get(d)
            if w is None:
                w = kids[d] = self.node(conv, i + 1, self.conv[v], int(chars[i]), False)
            self.n[w] += n
            v = w
        self.ends[v] = ends

    def folded(self) -> pd.DataFrame:
        """All nodes with the leaves and savings of their subtrees."""
        order, waiting = [], list(self.tops.values())
        while waiting:
            v = waiting.pop()
            order.append(v)
            waiting.extend(self.kids[v].values())
        leaves, saved = [0] * len(self.kids), [0] * len(self.kids)
        for v in reversed(order):
            below = self.kids[v].values()
            leaves[v] = sum(leaves[w] for w in below) if below else 1
            saved[v] = sum(saved[w] for w in below) + (self.n[v] - 1) * self.chars[v]
        columns = (self.conv, self.depth, self.parent, self.n, [len(k) for k in self.kids], leaves, saved, [e or _NO_ENDS for e in self.ends], self.top)
        return pd.DataFrame(dict(zip(_NAMES, columns, strict=True)))


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    trie = Trie()
    for row in rows.sort_values("conv_id").itertuples(index=False):
        trie.add(row.conv_id, row.n, row.ends, row.digests, row.chars, row.at, row.above)
    return trie.folded()


def _prefixes(batches, width: int):
    """The next ``width`` openings of each path, known by a chained digest, with the turns that stand from each on."""
    schema = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("i", pa.int32()), ("key", pa.binary()), ("turns", pa.int64()), ("chars", pa.int64())])
    for batch in batches:
        out = []
        for conv, n, digests, chars, at, above in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            chain = hashlib.sha256(f"{above}:{at}".encode())
            for i in range(at, min(at + width, len(digests))):
                chain.update(digests[i])
                out.append((conv, n, i - at, chain.digest()[:16], len(digests) - i, chars[i]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


_PATH = ("conv_id", "n", "ends", "digests", "chars", "at", "above", "first")


def _divided(active: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Paths in parts (above, at, next turn) of at most ``limit`` turns; the nodes above the parts; the ends on those nodes.

    A round looks one turn ahead, the next one two, then four, so that a long opening shared by many takes few rounds.
    A part is too large where more than ``limit`` turns stand from its next turn on.
    """
    small, nodes, ended, width = [], [], [], 1
    while True:
        ahead = active.select("conv_id", "n", "digests", "chars", "at", "above").mapInArrow(partial(_prefixes, width=width), "conv_id long, n long, i int, key binary, turns long, chars long")
        large = ahead.groupBy("key").agg(F.sum("turns").alias("turns"), F.sum("n").alias("all"), F.min("conv_id").alias("top"), F.min("chars").alias("last"))
        large = cut(large.where(F.col("turns") > limit).drop("turns"))
        if large.isEmpty():
            small.append(active)
            break
        inside = cut(ahead.select("conv_id", "i", "key").join(beside(large), "key").drop("key"))
        deepest = inside.groupBy("conv_id").agg((F.max("i") + 1).alias("k"), F.max_by("top", "i").alias("_top"))
        went = active.join(deepest, "conv_id", "left").withColumn("first", F.coalesce("first", "_top"))
        went = cut(went.withColumn("above", F.coalesce("_top", "above")).withColumn("at", F.col("at") + F.coalesce("k", F.lit(0))))
        over = F.lag("top").over(Window.partitionBy("conv_id").orderBy("i"))
        named = inside.withColumn("over", over).where(F.col("conv_id") == F.col("top"))
        from_ = active.select("conv_id", F.col("at").alias("_at"), F.col("above").alias("_above"), "first")
        named = named.join(from_, "conv_id")
        nodes.append(cut(named.select(F.coalesce("first", "top").alias("first"), "conv_id", (F.col("_at") + F.col("i") + 1).cast("long").alias("depth"), F.coalesce("over", "_above").alias("parent"), "all", "last")))
        ended.append(went.where((F.size("digests") == F.col("at")) & F.col("k").isNotNull()).select(F.col("above").alias("conv_id"), F.col("at").cast("long").alias("depth"), "ends"))
        on = went.where(F.size("digests") > F.col("at"))
        small.append(on.where(F.coalesce("k", F.lit(0)) < width).select(*_PATH))
        active = on.where(F.col("k") == width).select(*_PATH)
        width *= 2
    return reduce(DataFrame.unionByName, small), nodes, ended


def _folded_upper(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of the nodes of one first turn that stand above the parts; kids, leaves and saved come with what the parts below add."""
    rows = rows.sort_values(["depth", "conv_id"]).reset_index(drop=True)
    at = {key: i for i, key in enumerate(zip(rows["conv_id"], rows["depth"], strict=True))}
    kids, leaves, saved = rows["kids"].tolist(), rows["leaves"].tolist(), rows["saved"].tolist()
    own = ((rows["all"] - 1) * rows["last"]).tolist()
    for i in range(len(rows) - 1, -1, -1):
        saved[i] += own[i]
        leaves[i] = leaves[i] if kids[i] else 1
        above = at.get((rows["parent"][i], rows["depth"][i] - 1))
        if above is not None:
            kids[above] += 1
            leaves[above] += leaves[i]
            saved[above] += saved[i]
    columns = (rows["conv_id"], rows["depth"], rows["parent"], rows["all"], kids, leaves, saved, rows["ends"].fillna(_NO_ENDS), rows["depth"] == 1)
    return pd.DataFrame(dict(zip(_NAMES, columns, strict=True)))


def prefix_trie(seqs: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per node, the textless root included: ``NODES``.

    ``seqs`` has a distinct conv_id and digests and chars of its turns, as ``sequences`` gives them.  A node's
    members are the conversations that begin with its turns; conv_id is the smallest, parent_conv_id that of
    the parent (null for the root), n_leaves counts the childless nodes of its subtree, saved_tokens sums
    (n_convs - 1) times the code points of the last text over it, and ends_sha256 is the SHA-256 of the ids of
    members with no more turns, ascending and joined by commas.  A conversation without turns is a member of
    the root alone; no conversations give no nodes.

    Parts of more than ``limit`` turns are divided; unset, it is twice a task's even share, within ``LEAST``
    and ``MOST``.  It changes where nodes are made, never which.  Nodes above the parts number at most turns
    times depth over ``limit``, and those of one first turn are summed in one task.
    """
    spark, tasks = seqs.sparkSession, parallelism(seqs.sparkSession)
    paths = paths_of(seqs)
    turns, n, smallest = paths.agg(F.sum(F.size("digests")), F.sum("n"), F.min("conv_id")).first()
    if n is None:
        return spark.createDataFrame([], NODES)
    limit = limit or min(MOST, max(LEAST, 2 * turns // tasks))
    start = paths.where(F.size("digests") > 0).select("*", F.lit(0).alias("at"), F.lit(smallest).cast("long").alias("above"), F.lit(None).cast("long").alias("first"))
    light, upper, ended = _divided(start, limit)
    buckets = max(tasks, -(-turns // 100_000))
    dealt = light.withColumn("bucket", F.pmod(F.xxhash64("above", "at", F.col("digests")[F.col("at")]), F.lit(buckets)))
    nodes = cut(dealt.groupBy("bucket").applyInPandas(_built, NODES + ", top boolean"))
    if upper:
        below = nodes.where("top").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
        below = below.agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        of = reduce(DataFrame.unionByName, upper).join(below, ["conv_id", "depth"], "left").join(reduce(DataFrame.unionByName, ended), ["conv_id", "depth"], "left")
        nodes = nodes.unionByName(cut(of.fillna(0, ["kids", "leaves", "saved"]).groupBy("first").applyInPandas(_folded_upper, NODES + ", top boolean")))
    empty = paths.where(F.size("digests") == 0).select(*(F.lit(None).cast("long").alias(c) for c in ("kids", "leaves", "saved")), "ends")
    tops = nodes.where("top and depth = 1").select(F.lit(1).cast("long").alias("kids"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(None).cast("string").alias("ends"))
    root = tops.unionByName(empty).agg(F.count("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"))
    values = (F.lit(smallest), F.lit(0), F.lit(None), F.lit(n), F.col("kids"), F.coalesce("leaves", F.lit(1)), F.coalesce("saved", F.lit(0)), F.coalesce("ends", F.lit(_NO_ENDS)))
    root = root.select(*(v.cast("string" if name == "ends_sha256" else "long").alias(name) for v, name in zip(values, _NAMES, strict=False)))
    return nodes.drop("top").unionByName(root)



ORACLE = """
WITH own AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
             lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), turns AS (
  SELECT c.conv_id, o.i AS place, sha256(length(role) || ':' || role || text) AS digest, length(text) AS chars
  FROM convs c JOIN own o ON o.conv_id = c.base AND o.i <= c.h
  UNION ALL
  SELECT c.conv_id, o.i, sha256(length(role) || ':' || role || text), length(text) FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.i > c.h
), seqs AS (
  SELECT c.conv_id, coalesce(list(t.digest ORDER BY t.place) FILTER (t.digest IS NOT NULL), []) AS seq, coalesce(list(t.chars ORDER BY t.place) FILTER (t.digest IS NOT NULL), []) AS chars
  FROM convs c LEFT JOIN turns t USING (conv_id) GROUP BY 1
), members AS (
  SELECT conv_id, d, array_to_string(seq[1:d], '') AS path, len(seq) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE chars[d] END AS chars
  FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM seqs)
), nodes AS (
  SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY path
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = substr(n.path, 1, 64 * (n.depth - 1))
  LEFT JOIN (SELECT substr(path, 1, 64 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1) k ON k.path = n.path
), subtrees AS (
  SELECT top, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM (SELECT *, unnest(list_transform(range(depth + 1), lambda k: substr(path, 1, 64 * k))) AS top FROM linked) GROUP BY top
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM linked JOIN subtrees ON top = path
"""
