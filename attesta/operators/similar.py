"""Similar files by fuzzy signatures: classes of equal signatures, links between classes, counts for files.

Two signatures score above 0 where they are equal, or where they have a run of seven characters in common
at one block size.  Equal ones are one class, so copies cost a row each and no pairs.  Classes meet on the
runs (grams) they share; a gram that many classes have is dealt over tasks in pairs of chunks, and a pair of
classes counts at the first of its common grams only.  What meets is compared where it meets, in arrays of pairs:
most meetings go as the characters before the gram are equal too, counts of characters bound the score of the
rest, and those that may reach the threshold are scored by the whole signatures.  ``summary`` adds links up where
they are found, so pairs are neither exchanged nor written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import LENGTH, MIN_BLOCK, WINDOW, compare, score_of
from .scratch import cut

#: Classes of one gram that meet in one piece of work.  A class goes to as many pieces as its gram has chunks, so what is
#: exchanged for a hot gram falls with this; a piece holds two chunks of about 0.2 KB a class, and their counts.
CHUNK = 2048
#: Shared grams up to which they come to the rows of all grams, two numbers each; with more, both are exchanged.
FEW = 2_000_000
#: Meetings that are held as arrays at once.
TOGETHER = 1 << 18
#: Numbers of a character that its counts are told apart by; what exceeds them is counted in one sum.
_LEVELS = 4


def classes_of(hashes: DataFrame) -> DataFrame:
    """(signature, class, members): files of equal signatures, runs of a character shortened to three; the
    class is named by its least node.  Signatures that are null or not of three parts have none."""
    return _signed(hashes).groupBy("signature").agg(F.min("node").alias("class"), F.count("*").alias("members"))


def _signed(hashes: DataFrame) -> DataFrame:
    s = F.split("fuzzy", ":", 3)
    block = F.get(s, F.lit(0)).try_cast("long")
    parts = [F.regexp_replace(F.get(s, F.lit(i)), r"(.)\1{3,}", "$1$1$1") for i in (1, 2)]
    return hashes.withColumn("signature", F.concat(block.cast("string"), F.lit(":"), parts[0], F.lit(":"), parts[1])).where("signature is not null")


def _parts(classes: DataFrame, *more: str, before: bool = False) -> DataFrame:
    """(class, signature, block, gram, and the columns ``more``): a row for each distinct gram of both parts of a class; the
    block tells the part.  ``before`` adds the number of the character before the gram, where it stands first, and -1 at the start."""
    s = F.split("signature", ":", 3)
    block = s[0].cast("long")
    each = F.explode(F.array(F.struct(block.alias("block"), s[1].alias("part")), F.struct((block * 2).alias("block"), s[2].alias("part"))))
    parts = classes.select("class", "signature", *more, each.alias("r")).select("class", "signature", *more, "r.*").where(F.length("part") >= WINDOW)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("part") - (WINDOW - 1)), lambda i: F.substring("part", i, F.lit(WINDOW))))
    rows = parts.select("class", "signature", *more, "block", "part", F.explode(grams).alias("gram"))
    place = F.expr("locate(gram, part)")
    added = [F.when(place > 1, F.ascii(F.substring("part", place - 1, F.lit(1)))).otherwise(-1).alias("before")] if before else []
    return rows.select("class", "signature", *more, "block", "gram", *added)


def _part(signature: str, block: int) -> str:
    own, first, second = signature.split(":", 2)
    return first if int(own) == block else second


def _most_distance(threshold: int) -> int:
    return max((d for d in range(LENGTH + 1) if 100 - 100 * d // LENGTH >= threshold), default=-1)


class _Held:
    """The signatures of some rows as arrays: row r's first part is text r, its second part text n + r."""

    def __init__(self, signatures: list[str]):
        split = [s.split(":", 2) for s in signatures]
        self.n, self.own = len(split), [int(x[0]) for x in split]
        self.texts = [x[1] for x in split] + [x[2] for x in split]
        self.size = np.array([len(t) for t in self.texts], dtype=np.int64)
        short = np.array([t[:LENGTH] for t in self.texts], dtype=f"U{LENGTH}")
        codes = np.ascontiguousarray(short).view(np.uint32).reshape(2 * self.n, LENGTH)
        inside = np.arange(LENGTH) < self.size[:, None]
        odd = (self.size > LENGTH) | (inside & ((codes < 32) | (codes > 126))).any(axis=1)
        #: Texts that are longer than a signature is or have other characters are compared one by one.
        self.odd = odd[: self.n] | odd[self.n :]
        self.codes = (codes & 127).astype(np.uint8)
        #: For each text and character the places where it stands, as bits.
        self.places = np.zeros((2 * self.n, 128), dtype=np.uint64)
        for t in range(LENGTH):
            there = np.flatnonzero(inside[:, t])
            self.places[there, self.codes[there, t]] |= np.uint64(1 << t)
        counts = np.bitwise_count(self.places)
        self.levels = [np.packbits(counts > level, axis=1).view(np.uint64) for level in range(_LEVELS)]
        self.beyond = np.maximum(counts.astype(np.int16) - _LEVELS, 0).sum(axis=1)

    def most_common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Characters that pairs of texts have in common, whatever their order, or more."""
        out = np.minimum(self.beyond[a], self.beyond[b]).astype(np.int64)
        for level in self.levels:
            out += np.bitwise_count(level[a] & level[b]).sum(axis=1, dtype=np.int64)
        return out

    def met(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length of the longest common subsequence, the places in ``a`` as bits where common grams end) of pairs of texts."""
        whole = np.full(len(a), 2**64 - 1, dtype=np.uint64)
        free, ends, one = whole.copy(), np.zeros(len(a), np.uint64), np.uint64(1)
        runs = [ends.copy() for _ in range(WINDOW - 1)]
        places, row, size, codes = self.places.reshape(-1), a * 128, self.size[b], self.codes[b]
        for t in range(int(size.max(initial=0))):
            here = places[row + codes[:, t]]
            here[size <= t] = 0
            both = free & here
            free = (free + both) | (free - both)
            for k in range(WINDOW - 1, 0, -1):
                grown = (runs[k - 1] << one) & here
                if k == WINDOW - 1:
                    ends |= grown
                else:
                    runs[k] = grown
            runs[0] = here
        return np.bitwise_count(~free).astype(np.int64), ends

    def scores(self, a: np.ndarray, b: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``fuzzy.score_of`` of pairs of texts, and where their common grams end; ``factor`` is the block over the least block."""
        common, ends = self.met(a, b)
        both = np.maximum(self.size[a] + self.size[b], 1)
        score = 100 - 100 * ((both - 2 * common) * LENGTH // both) // LENGTH
        return np.where(ends > 0, np.minimum(score, factor * np.minimum(self.size[a], self.size[b])), 0), ends


def _factor(block: int) -> int:
    """The block over the least block, as far as it bounds a score."""
    return max(-1, min(101, block // MIN_BLOCK))


def _meetings(edges: list[int], side: np.ndarray):
    """(a, b) of the rows that meet, some at a time: within a gram, of side 2 each with those after it, of side 0 with those of side 1."""
    n = len(side)
    group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    end = np.array(edges[1:])[group]
    zeros = np.bincount(group, weights=side == 0, minlength=len(edges) - 1).astype(np.int64)
    low = np.where(side == 0, np.array(edges[:-1])[group] + zeros[group], np.arange(n) + 1)
    count = np.where(side == 1, 0, end - low)
    done = np.cumsum(count)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + TOGETHER, side="right")))
        some = count[at:to]
        a = np.repeat(np.arange(at, to), some)
        if len(a):
            yield a, np.arange(len(a)) - np.repeat(np.cumsum(some) - some, some) + low[a]
        at = to


def _found(rows: pa.Table, threshold: int):
    """(rows, a, b, score), some links at a time: pairs of numbers of the sorted ``rows`` whose signatures score ``threshold``
    or more.  Each pair is found at one gram of one part: the first part if that scores as much, and there the common gram
    that comes first in the lesser class."""
    rows = rows.sort_by([("block", "ascending"), ("gram", "ascending"), ("side", "ascending")])
    block, gram, signature = (rows.column(c).to_pylist() for c in ("block", "gram", "signature"))
    edges = [i for i in range(len(gram)) if i == 0 or (block[i], gram[i]) != (block[i - 1], gram[i - 1])] + [len(gram)]
    if len(gram) < 2:
        return
    names = rows.column("class").combine_chunks().dictionary_encode()
    order = np.empty(len(names.dictionary), dtype=np.int64)
    order[np.argsort(np.array(names.dictionary.to_pylist(), dtype=object))] = np.arange(len(order))
    rank = order[names.indices.to_numpy()]
    held, most = _Held(signature), _most_distance(threshold)
    own = np.array([x == y for x, y in zip(held.own, block, strict=True)])
    text = np.where(own, 0, held.n) + np.arange(held.n)
    texts = [held.texts[i] for i in text.tolist()]
    place = [p.find(g) for p, g in zip(texts, gram, strict=True)]
    before = np.array([ord(p[i - 1]) if i > 0 else -1 for p, i in zip(texts, place, strict=True)])
    place = np.array(place)
    factor, doubled = np.array([_factor(x) for x in block]), np.array([_factor(x * 2) for x in block])
    halved = np.array([_factor(x) for x in held.own])
    for a, b in _meetings(edges, rows.column("side").to_numpy()):
        # With the same character before the gram, the pair has another common gram that comes first.
        first = (before[a] != before[b]) | (before[a] < 0)
        a, b = a[first], b[first]
        a, b = np.where(rank[a] < rank[b], a, b), np.where(rank[a] < rank[b], b, a)
        odd = held.odd[a] | held.odd[b]
        yield rows, *_one_by_one(a[odd], b[odd], texts, signature, block, gram, held, own, threshold)
        a, b = a[~odd], b[~odd]
        both = held.size[text[a]] + held.size[text[b]]
        least = np.minimum(held.size[text[a]], held.size[text[b]])
        common = np.minimum(held.most_common(text[a], text[b]), both // 2)
        near = ((both - 2 * common) * LENGTH // both <= most) & (factor[a] * least >= threshold)
        a, b = a[near], b[near]
        score, ends = held.scores(text[a], text[b], factor[a])
        early = (np.uint64(1) << (place[a] + WINDOW - 1).astype(np.uint64)) - np.uint64(1)
        kept = (score >= threshold) & (ends & early == 0)
        a, b, score = a[kept], b[kept], score[kept]
        # Signatures of one block have two parts each that are compared.
        two = own[a] == own[b]
        other = np.where(own[a[two]], held.n, 0)
        second, _ = held.scores(other + a[two], other + b[two], np.where(own[a[two]], doubled[a[two]], halved[a[two]]))
        again = np.zeros(len(a), dtype=bool)
        again[two] = ~own[a[two]] & (second >= threshold)
        score[two] = np.maximum(score[two], second)
        yield rows, a[~again], b[~again], score[~again]


def _one_by_one(a, b, texts, signature, block, gram, held, own, threshold):
    """Links of pairs with a signature that is no plain one."""
    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        p, q = texts[i], texts[j]
        if score_of(p, q, block[i]) < threshold or next(g for k in range(len(p)) if (g := p[k : k + WINDOW]) in q) != gram[i]:
            continue
        if own[i] == own[j] and not own[i] and score_of(held.texts[i], held.texts[j], held.own[i]) >= threshold:
            continue
        out.append((i, j, compare(signature[i], signature[j])))
    return (np.array([x[k] for x in out], dtype=np.int64) for k in range(3))


def _links_in(rows: pa.Table, threshold: int) -> pa.Table:
    """(a, b, score) of the classes of some grams; of a gram in chunks, those of the first against those of the second."""
    kind = rows.schema.field("class").type
    found = [pa.table({"a": t["class"].take(pa.array(a)).cast(kind), "b": t["class"].take(pa.array(b)).cast(kind), "score": pa.array(s, pa.int32())}) for t, a, b, s in _found(rows, threshold)]
    return pa.concat_tables(found) if found else pa.table({"a": pa.array([], kind), "b": pa.array([], kind), "score": pa.array([], pa.int32())})


def _near_in(rows: pa.Table, threshold: int) -> pa.Table:
    """(class, near, best): links of the classes of some grams, as the files of the other classes and the best score."""
    kind, table = rows.schema.field("class").type, None
    near, best = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int32)
    for table, a, b, score in _found(rows, threshold):
        members = table["members"].to_numpy()
        for i, j in ((a, b), (b, a)):
            np.add.at(near, i, members[j])
            np.maximum.at(best, i, score.astype(np.int32))
    linked = np.flatnonzero(best)
    names = table["class"].take(pa.array(linked)).cast(kind) if len(linked) else pa.array([], kind)
    return pa.table({"class": names, "near": near[linked], "best": best[linked]})


def _dealt(classes: DataFrame, *more: str):
    """The rows of ``_parts`` at whose gram pairs may count, with ``side``, grouped into pieces of work."""
    keyed = _parts(classes, *more).withColumn("key", F.xxhash64("block", "gram"))
    # Where all have the same character before a gram, each pair has a common gram that comes before this one: no pair counts
    # here.  Grams of one key would be taken together, and that only makes more chunks or rows that meet nothing.
    told = _parts(classes, before=True).groupBy(F.xxhash64("block", "gram").alias("key")).agg(F.count("*").alias("n"), F.min("before").alias("least"), F.max("before").alias("most"))
    shared = cut(told.where("n > 1 and (least < 0 or least < most)").select("key", "n"))
    totals, grams = shared.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shared = F.broadcast(shared) if grams <= FEW else shared
    buckets = max(8, -(-totals // 20_000))
    many = F.ceil(F.col("n") / CHUNK).cast("int")
    columns = ("class", "signature", *more, "block", "gram")
    met = keyed.join(shared, "key").withColumn("k", many).withColumn("c", F.pmod(F.xxhash64("signature"), F.col("k")).cast("int"))
    # A chunk meets itself (side 2), those after it (as side 0) and those before it (as side 1).
    others = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o")
    rows = met.select("*", others).withColumn("side", F.when(F.col("o") == F.col("c"), 2).when(F.col("o") > F.col("c"), 0).otherwise(1))
    piece = F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).bitwiseOR(F.lit(-(2**63)))
    unit = F.when(F.col("k") == 1, F.pmod("key", F.lit(buckets))).otherwise(piece)
    return rows.select(*columns, "side", unit.alias("unit")).groupBy("unit", "block", F.when(F.col("unit") < 0, F.col("gram")).alias("_g"))


def class_links(classes: DataFrame, threshold: int = 60) -> DataFrame:
    """(a, b, score): classes whose signatures score ``threshold`` (above 0) or more, a < b, each pair once."""
    if threshold < 1:
        raise ValueError("the threshold is at least 1")
    kind = classes.schema["class"].dataType.simpleString()
    return _dealt(classes).applyInArrow(lambda rows: _links_in(rows, threshold), f"a {kind}, b {kind}, score int")


def class_counts(classes: DataFrame, threshold: int = 60) -> DataFrame:
    """(class, near, best) of classes with links: the members of the linked classes, and the best score."""
    if threshold < 1:
        raise ValueError("the threshold is at least 1")
    kind = classes.schema["class"].dataType.simpleString()
    found = _dealt(classes, "members").applyInArrow(lambda rows: _near_in(rows, threshold), f"class {kind}, near long, best int")
    return found.groupBy("class").agg(F.sum("near").alias("near"), F.max("best").alias("best"))


def summary(hashes: DataFrame, threshold: int = 60) -> DataFrame:
    """(node, class, members, n_links, best): for each file its class, how many files of other content score
    ``threshold`` or more against it, and the best of the scores against another class (null without one).

    Rows of one node count each.  Files of one SHA-256, unless it is null or empty, are the same content; a
    signature without a first part is like nothing, itself included.
    """
    signed = cut(_signed(hashes).select("node", "signature", F.when(F.col("sha256") != "", F.col("sha256")).alias("sha")))
    classes = cut(signed.groupBy("signature").agg(F.min("node").alias("class"), F.count("*").alias("members")))
    told = class_counts(classes, threshold)
    same = signed.where("sha is not null").groupBy("signature", "sha").agg(F.count("*").alias("same"))
    each = signed.join(classes, "signature").join(same, ["signature", "sha"], "left").join(told, "class", "left")
    inside = F.when(F.split("signature", ":", 3)[1] == "", 0).otherwise(F.col("members") - F.coalesce("same", F.lit(1)))
    return each.select("node", "class", "members", (F.coalesce("near", F.lit(0)) + inside).alias("n_links"), "best")


def similar_files(hashes: DataFrame, threshold: int = 60) -> DataFrame:
    """(a, b, score) of files with different content whose signatures score ``threshold`` or more.

    Writes every pair, for reports on few files; ``summary`` and ``class_links`` say the same of many.
    """
    signed = _signed(hashes).select("node", "signature", "sha256")
    classes = cut(classes_of(hashes))
    links = class_links(classes, threshold)
    same = classes.where(F.split("signature", ":", 3)[1] != "").select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(100).alias("score"))
    of = signed.join(classes, "signature")
    left, right = (of.select(F.col("class").alias(c), F.col("node").alias(f"n{c}"), F.col("sha256").alias(f"s{c}")) for c in "ab")
    both = links.unionByName(same).join(left, "a").join(right, "b")
    apart = F.coalesce(~((F.col("sa") == F.col("sb")) & (F.col("sa") != "")), F.lit(True))
    once = (F.col("a") != F.col("b")) | (F.col("na") < F.col("nb"))
    return both.where(once & apart).select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "score")
