"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact shingle similarity.

Windows as long as the benchmark items slide over each document, one word at a time, and get a SimHash
of their weighted shingles.  An index for each item length cuts fingerprints into blocks: two within
the radius differ by ``RADIUS // BLOCKS`` bits at most in some block, so probing each block's values
that near returns all items within the radius.  Those are verified by the weighted Jaccard similarity
of the shingles themselves: weights count repeats, and a shingle of many items weighs less.

The weight that a window shares with all items of its length together, over the window's own weight,
is no less than its similarity to any one of them: what an item has not weighs at least as much in the
pair as in the window.  So fingerprints are taken and searched where that bound reaches the similarity
only; nothing that could be similar lies elsewhere.

Shingles, their weights and the items' lengths are worked out by Spark over the whole benchmark.  Items
come to the tasks in blocks of at most ``ITEMS``, one after the other through the driver, which holds
one block at a time; every block is held against all documents and its finds are written before the next.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, utf8
from .licenses import _TO_SPACE

SHINGLE, SIMILARITY, RADIUS, BLOCKS, ITEMS = 5, 0.8, 20, 7, 20_000
WINDOWS, CANDIDATES = 4096, 1 << 20  # what a task holds at a time; results are the same at any value
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def word_codes(text: bytes, known: dict | None = None) -> np.ndarray:
    """A 64-bit code for each word: runs of letters and digits, A-Z as small letters."""
    known = {} if known is None else known
    found = text.translate(_TO_SPACE).split()
    for w in set(found).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))


def shingle_codes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code for each run of ``size`` words."""
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(size):
        out = (out * _MIX[0] + words[k : k + len(out)]) ^ (out >> np.uint64(29))
    out = (out ^ (out >> np.uint64(30))) * _MIX[1]
    out = (out ^ (out >> np.uint64(27))) * _MIX[2]
    return out ^ (out >> np.uint64(31))


def simhash(codes: np.ndarray, weights: np.ndarray) -> int:
    bits = np.unpackbits(codes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.T @ weights * 2 > weights.sum()).tobytes(), "big")


def window_simhashes(codes: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """SimHashes of all runs of ``size`` codes, from running sums of the weights by bit."""
    bits = np.unpackbits(codes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(codes) + 1, 64))
    np.cumsum(bits * weights[:, None], axis=0, out=sums[1:])
    whole = np.concatenate(([0.0], np.cumsum(weights)))
    over = (sums[size:] - sums[:-size]) * 2 > (whole[size:] - whole[:-size])[:, None]
    return np.packbits(over, axis=1).view(">u8").astype(np.uint64).ravel()


def weighted_jaccard(a: np.ndarray, b: np.ndarray, weight) -> float:
    """Sum of the smaller over sum of the larger weighted counts, over all shingles."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    low = sum(weight(s) * min(x[s], y[s]) for s in x if s in y)
    high = sum(weight(s) * max(x[s], y[s]) for s in x | y)
    return low / high if high else 0.0


class HammingIndex:
    """Exact search for fingerprints within ``radius`` by blocks of their 64 bits."""

    def __init__(self, fingerprints, radius: int = RADIUS, blocks: int = BLOCKS):
        self.radius, near = radius, radius // blocks
        self.held = np.array(fingerprints, dtype=np.uint64)
        edges = [64 * i // blocks for i in range(blocks + 1)]
        self.blocks = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            width = hi - lo
            values = (self.held >> np.uint64(lo) & np.uint64((1 << width) - 1)).astype(np.int64)
            starts = np.concatenate(([0], np.cumsum(np.bincount(values, minlength=1 << width))))
            flips = np.array([sum(1 << b for b in bits) for k in range(near + 1) for bits in combinations(range(width), k)])
            self.blocks.append((lo, width, starts, np.argsort(values, kind="stable"), flips))

    def search(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``wanted``, place among the fingerprints) of all within the radius.

        Candidates are looked at in chunks, so memory stays the same whatever is wanted or held.
        """
        found, many_held = [np.zeros(0, dtype=np.int64)], max(len(self.held), 1)
        for first in range(0, len(wanted), WINDOWS):
            part = wanted[first : first + WINDOWS]
            for lo, width, starts, order, flips in self.blocks:
                at = (part >> np.uint64(lo) & np.uint64((1 << width) - 1)).astype(np.int64)[:, None] ^ flips
                many = starts[at + 1] - starts[at]
                chunk = np.cumsum(many.sum(axis=1)) // CANDIDATES
                for rows in np.split(np.arange(len(part)), np.flatnonzero(np.diff(chunk)) + 1):
                    begin, n = starts[at[rows]].ravel(), many[rows].ravel()
                    w = np.repeat(np.repeat(rows, len(flips)), n)
                    k = order[np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(w))]
                    close = np.bitwise_count(part[w] ^ self.held[k]) <= self.radius
                    found.append((w[close] + first) * many_held + k[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // many_held, pairs % many_held

    def within(self, f: int) -> set[int]:
        return set(self.search(np.array([f], dtype=np.uint64))[1].tolist())


class Items:
    """A block of benchmark items (id, words, codes, weights), ready to be held against documents."""

    def __init__(self, items: list[tuple], total: int, shingle: int, similarity: float, radius: int, blocks: int):
        self.similarity, self.known, self.rare = similarity, {}, float(np.log1p(total))
        self.ids = [i for i, *_ in items]
        self.codes = [np.array(c, dtype=np.int64).view(np.uint64) for _, _, c, _ in items]
        self.weights = [dict(zip(c.tolist(), w, strict=True)) for c, (_, _, _, w) in zip(self.codes, items, strict=True)]
        every = {c: w for held in self.weights for c, w in held.items()}
        self.every = np.array(sorted(every), dtype=np.uint64)
        self.weight_of = np.array([every[c] for c in self.every.tolist()])
        self.sizes = defaultdict(dict)  # by shingle size and item length: members, index, and the codes of the members
        members = defaultdict(list)
        for k, (_, n, _, _) in enumerate(items):
            members[min(n, shingle), n].append(k)
        for (size, n), held in members.items():
            prints = [window_simhashes(self.codes[k], self.weigh(self.codes[k]), n - size + 1)[0] for k in held]
            self.sizes[size][n] = (held, HammingIndex(prints, radius, blocks), np.unique(np.concatenate([self.codes[k] for k in held])))

    def weigh(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.every, codes)
        at[at == len(self.every)] = 0
        return np.where(self.every[at] == codes, self.weight_of[at], self.rare)

    def find(self, text: bytes) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the best windows, apart from one another by item."""
        if len(self.known) > 200_000:
            self.known = {}
        words = word_codes(text, self.known)
        best: dict[int, list] = defaultdict(list)
        for size, lengths in self.sizes.items():
            codes = shingle_codes(words, size)
            if not len(codes):
                continue
            at = np.searchsorted(self.every, codes)
            at[at == len(self.every)] = 0
            hits = np.flatnonzero(self.every[at] == codes)
            if not len(hits):
                continue
            weights = self.weigh(codes)
            for n, (members, index, own) in lengths.items():
                mine = hits[np.isin(codes[hits], own)]
                if len(mine):
                    self._slide(codes, weights, mine, n - size + 1, members, index, n, best)
        out = []
        for item, found in best.items():
            # An item's windows are of one length, so one that is taken has its cell of that length to itself.
            taken: dict[int, int] = {}
            for s, start, length in sorted(found, key=lambda f: (-f[0], f[1])):
                cell = start // length
                if all(abs(start - taken[c]) >= length for c in (cell - 1, cell, cell + 1) if c in taken):
                    taken[cell] = start
                    out.append((self.ids[item], start, min(length, len(words)), s))
        return out

    def _slide(self, codes, weights, hits, width: int, members, index, n: int, best) -> None:
        """Windows of ``width`` codes that share enough weight with the items of their length at ``hits``."""
        width = min(width, len(codes))
        shared, whole = np.zeros(len(codes) + 1), np.zeros(len(codes) + 1)
        shared[hits + 1] = weights[hits]
        np.cumsum(shared, out=shared)
        np.cumsum(weights, out=whole[1:])
        held = shared[width:] - shared[:-width]
        # The slack stands for rounding of the running sums; a shingle weighs log(2) or more.
        starts = np.flatnonzero((held > 0) & (held >= self.similarity * (whole[width:] - whole[:-width]) - 1e-3))
        if not len(starts):
            return
        for run in np.split(starts, np.flatnonzero((np.diff(starts) > width) | (np.diff(starts // WINDOWS) > 0)) + 1):
            lo, hi = int(run[0]), int(run[-1])
            prints = window_simhashes(codes[lo : hi + width], weights[lo : hi + width], width)[run - lo]
            for w, k in zip(*(x.tolist() for x in index.search(prints)), strict=True):
                item, start = members[k], int(run[w])
                known = self.weights[item]
                s = weighted_jaccard(codes[start : start + width], self.codes[item], lambda c: known.get(c, self.rare))  # noqa: B023
                if s >= self.similarity:
                    best[item].append((s, start, n))


def shingled_items(benchmark: DataFrame, shingle: int = SHINGLE, least: int = SHINGLE, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(item_id, words, codes, weights) of every item of ``least`` words or more, and their number.

    ``codes`` are the item's shingles in order, of all its words where it has fewer than ``shingle``; a
    shingle that stands in k of n items has the weight log(1 + n / k).
    """

    def run(batches):
        for batch in batches:
            rows = []
            for key, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                words = word_codes(t)
                if len(words) >= max(least, 1):
                    rows.append((key, i, len(words), shingle_codes(words, min(shingle, len(words))).view(np.int64).tolist()))
            key, i, n, codes = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.array(codes, pa.list_(pa.int64()))], ["key", "item_id", "words", "codes"])

    texts = benchmark.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    items = cut(texts.mapInArrow(run, "key long, item_id long, words long, codes array<long>"))
    total = items.count()
    each = items.select("key", F.posexplode("codes").alias("at", "code"))
    held = each.select("key", "code").distinct().groupBy("code").agg(F.count("*").alias("k"))
    weighted = each.join(held, "code").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", F.log1p(F.lit(total) / F.col("k")).alias("w")))).alias("w"))
    return items.join(weighted, "key").select("item_id", "words", "codes", F.col("w.w").alias("weights")), total


def matches(
    documents: DataFrame,
    benchmark: DataFrame,
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    blocks: int = BLOCKS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: int = SHINGLE,
) -> DataFrame:
    """Contaminated places: doc_id, item_id, start_word, n_words, similarity.

    One row per document and item and place where a window of the item's length has a weighted
    shingle similarity of ``similarity`` or more; of overlapping windows the best stands for all.  In a
    pair, a shingle that the item has not weighs as much as one that a single item has.
    Items of fewer than ``least`` words are no evidence and match nothing; with a lower ``least``, those of
    fewer words than a shingle match where all their words stand.  Null texts match nothing, and a null id
    is kept as it is.  Texts are searched whole, however long.  Repeated rows are matched each; an empty
    table of either kind gives an empty result; other columns are ignored.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, start_word long, n_words long, similarity double"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]

    def against(block):
        def run(batches):
            items = Items(block, total, shingle, similarity, radius, blocks)
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True) for m in items.find(t)]
                columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

        return docs.mapInArrow(run, schema)

    items, total = shingled_items(benchmark, shingle, least, item_col, item_text_col)
    found, rows = docs.sparkSession.createDataFrame([], schema), map(tuple, items.toLocalIterator())
    while block := list(islice(rows, ITEMS)):
        found = found.unionByName(cut(against(block)))
    return found


def clean(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``documents`` without those that hold a benchmark item.

    A doc_id goes as a whole; rows with a null doc_id stay, as do null texts.  All columns are kept.
    """
    found = matches(documents, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias("_dc_id")).where("_dc_id is not null").distinct()
    return documents.join(found, documents[id_col].cast("long") == F.col("_dc_id"), "left_anti")
