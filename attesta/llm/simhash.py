"""SimHash near-duplicates found with pivot distance tables.

Every distinct fingerprint gets a table of Hamming distances to many reference fingerprints
(pivots), kept apart for each of a few bit segments.  A distance is a sum over segments, so

* two fingerprints that agree on a set of segments have equal pivot coordinates there.  Of
  ``segments`` any two within ``radius`` agree on ``segments - radius`` at least, and the
  coordinates of each choice of so many make the key under which candidates meet;
* by the triangle inequality a pair whose whole coordinates differ by more than ``radius`` for any
  pivot is too far, and is discarded before its fingerprints are compared.

Survivors are verified on the fingerprints.  A meeting place yields a spanning forest of its links,
never all of its pairs.  What meets in a place of more than ``PLACE`` fingerprints meets again under
the keys of more and shorter segments; with the last, 16 of 4 bits, all but ``radius`` segments
agree in a place, so it holds 256 fingerprints at most and is swept like any other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, cut, utf8
from .components import connected_components, least_labels

PIVOTS = 24
PLACE, LEVELS = 512, (4, 8, 16)
SEED = 42
_CHUNK = 1 << 16


def _bits_over_half(hashes: np.ndarray) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i : i + _CHUNK].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text; A-Z count as lower case, no words give 0."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    spans = zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return _bits_over_half(np.fromiter((digest(view[s:e], SEED) for s, e in spans), dtype=np.uint64, count=len(tokens) - words + 1))


def fingerprints(documents: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long.  Null texts count as empty."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, words) for t in utf8(batch.column(1))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def segment_masks(segments: int) -> np.ndarray:
    edges = [64 * i // segments for i in range(segments + 1)]
    return np.array([((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)], dtype=np.uint64)


def pivot_table(fps: np.ndarray, segments: int, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances by fingerprint, segment and pivot, shape (n, segments, pivots), uint8.

    The pivots are fixed pseudo-random fingerprints, the same in every task and at every size.
    """
    refs = np.random.default_rng(20240229).integers(0, 1 << 63, pivots, dtype=np.uint64) * np.uint64(2) + np.arange(pivots, dtype=np.uint64) % np.uint64(2)
    masks = segment_masks(segments)
    return np.bitwise_count((fps[:, None, None] ^ refs[None, None, :]) & masks[None, :, None]).astype(np.uint8)


def _keyed(fps: DataFrame, radius: int, segments: int) -> DataFrame:
    """One row for each fingerprint and choice of ``segments - radius`` segments, with the pivot key."""
    choices = list(combinations(range(segments), segments - radius))

    def run(batches):
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(f):
                continue
            coords = pivot_table(f, segments)
            keys = []
            for c, chosen in enumerate(choices):
                rows = np.ascontiguousarray(coords[:, list(chosen), :]).reshape(len(f), -1)
                keys.append(np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), c) for r in rows), dtype=np.uint64, count=len(f)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(f.view(np.int64), len(choices)))], ["place", "fp"]
            )

    return fps.select("fp").mapInArrow(run, "place long, fp long")


def forest(f: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (index pairs) that join what is within ``radius`` among few fingerprints, as a forest.

    Fingerprints are swept in the order of their distance to the first pivot, against those that
    follow within ``radius`` there; the other pivots discard pairs next; survivors are compared.
    """
    table = pivot_table(f, 1)[:, 0, :].astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    table, f = table[order], f[order]
    last = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    root = list(range(len(f)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i in range(len(f) - 1):
        window = slice(i + 1, last[i])
        near = np.abs(table[window] - table[i]).max(axis=1, initial=0) <= radius
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if int(f[i] ^ f[j]).bit_count() <= radius and (a := find(i)) != (b := find(j)):
                root[b] = a
                links.append((int(order[i]), int(order[j])))
    return links


def _links_in_places(keyed: DataFrame, radius: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            out_a, out_b = [], []
            for members in batch.column(0).to_pylist():
                f = np.unique(np.array(members, dtype=np.int64)).view(np.uint64)
                for i, j in forest(f, radius):
                    out_a.append(int(f[i].view(np.int64)))
                    out_b.append(int(f[j].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return keyed.mapInArrow(run, "a long, b long")


def near_fingerprints(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) links among the distinct values of ``fps.fp`` whose components are those of all pairs
    within ``radius`` bits.  ``radius`` is 0, 1 or 2."""
    if radius not in (0, 1, 2):
        raise ValueError("radius must be 0, 1 or 2")
    links, left = None, fps.select("fp").distinct()
    for segments in LEVELS:
        keyed = cut(_keyed(left, radius, segments))
        sizes = keyed.groupBy("place").agg(F.count("*").alias("n")).where("n > 1")
        last = segments == LEVELS[-1]
        # A place's members are gathered only where it is known how many meet.
        small = keyed.join((sizes if last else sizes.where(f"n <= {PLACE}")).select("place"), "place").groupBy("place").agg(F.collect_list("fp").alias("fps"))
        found = _links_in_places(small.select("fps"), radius)
        links = found if links is None else links.unionByName(found)
        if last:
            return links
        left = cut(keyed.join(sizes.where(f"n > {PLACE}").select("place"), "place").select("fp").distinct())
        if left.isEmpty():
            return links


def near_duplicates(documents: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``documents``: doc_id, fp (signed long), component_id.

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` differing
    bits, itself included.  Null and empty texts have fingerprint 0 and link like any other.  Equal
    texts meet at their fingerprint and cost no pairs.  Rows with the same doc_id keep a row each; a
    null doc_id names no group and takes part with a null of its own only if nothing else is near.
    An empty table gives an empty result; other columns are ignored.
    """
    fps = cut(fingerprints(documents, words, id_col, text_col))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = cut(connected_components(near_fingerprints(classes, radius)))
    named = joined.join(classes, joined.node == classes.fp).select("fp", "component", "least")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    grouped = named.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(16)).cast("int")).join(
        least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["component", "salt"]
    )
    by_fp = classes.join(grouped.select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(cut(by_fp), "fp").select("doc_id", "fp", "component_id")


def hex16(col):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


# Wide fingerprints, for similarities well below equality.

WORDS64, SAMPLED, WIDE_TABLES, WIDE_RADIUS, SIMILAR = 4, 16, 96, 60, 0.8
BLOCK, FEW, SHINGLES = 1024, 64, 1 << 20
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _spread(h: np.ndarray, salt: np.uint64) -> np.ndarray:
    h = h ^ salt
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values ``h`` have each bit set, most significant first.

    Carry-save adders fold three values into a sum and a carry, so most of the work is on whole words.
    """
    counts, level = np.zeros(64, dtype=np.int64), 0
    while len(h):
        carries = []
        while len(h) > 48:
            m = len(h) // 3
            a, b, c = h[:m], h[m : 2 * m], h[2 * m : 3 * m]
            x = a ^ b
            carries.append((a & b) | (c & x))
            h = np.concatenate((x ^ c, h[3 * m :]))
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) << level
        h, level = np.concatenate(carries) if carries else h[:0], level + 1
    return counts


def shingle_hashes(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a UTF-8 text; A-Z count as lower case."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    size = min(words, len(tokens))
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest, view = len(tokens) - size + 1, xxhash.xxh3_64_intdigest, memoryview(joined)
    return np.unique(np.fromiter((digest(view[s:e]) for s, e in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n))


def wide_of(h: np.ndarray) -> bytes:
    """256-bit SimHash of a set of shingle hashes; an empty one gives zeros."""
    return b"".join(np.packbits(bit_counts(_spread(h, salt)) * 2 > len(h)).tobytes() for salt in _SALT)


def wide_fingerprint(text: bytes, words: int = 5) -> bytes:
    """256-bit SimHash of the distinct word shingles of a UTF-8 text; no words give zeros."""
    return wide_of(shingle_hashes(text, words))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of each row of ``a`` to each of ``b``."""
    out = np.zeros((len(a), len(b)), dtype=np.int16)
    for w in range(WORDS64):
        out += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
    return out


def wide_pivots(count: int) -> np.ndarray:
    return np.random.default_rng(20240302).integers(0, 1 << 64, (count, WORDS64), dtype=np.uint64)


def wide_places(f: np.ndarray) -> np.ndarray:
    """A key for each fingerprint and table: its pivot coordinates within the table's sampled bits."""
    rng = np.random.default_rng(20240303)
    refs, mix = wide_pivots(24), rng.integers(0, 1 << 64, 24, dtype=np.uint64) | np.uint64(1)
    keys = np.empty((WIDE_TABLES, len(f)), dtype=np.uint64)
    for t in range(WIDE_TABLES):
        mask = np.zeros(WORDS64, dtype=np.uint64)
        for bit in rng.choice(64 * WORDS64, SAMPLED, replace=False).tolist():
            mask[bit // 64] |= np.uint64(1 << (bit % 64))
        used = np.flatnonzero(mask)
        total = np.full(len(f), t, dtype=np.uint64)
        for ref, m in zip(refs, mix, strict=True):
            total += np.bitwise_count((f[:, used] ^ ref[used]) & mask[used]).sum(axis=1, dtype=np.uint64) * m
        keys[t] = _spread(total, _SALT[0])
    return keys


def _wide_values(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=">u8").astype(np.uint64).reshape(len(raw), WORDS64)


def _wide_keyed(nodes: DataFrame) -> DataFrame:
    """(place, node, fp, label): a row for each of ``nodes`` (node, fp, label) and table."""

    def key(batches):
        for batch in batches:
            keys = wide_places(_wide_values(batch.column(1)))
            for t in range(WIDE_TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(keys[t].view(np.int64)), *batch.columns], ["place", "node", "fp", "label"])

    return nodes.select("node", "fp", "label").mapInArrow(key, "place long, node long, fp binary, label long")


def nearest_before(f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least member reachable over distances within ``radius``, nearest member before or -1, its distance)."""
    apart = _distances(f, f)
    near = apart <= radius
    least = np.full(len(f), -1)
    for start in range(len(f)):
        if least[start] >= 0:
            continue
        edge, least[start] = np.array([start]), start
        while len(edge):
            edge = np.flatnonzero(near[edge].any(axis=0) & (least < 0))
            least[edge] = start
    apart[~near] = 1 << 14
    apart[np.triu_indices(len(f))] = 1 << 14
    best = apart.argmin(axis=1)
    far = apart[np.arange(len(f)), best]
    return least, np.where(far < 1 << 14, best, -1), far


def _groups(batches, heads: int):
    """Whole groups of rows that agree on the first ``heads`` columns, many to an item, from sorted batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        last = np.ones(table.num_rows, dtype=bool)
        for c in range(heads):
            x = table.column(c).to_numpy()
            last &= x == x[-1]
        at = int(last.argmax())
        if at:
            yield table.slice(0, at).combine_chunks()
        held = table.slice(at)
    if held is not None:
        yield held.combine_chunks()


def _edges(table: pa.Table, heads: int) -> np.ndarray:
    new = np.zeros(table.num_rows - 1, dtype=bool)
    for c in range(heads):
        x = table.column(c).to_numpy()
        new |= x[1:] != x[:-1]
    return np.flatnonzero(np.concatenate(([True], new, [True])))


def _dealt(classes: DataFrame) -> DataFrame:
    """(place, salt, node, fp, first): a place of more than two ``BLOCK`` rows has salts and names its first node."""
    keyed = _wide_keyed(classes.withColumn("label", F.col("node"))).drop("label")
    hot = cut(keyed.groupBy("place").agg(F.count("*").alias("n"), F.min("node").alias("first")).where(F.col("n") > 2 * BLOCK))
    dealt = keyed.join(beside(hot), "place", "left").withColumn("salt", F.pmod(F.xxhash64("place", "node"), F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1))).cast("int"))
    return dealt.select("place", "salt", "node", "fp", "first")


def _met(classes: DataFrame, radius: int) -> DataFrame:
    """(a, b, d) with a < b: for every node and place the nearest smaller node within ``radius``; where there
    is none, with a null ``d`` the least node that it may be joined with there.

    A place of more than two ``BLOCK`` rows is dealt to tasks by salts; its blocks may all be joined.
    """

    def link(batches):
        for table in _groups(batches, 2):
            edges = _edges(table, 2)
            sizes = np.diff(edges)
            chosen = np.repeat(sizes > 1, sizes) | table.column("first").is_valid().to_numpy()
            if not chosen.any():
                continue
            table = table.filter(pa.array(chosen))
            edges = _edges(table, 2)
            sizes = np.diff(edges)
            node, f = table.column("node").to_numpy(), _wide_values(table.column("fp").combine_chunks())
            group = np.repeat(np.arange(len(sizes)), sizes)
            few = np.repeat(sizes <= FEW, sizes)
            i, j, d = [], [], []
            for step in range(1, min(FEW, int(sizes.max(initial=1)))):
                x = np.flatnonzero((group[step:] == group[:-step]) & few[step:])
                far = np.bitwise_count(f[x] ^ f[x + step]).sum(axis=1, dtype=np.int64)
                x, far = x[far <= radius], far[far <= radius]
                i, j, d = [*i, x], [*j, x + step], [*d, far]
            i, j, d = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (i, j, d))
            least = np.arange(len(node))
            if len(i):
                at, low = least_labels(i, j)
                least[at] = low
                order = np.lexsort((i, d, j))
                i, j, d = i[order], j[order], d[order]
                first = np.concatenate(([True], j[1:] != j[:-1]))
                i, j, d = i[first], j[first], d[first]
            for k in np.flatnonzero(sizes > FEW).tolist():
                s, e = edges[k], edges[k + 1]
                low, best, far = nearest_before(f[s:e], radius)
                least[s:e] = low + s
                got = np.flatnonzero(best >= 0)
                i, j, d = np.concatenate((i, best[got] + s)), np.concatenate((j, got + s)), np.concatenate((d, far[got]))
            alone = np.ones(len(node), dtype=bool)
            alone[j] = False
            own = np.flatnonzero(alone & (least != np.arange(len(node))))
            a, b = np.concatenate((node[i], node[least[own]])), np.concatenate((node[j], node[own]))
            d = pa.array(np.concatenate((d, np.zeros(len(own), np.int64))), mask=np.arange(len(a)) >= len(i))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), d], ["a", "b", "d"])
            hot = table.filter(pa.array(table.column("first").is_valid().to_numpy() & alone & (least == np.arange(len(node)))))
            if hot.num_rows:
                a, b = hot.column("first").to_numpy(), hot.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(a[a < b]), pa.array(b[a < b]), pa.nulls(int((a < b).sum()), pa.int64())], ["a", "b", "d"])

    dealt = _dealt(classes).repartition("place", "salt").sortWithinPartitions("place", "salt", "node")
    return dealt.mapInArrow(link, "a long, b long, d long").groupBy("a", "b").agg(F.min("d").alias("d"))


def similar_pairs(fps: np.ndarray, sets: list[np.ndarray], label: np.ndarray, one: np.ndarray, other: np.ndarray, radius: int, similarity: float) -> list[tuple[int, int]]:
    """A forest of links between the rows ``one`` and the rows ``other`` that stand under different labels,
    are within ``radius`` and have a Jaccard similarity of ``similarity`` at least."""
    root = {x: x for x in label.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    near = _distances(fps[one], fps[other]) <= radius
    near &= label[one][:, None] != label[other][None, :]
    sizes = np.array([len(x) for x in sets])
    values, flat = np.unique(np.concatenate([sets[k] for k in other.tolist()]), return_inverse=True) if len(other) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    ends = np.concatenate(([0], np.cumsum(sizes[other])))
    links, mark = [], np.zeros(len(values), dtype=bool)
    for x in np.flatnonzero(near.any(axis=1)).tolist():
        i = int(one[x])
        cand = [y for y in np.flatnonzero(near[x]).tolist() if find(int(label[other[y]])) != find(int(label[i]))]
        if not cand:
            continue
        at = np.searchsorted(values, sets[i])
        at = at[(at < len(values))]
        at = at[np.isin(values[at], sets[i], assume_unique=True)]
        mark[at] = True
        for y in cand:
            j = int(other[y])
            shared = int(mark[flat[ends[y] : ends[y + 1]]].sum())
            if shared >= similarity * (sizes[i] + sizes[j] - shared) - 1e-9 and (a := find(int(label[i]))) != (b := find(int(label[j]))):
                root[b] = a
                links.append((i, j))
        mark[at] = False
    return links


def _compared(left: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(a, b): links between the nodes of ``left`` (component, label, node, fp, hashes) that join what is similar
    under different labels of a component.

    A component is dealt to blocks, of ``BLOCK`` nodes or ``SHINGLES`` hashes about.  Blocks of all its nodes meet
    blocks of those outside its commonest label, as two of that label need no link; each two are a task's
    work of their own, and what travels are sets, never pairs.
    """

    def link(batches):
        for table in _groups(batches, 3):
            edges = _edges(table, 3)
            node, label, role = (table.column(c).to_numpy() for c in ("node", "label", "role"))
            f, hashes = _wide_values(table.column("fp").combine_chunks()), table.column("hashes").combine_chunks()
            a, b = [], []
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if (label[s:e] == label[s]).all():
                    continue
                sets = [hashes[k].values.to_numpy().view(np.uint64) for k in range(s, e)]
                one, other = np.flatnonzero(role[s:e] != 1), np.flatnonzero(role[s:e] != 0)
                for i, j in similar_pairs(f[s:e], sets, label[s:e], one, other, radius, similarity):
                    a.append(int(node[s + i]))
                    b.append(int(node[s + j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held = left.withColumn("size", F.size("hashes").cast("long"))
    by_label = held.groupBy("component", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    total = by_label.groupBy("component").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "size", "label")).alias("top"))
    count = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / SHINGLES)).cast("int")
    hot = total.where((F.col("n") > BLOCK) | (F.col("size") > SHINGLES))
    hot = cut(hot.select("component", F.col("top.label").alias("major"), count(F.col("n"), F.col("size")).alias("blocks"), count(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("others")))
    met = left.join(beside(hot), "component", "left")
    kind = "array<struct<role:int,x:int,y:int>>"
    cell = lambda role, x, y: F.struct(F.lit(role).alias("role"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    upto = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
    mine, other = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64("node", "component"), F.greatest(F.col("others"), F.lit(1)))
    as_one = F.transform(upto("others"), lambda y: cell(0, mine, y))
    as_other = F.when(F.col("label") != F.col("major"), F.transform(upto("blocks"), lambda x: cell(1, x, other))).otherwise(F.array().cast(kind))
    cells = F.when(F.col("blocks").isNull(), F.array(cell(2, F.lit(0), F.lit(0)))).otherwise(F.concat(as_one, as_other))
    met = met.select("component", "node", "fp", "label", "hashes", F.explode(cells).alias("c")).select("component", "c.x", "c.y", "node", "fp", "label", "hashes", "c.role")
    return met.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y", "node").mapInArrow(link, "a long, b long")


def _judged(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similar): whether the sets of two nodes have a Jaccard similarity of ``similarity`` at least.

    Only the set of ``b`` travels with a pair; a node of many pairs is split by the adaptive skew join.
    """
    of = lambda side: sets.select(F.col("node").alias(side), F.col("hashes").alias(f"{side}_set"))
    both = pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return both.select("a", "b", (shared >= F.lit(similarity) * (F.size("a_set") + F.size("b_set") - shared) - F.lit(1e-9)).alias("similar"))


def _shingled(documents: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, d1, d2, text): a row's key is its id, null included, and two digests of its text."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.select("doc_id", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), F.col("text")).alias("d2"), "text")


_KEY = ("doc_id", "d1", "d2")


def _on_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    on = left["doc_id"].eqNullSafe(right["_doc_id"]) & (left["d1"] == right["_d1"]) & (left["d2"] == right["_d2"])
    return left.join(right, on, how)


def _similar(documents: DataFrame, words: int, radius: int, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, d1, d2, node) and groups (node, component, _doc_id, _d1, _d2), which name the first row of a component."""

    def run(batches):
        for batch in batches:
            nodes, fps = [], []
            for t in utf8(batch.column(3)):
                h = shingle_hashes(t, words)
                nodes.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                fps.append(wide_of(h))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(fps, pa.binary())], [*_KEY, "node", "fp"])

    def hashed(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                sets = [shingle_hashes(t, words).view(np.int64) for t in utf8(part.column(1))]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["node", "hashes"])

    docs = _shingled(documents, words, id_col, text_col)
    rows = cut(docs.mapInArrow(run, "doc_id long, d1 long, d2 long, node long, fp binary"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), *_KEY)
    classes = cut(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.min(order).alias("row")))
    met = cut(_met(classes, radius))
    coarse = cut(connected_components(met))
    wanted = classes.join(coarse, "node").select("node", *(F.col(f"row.{c}").alias(f"_{c}") for c in _KEY))
    sets = cut(_on_key(docs, beside(wanted), "inner").select("node", "text").mapInArrow(hashed, "node long, hashes array<long>").groupBy("node").agg(F.first("hashes").alias("hashes")))
    # First the nearest smaller neighbour of each node, which settles most.
    pairs = met.where("d is not null").groupBy("b").agg(F.min_by("a", F.struct("d", "a")).alias("a"))
    links = cut(_judged(pairs, sets, similarity).where("similar").select("a", "b"))
    joined = connected_components(links).withColumnRenamed("component", "label")
    named = cut(coarse.join(joined, "node", "left").select("node", "component", F.coalesce("label", "node").alias("label")))
    # Then all of a component that still stands under several labels.
    several = named.groupBy("component").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("component")
    left = cut(named.join(several, "component", "left_semi").join(classes.select("node", "fp"), "node").join(sets, "node"))
    joined = cut(connected_components(links.unionByName(cut(_compared(left, radius, similarity)))))
    grouped = cut(classes.join(joined, "node", "left").select("node", "row", F.coalesce("component", "node").alias("component")))
    first = grouped.groupBy("component").agg(F.min("row").alias("row")).select("component", *(F.col(f"row.{c}").alias(f"_{c}") for c in _KEY))
    return rows.select(*_KEY, "node"), grouped.select("node", "component").join(first, "component")


def similar_documents(
    documents: DataFrame, words: int = 5, radius: int = WIDE_RADIUS, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILAR
) -> DataFrame:
    """(doc_id, component_id) of every document over links of similar texts.

    Texts link when their sets of distinct ``words``-word shingles have a Jaccard similarity of
    ``similarity`` at least, which is computed from the sets themselves.  Candidates are pairs whose
    256-bit SimHashes differ by at most ``radius`` bits (39 are expected at 0.8) and share a place in
    one of 96 tables, each keyed by the pivot coordinates within 16 sampled bits.  Those candidates tell
    apart groups; within a group whatever is within ``radius`` is compared, but for what other links
    have joined.  Null and empty texts are alike.  Rows with
    a null doc_id take part, but name no component and are not returned.
    """
    rows, groups = _similar(documents, words, radius, similarity, id_col, text_col)
    return rows.where("doc_id is not null").join(groups.select("node", F.col("_doc_id").alias("component_id")), "node").select("doc_id", "component_id")


def first_of_similar(documents: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that come first in their component: that of the smallest id, null last.

    A row is known by its id and text, so rows that share an id go or stay by their own texts; of rows
    that repeat both, one stays.
    """
    rows, groups = _similar(documents, words, WIDE_RADIUS, SIMILAR, id_col, text_col)
    key = [F.col(f"_{c}") for c in _KEY]
    first = cut(groups.where(F.col("node").isNotNull()).select(*key).distinct())
    twice = cut(rows.groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1").select(*_KEY))
    whole = documents.select(F.struct(*documents.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    whole = whole.select("row", "doc_id", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), F.col("text")).alias("d2"))
    if twice.isEmpty():
        return _on_key(whole, first, "left_semi").select("row.*")
    on = twice["doc_id"].eqNullSafe(first["_doc_id"]) & (twice["d1"] == first["_d1"]) & (twice["d2"] == first["_d2"])
    once, again = cut(first.join(twice, on, "left_anti")), cut(first.join(twice, on, "left_semi"))
    return _on_key(whole, once, "left_semi").select("row.*").unionByName(_on_key(whole, again, "left_semi").dropDuplicates(list(_KEY)).select("row.*"))
