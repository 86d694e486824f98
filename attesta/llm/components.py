"""Connected components of a link table, without gathering links on the driver.

Every pass hooks and jumps.  Hooking deals the links by their larger node and lets each task replace
what it holds, ``CHUNK`` links at a time, by stars around the smallest nodes they reach; so a node has
at most one link from each task afterwards, and no task gathers the links of a hot node.  Jumping moves
each link to the least link of its smaller end, in a join whose hot keys the adaptive skew join splits.
Before the first pass tasks of about ``CHUNK`` links each do the same with the links as they come.
Passes end when every node has a single link, to a node that has none; their number grows with the
logarithm of the longest chain.  The same passes run at every size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CHUNK = 1 << 16


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable from each) of the links between ``u`` and ``v``."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        least = label.copy()
        np.minimum.at(least, label[a], low)
        np.minimum.at(least, label[b], low)
        while True:
            jumped = least[least]
            if (jumped == least).all():
                break
            least = jumped
        if (least == label).all():
            return nodes, nodes[label]
        label = least


def _stars(links: DataFrame) -> DataFrame:
    """(u, v) with the components of ``links``: what a task holds, as stars."""

    def run(batches):
        held, n = [], 0

        def flush():
            u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
            nodes, least = least_labels(u, v)
            far = nodes != least
            return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(least[far])], ["u", "v"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return links.mapInArrow(run, "u long, v long")


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link only, and that to a node that has none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("to")), F.struct(F.col("v").alias("node"), F.lit(None).cast("long").alias("to")))).alias("e")).select("e.*")
    by_node = ends.groupBy("node").agg(F.min("to").alias("lo"), F.max("to").alias("hi"), F.max(F.col("to").isNull()).alias("root"))
    return by_node.where("lo < hi or (root and lo is not null)").isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node reachable.

    ``links`` has two integer columns; order, repeats, self-links and nulls do not matter (a row
    with a null links nothing).  An empty table gives an empty result.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(u.isNotNull() & v.isNotNull() & (u != v))
    edges = cut(edges.distinct())
    edges = cut(_stars(edges.coalesce(-(-edges.count() // CHUNK) or 1)))
    while not _settled(edges):
        hooked = _stars(edges.repartition("u"))
        least = hooked.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("to"))
        edges = cut(hooked.join(least, "v", "left").select("u", F.coalesce("to", "v").alias("v")))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct().unionByName(roots)
