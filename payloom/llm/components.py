"""Connected components of an edge table by alternating large and small stars.

Every round replaces neighbours by the smallest one, with partial aggregation before each shuffle; components end as
stars around their smallest node after about log rounds. Each round is written to the shared folder, so lineage stays
short and a lost executor costs one round at most. Nothing is collected but two numbers a round. Of `FEW` edges at most,
whatever the input, one task makes all components at once; a round would write four tables, each file of which costs a
JVM on a local disk three child processes (chmod of folder, file and checksum), which share its memory until they start.

The centre of a large star is one key with very many edges. Nodes with over 1 / `HOT` of all edges (so fewer than HOT of
them) come to the driver and are broadcast with their smallest neighbour, so their edges stay where they are; only edges
of other nodes are dealt out by node. Other joins are sort-merge joins by hint: small tables of binary keys
would each take a page of 64 MB of the driver to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payloom.llm.common import discard
from payloom.llm.common import stored_by_workers as stored

#: A key with more than 1 / HOT of all rows, and LEAST_HOT at least, is hot.
HOT = 512
LEAST_HOT = 256
#: Edges that one task connects by itself: tens of MB of it.
FEW = 200_000


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one of its component under the edges u-v."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        open_ = a != b
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # roots only, each to a smaller one
        while (root[root] != root).any():
            root = root[root]
    return root


def split_join(rows: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with one (unique by key, with cnt: how many rows each key has, out of total).

    Hot keys, fewer than HOT, are joined by broadcast; the others by shuffle. one is stored, as it is read twice.
    """
    one = stored(one, "one")
    found = one.where((F.col("cnt") * HOT > total) & (F.col("cnt") >= LEAST_HOT)).drop("cnt").collect()
    if not found:
        return rows.join(one.drop("cnt").hint("merge"), key)
    few = F.broadcast(rows.sparkSession.createDataFrame(found, one.drop("cnt").schema))
    hot = F.col(key).isin([r[key] for r in found])
    rest = rows.where(~hot).join(one.drop("cnt").where(~hot).hint("merge"), key)
    return rows.where(hot).join(few, key).unionByName(rest)


def _round(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("cnt"))
    large = split_join(both, least, "u", 2 * total).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    large = stored(large, "large")
    least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("cnt"))
    small = split_join(large, least, "u", total).where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _at_once(edges: DataFrame) -> DataFrame:
    """Edges (u, v) -> stars (u, v), each node but the roots with its root, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = list(batches)
        if not given:
            return
        ends = pa.concat_arrays([b.column(i) for i in (0, 1) for b in given])
        nodes = pc.unique(ends)
        nodes = nodes.take(pc.array_sort_indices(nodes))
        at = pc.index_in(ends, value_set=nodes).to_numpy()
        root = forest(len(nodes), at[: len(at) // 2], at[len(at) // 2 :])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(root[moved]))], ["u", "v"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, edges.select("u", "v").schema)


def connected(edges: DataFrame) -> DataFrame:
    """edges (u, v), any order, repeats and loops allowed -> (node, root): each linked node but the roots, root its component's smallest node.

    Edges with a null end are ignored; an empty table gives an empty one.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = stored(edges, "edges"), None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now[0] == 0 or now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, old = now, edges
        edges = stored(_at_once(old) if now[0] <= FEW else _round(old, now[0]), "edges")
        discard(old)
        if now[0] <= FEW:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
