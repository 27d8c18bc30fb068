"""Connected components by contraction, on DataFrames; nothing is gathered on the driver but row counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) over the edges a-b."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        low = np.minimum(parent[u], parent[v])
        new = parent.copy()
        np.minimum.at(new, parent[u], low)
        np.minimum.at(new, parent[v], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, parent):
            return nodes, nodes[parent]
        parent = new


def forest(edges: DataFrame) -> DataFrame:
    """Each partition's edges replaced by links from every node to the smallest node of its component there."""

    def shrink(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            node, root = local_components(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            off = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[off]), pa.array(root[off])], ["a", "b"])

    return edges.mapInArrow(shrink, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: long), root being the smallest node reachable.

    Each round points every node at its smallest neighbour, follows pointers, and contracts the edges; a node of high degree costs no
    more than its rows, as minima are combined before the shuffle and joins have one row for each node on one side. Rows with a null
    end, loops and repeated edges change nothing.
    """
    left = materialize(forest(edges.where("a is not null and b is not null and a <> b").select("a", "b")), "cc-edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        before = left
        both = left.union(left.select("b", "a"))
        up = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")).select(F.col("a").alias("n"), "p"), "cc-up")
        for _ in range(2):
            over, last = up.select(F.col("n").alias("m"), F.col("p").alias("q")), up
            up = materialize(up.join(over, up["p"] == over["m"]).select("n", F.col("q").alias("p")), "cc-up")
            discard(edges.sparkSession, last)
        rounds.append(up)
        pa_, pb_ = up.select(F.col("n").alias("a"), F.col("p").alias("x")), up.select(F.col("n").alias("b"), F.col("p").alias("y"))
        left = left.join(pa_, "a").join(pb_, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        left = materialize(forest(left), "cc-edges")
        discard(edges.sparkSession, before)
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0].select(F.col("n").alias("node"), F.col("p").alias("root"))
    for up in rounds[1:]:
        out = out.join(up, out["root"] == up["n"], "left").select("node", F.coalesce("p", "root").alias("root"))
    return out
