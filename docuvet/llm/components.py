"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .support import shuffle_partitions, tidy


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the given links and the smallest node each one reaches by them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a):]
    root = np.arange(len(nodes))
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(before, root):
            break
    return nodes, nodes[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of each batch by a star per local component."""
    for batch in batches:
        if batch.num_rows:
            node, root = forest(np.asarray(batch.column("u")), np.asarray(batch.column("v")))
            linked = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(root[linked])], ["u", "v"])


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``links`` (columns ``u``, ``v``, long).

    ``component`` is the smallest node reachable. Each round contracts the links a task
    holds, then moves every neighbour of a node to its smallest one (large star) and
    every smaller neighbour likewise (small star). Minima are aggregated before the
    shuffle and joined back, so the centre of a large star is split like any hot join
    key. Each round is written to the shared folder; nothing is collected but one
    number per round.
    """
    shape = "u long, v long"
    parts = shuffle_partitions(links)
    edges = links.where("u is not null and v is not null and u <> v").mapInArrow(tidy(_contract), shape)
    edges = materialize(edges, "links")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # A star already flat is found as it was; the rest moves on.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                                         F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        contracted = small.repartition(parts, "v").mapInArrow(tidy(_contract), shape).distinct()
        edges = materialize(contracted, "links")
        # Stars are flat and apart when no centre is also a leaf and no leaf has two centres.
        leaves = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        open_ends = leaves.where("n > 1").select("u").unionByName(
            edges.select(F.col("v").alias("u")).distinct().join(leaves, "u", "left_semi"))
        if not open_ends.limit(1).count():
            break
    else:
        raise RuntimeError(f"links did not settle within {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
