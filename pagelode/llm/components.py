"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm.common import Workspace, arrow_map


class Forest:
    """Links among n nodes as a forest: each node's label is the least node it is known to reach."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


#: Edges that are reduced together.
_EDGES = 1 << 20


def _reduced(edges: DataFrame) -> DataFrame:
    """The edges of each piece of a partition as a forest: every node but the least of its component hangs on that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def reduce() -> pa.RecordBatch:
            u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
            nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
            forest = Forest(len(nodes))
            forest.link(places[: len(u)], places[len(u) :])
            hung = np.flatnonzero(forest.label != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[hung]), pa.array(nodes[forest.label[hung]])], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= _EDGES:
                held = [reduce()]
                if len(held[0]) >= _EDGES // 2:
                    yield held.pop()
        if held:
            yield reduce()

    return arrow_map(edges.select("u", "v"), run, "u long, v long")


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Each node of the edges (u, v) with ``label``, the smallest node of its component.

    Loops and repeated edges count nothing; without edges there are no rows.

    Each piece of a partition is first reduced to a forest.  A large star then hangs a
    node's larger neighbours on its smallest one, a small star the smaller ones; the two
    alternate until nothing moves, in about as many rounds as the logarithm of the
    largest component.  Each round's edges are written to the
    shared folder, and the round before is removed.  Smallest neighbours are written
    before the edges meet them, so both joins stand on plain exchanges and Spark splits
    a node with many edges like any skewed key; nothing is collected but two numbers a
    round.
    """
    edges = ws.cut(_reduced(edges.where("u <> v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ws.cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m")), "least")
        large = ws.cut(both.join(least, both["u"] == least["node"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        smaller = ws.cut(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "node"), "least")
        hung = large.join(smaller, large["u"] == smaller["node"])
        small = hung.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = ws.cut(small.where("u <> v").distinct(), "edges")
        state = _state(after)
        for old in (edges, least, large, smaller):
            ws.drop(old)
        edges = after
        if state == before:
            break
        before = state
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
