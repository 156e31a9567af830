"""Connected components as a loop of joins, each round written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.workspace import discard, materialize


HELD_NODES = 1 << 20  # of one task; beyond, it begins anew and keeps some edges more


def _spanning_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    above: dict[int, int] = {}

    def top(node: int) -> int:
        while (up := above.setdefault(node, node)) != node:
            above[node] = node = above[up]
        return node

    for batch in batches:
        kept = []
        for src, dst in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            one, other = top(src), top(dst)
            if one != other:
                above[one] = other
                kept.append((src, dst))
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept)], names=["src", "dst"])
        if len(above) > HELD_NODES:
            above.clear()


def spanning_edges(edges: DataFrame) -> DataFrame:
    """Those of edges (src long, dst long) that first connect two nodes within their task: the same components, and where all of a group are linked with all, edges as the
    nodes of the tasks and not as their square."""
    return edges.mapInArrow(_spanning_rows, "src long, dst long")


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """edges (src long, dst long) -> (node, component): component is the smallest node reachable.

    Every round takes the smallest label among a node and its neighbours, then the label of that label,
    so that long chains close in a logarithmic number of rounds. Both steps join many rows to one and
    aggregate with a minimum, so a node with very many neighbours costs no more than its edges.
    """
    both = materialize(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct(), "cc-edges")
    labels = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least")).select("node", F.least("node", "least").alias("component"))
    labels = materialize(labels, "cc-labels")
    for _ in range(max_rounds):
        heard = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("heard"))
        hooked = labels.join(heard, "node").select("node", F.col("component").alias("before"), F.least("component", "heard").alias("hook"))
        jump = hooked.select(F.col("node").alias("hook"), F.col("hook").alias("jumped"))
        before = labels
        moved = materialize(hooked.join(jump, "hook").select("node", F.col("jumped").alias("component"), (F.col("jumped") != F.col("before")).alias("moved")), "cc-labels")
        labels, done = moved.select("node", "component"), moved.where("moved").isEmpty()
        labels.written_at = moved.written_at
        discard(before)
        if done:
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
