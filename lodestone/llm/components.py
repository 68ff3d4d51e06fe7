"""Connected components by contraction: no edge list, label or component leaves the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, releasing

#: Edges that one task joins at most.
MOST_EDGES = 1 << 20


class _Forest:
    """Union-find over positions, on arrays."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        up = self.up
        while True:
            over = up[x]
            if (over == x).all():
                return x
            x = over

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            differ = a != b
            a, b = a[differ], b[differ]
            if not len(a):
                return
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(self.up, high, low)
            self.flatten()

    def flatten(self) -> None:
        while True:
            over = self.up[self.up]
            if (over == self.up).all():
                return
            self.up = over


def _stars(batches):
    """``(node, up)`` of every node, ``up`` the smallest one of its component, by the edges of a task."""
    held = [(batch.column(0), batch.column(1)) for batch in batches if batch.num_rows]
    if held:
        a, b = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
        nodes = pc.unique(pa.concat_arrays([a, b]))
        nodes = nodes.take(pc.sort_indices(nodes))
        forest = _Forest(len(nodes))
        forest.union(*(pc.index_in(x, nodes).to_numpy().astype(np.int64) for x in (a, b)))
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(forest.up))], names=["node", "up"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; component is the smallest node reachable.

    Each round hooks every node onto its smallest neighbour, follows the hooks
    to their ends, and replaces each edge by the edge of its ends. Every node
    that isn't smaller than all its neighbours vanishes, so the rounds grow with
    the logarithm of the longest chain. As soon as ``MOST_EDGES`` or fewer edges
    are left, which are counted first, one task joins these instead: rounds on
    few rows cost the driver more than the executors. If that holds from the
    start, edges are neither shuffled nor freed of repeats, and what the task
    gives is the result. A node with very many edges meets only aggregates with
    map-side combine and joins that adaptive execution can split. Nodes may be
    of any ordered type. Empty input gives an empty result. Edges with a null
    end are ignored. What a round replaces is deleted.
    """
    edges = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")),
        "cc-edges",
    )
    kind = edges.schema["a"].dataType.simpleString()
    n = edges.count()
    if n > MOST_EDGES:
        edges = materialize(edges.distinct(), "cc-edges", replaces=edges)
        n = edges.count()
    labels = None
    while n:
        if n <= MOST_EDGES:  # the last round
            hooks = materialize(edges.coalesce(1).mapInArrow(releasing(_stars), f"node {kind}, up {kind}"), "cc-hooks")
        else:
            # smallest neighbour of each node that has a smaller one
            hooks = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
            hooks = materialize(hooks, "cc-hooks")
            while True:
                above = hooks.select(F.col("node").alias("up"), F.col("up").alias("over"))
                jumped = hooks.join(above, "up", "left").select("node", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved"))
                hooks = materialize(jumped, "cc-hooks", replaces=hooks)
                if hooks.where("moved").isEmpty():
                    break
        if n <= MOST_EDGES and labels is None:
            forget(edges)
            return hooks.toDF("node", "component")
        up = hooks.where("node <> up").select("node", "up")
        if labels is None:
            labels = materialize(up.toDF("node", "component"), "cc-labels")
        else:
            more = labels.join(up.select(F.col("node").alias("component"), F.col("up").alias("over")), "component", "left").select("node", F.coalesce("over", "component").alias("component"))
            labels = materialize(more.unionByName(up.withColumnRenamed("up", "component")), "cc-labels", replaces=labels)
        if n <= MOST_EDGES:
            forget(edges, hooks)
            break
        ends = edges.join(up.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a", "left").select(F.coalesce("ua", "a").alias("a"), "b")
        ends = ends.join(up.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b", "left").select("a", F.coalesce("ub", "b").alias("b"))
        edges = materialize(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges", replaces=edges)
        forget(hooks)
        n = edges.count()
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = labels.toDF("node", "component")
    # what is a component's name was never hooked, so that it has no row yet
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())
