"""Connected components of a graph given as an edge DataFrame."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.plans.workspace import Workspace

#: Up to so many edges, what is left of a graph is solved in one task.
LOCAL_EDGES = 500_000


def _union_find(batches):
    """``node, to``: a common node of its component for every node of all the edges of a task."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    if up:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "to"])


def connected_components(edges: DataFrame, work: Workspace | None = None, a: str = "id1", b: str = "id2") -> DataFrame:
    """``node, root`` for every node that has an edge; ``root`` is the component's smallest node.

    Contraction: every node joins the neighbour that ranks lowest in a random order of the round, edges are relabelled,
    loops and repeats go, until no edge is left; then the steps are composed from the last, smallest one back. The
    random order shrinks the graph by a share of its nodes each round whatever its shape, so long chains take
    logarithmically many rounds. A graph that has or gets down to ``LOCAL_EDGES`` edges is solved by one task at once. Edges with a null end and loops are ignored.
    """
    work = work or Workspace(edges.sparkSession, "components")
    current = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    current = work.table(current.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges0")
    steps, turn = [], 0
    while left := current.count():
        turn += 1
        if left <= LOCAL_EDGES:
            kind = current.schema["u"].dataType.simpleString()
            steps.append(work.table(current.coalesce(1).mapInArrow(_union_find, f"node {kind}, to {kind}"), f"step{turn}"))
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))

        def rank(node: str):
            return F.struct(F.xxhash64(F.lit(turn), F.col(node)), F.col(node).alias("node"))

        low = both.groupBy("u").agg(F.min(rank("v")).alias("low"))
        step = low.select(F.col("u").alias("node"), F.when(F.col("low") < rank("u"), F.col("low.node")).otherwise(F.col("u")).alias("to"))
        step = work.table(step, f"step{turn}")
        ends = current.join(step.select(F.col("node").alias("u"), F.col("to").alias("x")), "u").join(step.select(F.col("node").alias("v"), F.col("to").alias("y")), "v")
        ends = ends.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        current = work.table(ends, f"edges{turn}")
        steps.append(step)
    if not steps:
        return current.select(F.col("u").alias("node"), F.col("u").alias("root"))
    found = steps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        later = found.select(F.col("node").alias("to"), "root")
        found = step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    found = work.table(found, "roots")
    least = found.groupBy("root").agg(F.min("node").alias("least"))
    return found.join(least, "root").select("node", F.col("least").alias("root"))
