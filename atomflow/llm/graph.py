"""Connected components of a graph given by its edges, in the cluster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomflow.llm.scratch import HOT, split_join, stored

#: Edges that are labelled in the driver at most (16 bytes each); more are labelled in the cluster, round by round.
LOCAL = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (a, b of a stored table); component is the smallest node reachable.

    A few edges are labelled in the driver, since a round in the cluster costs some seconds however little it moves. Otherwise, each round a node takes the smallest label among its own and its neighbours', then the label of that label; a
    chain of n nodes needs about log2(n) rounds. A round reads and writes tables in the shared
    folder, so no lineage builds up. Nodes with very many edges and labels of very many nodes are split among tasks.
    """
    edges = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter("a <> b")
    if edges.count() <= LOCAL:
        table = edges.toArrow()
        ends, number = np.unique(np.concatenate([table.column(c).to_numpy().astype(np.int64) for c in ("a", "b")]), return_inverse=True)
        n = len(number) // 2
        labels = ends[label_all(len(ends), number[:n], number[n:])]
        found = edges.sparkSession.createDataFrame(pa.table({"node": ends, "component": labels}), "node bigint, component bigint")
        return stored(found, "labels")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.filter("a <> b").distinct(), "edges")
    if not both.take(1):
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    degrees = both.groupBy("b").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT)
    degrees = stored(degrees, "degrees") if degrees.take(1) else None
    largest = 0
    while True:
        old = labels.withColumnRenamed("node", "b")
        near = both.join(old.hint("merge"), "b") if degrees is None else split_join(both, old, "b", "a", degrees)
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("least"))
        up = labels.select(F.col("node").alias("least"), F.col("component").alias("up"))
        # largest is the largest label of the round before.
        up = split_join(stored(least, "least"), up, "least", "node") if largest >= HOT else least.join(up.hint("merge"), "least")
        new = stored(up.select("node", "old", F.least("least", "up").alias("component")), "labels")
        state = new.groupBy("component").agg(F.count("*").alias("n"), F.max((F.col("old") != F.col("component")).cast("int")).alias("changed"))
        state = state.agg(F.max("n").alias("largest"), F.max("changed").alias("changed")).first()
        if not state["changed"]:
            return new.select("node", "component")
        labels, largest = new.select("node", "component"), state["largest"]


def label_all(nodes: int, i, j):
    """Labels (smallest node of the component) of a small graph with edges i[k]-j[k], with numpy."""
    labels = np.arange(nodes)
    while True:
        new = labels.copy()
        low = np.minimum(labels[i], labels[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new
