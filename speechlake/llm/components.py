"""Connected components of links, by contraction: no link or component ever meets the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.llm.common import checkpointed, lean, tune


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that the given links reach) of every node that isn't its own."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        apart = ru != rv
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(ru, rv)[apart], np.minimum(ru, rv)[apart])
        while (root != root[root]).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(links: DataFrame) -> DataFrame:
    """Links (hi, lo) that join the same nodes, fewer: each task replaces its own by a forest of stars."""

    def run(batches):
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            x, y = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            a, b = forest(np.concatenate([a, x]), np.concatenate([b, y]))
            if len(a) > 2_000_000:  # bounded; what is left over joins in later rounds
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["hi", "lo"])
                a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["hi", "lo"])

    return links.mapInArrow(lean(run), "hi long, lo long")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link to a smaller one in its component; links: (a, b) long.

    Each round hooks every node to the smallest node it is linked with and replaces links by those between what
    nodes now hang on; a round at least halves the nodes with links, so rounds grow with their logarithm.
    """
    tune(links.sparkSession)
    edges = checkpointed(_contract(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))))
    mapped = None
    while not edges.isEmpty():
        hooks = checkpointed(edges.groupBy("hi").agg(F.min("lo").alias("to")))
        fresh = hooks.select(F.col("hi").alias("node"), F.col("to").alias("component"))
        h1, h2 = hooks.select(F.col("hi").alias("h1"), F.col("to").alias("t1")), hooks.select(F.col("hi").alias("h2"), F.col("to").alias("t2"))
        if mapped is None:
            mapped = fresh
        else:
            mapped = mapped.join(h1, F.col("component") == F.col("h1"), "left").select("node", F.coalesce("t1", "component").alias("component")).unionByName(fresh)
            # a node hangs on one other: keep the latest, which is the smallest
            mapped = mapped.groupBy("node").agg(F.min("component").alias("component"))
        mapped = checkpointed(mapped)
        moved = edges.join(h1, F.col("hi") == F.col("h1"), "left").join(h2, F.col("lo") == F.col("h2"), "left").select(F.coalesce("t1", "hi").alias("a"), F.coalesce("t2", "lo").alias("b"))
        edges = checkpointed(_contract(moved.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()))
    if mapped is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return mapped


#: The same in SQL, behind both_ways (x, y) and nodes (id).
COMPONENTS_SQL = """reach(node, c) AS (SELECT id, id FROM nodes UNION SELECT l.y, r.c FROM reach r JOIN both_ways l ON l.x = r.node),
component AS (SELECT node, min(c) AS c FROM reach GROUP BY node)"""
