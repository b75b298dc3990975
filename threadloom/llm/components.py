"""Connected components of a graph of 64-bit nodes, by alternating large and small stars.

(Kiveris et al., Connected Components in MapReduce and Beyond, 2014.)  Each round is two aggregations and
joins on nodes, written to the shared folder, so lineage stays short; a hub's minimum is combined before the
exchange, and its rows in the join are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Links of its forest that a task keeps while it reads on.
HELD = 1 << 18


def merge(label, u, v):
    """Lets label hold the smallest index of each component after adding edges u-v."""
    import numpy as np

    while len(u):
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            next_ = label[label]
            if (next_ == label).all():
                break
            label[:] = next_


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges ``a > b``."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))) if large else edges
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(low, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges ``a > b`` with the same components: of the links a task reads those that close a circle go.

    A task keeps a forest, at most ``HELD`` links of it, so what leaves is in proportion to its nodes, however many links a
    large group has.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        a = b = np.zeros(0, np.int64)
        link = lambda: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        for batch in batches:
            u, v = (np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate((a, b)))
            names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            label = np.arange(len(names))
            merge(label, at[: len(u)], at[len(u) :])
            moved = np.flatnonzero(label != np.arange(len(names)))
            a, b = names[moved], names[label[moved]]
            if len(a) > HELD:
                yield link()
                a = b = np.zeros(0, np.int64)
        yield link()

    return edges.mapInArrow(run, "a long, b long")


def _settled(edges: DataFrame) -> bool:
    """Whether all edges ``a > b`` are stars: each ``a`` has one ``b``, and no ``b`` is an ``a``."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    roles = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return roles.where("up > 1 or up = 1 and least = 0").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``); the root is the component's smallest node."""
    edges = common.staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"))
    # Written first: what is read again comes in few tasks, each of which sees many links of a group.
    edges = common.staged(_contracted(edges).distinct())
    while not _settled(edges):
        edges = common.staged(_star(common.staged(_star(edges, True)), False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
