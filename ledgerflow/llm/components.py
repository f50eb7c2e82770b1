"""Connected components of a link table, by star contraction on DataFrames.

Links never reach the driver: it only sees whether a round left anything to do. The
smallest neighbour of each node comes from a partial aggregate that is written and joined
back: adaptive skew joins split a hub's links only where both sides come straight from a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import Workspace

#: Links that one task contracts at once before it passes a forest on.
FOREST_LINKS = 500_000
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) for every node of the links that isn't the smallest itself."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0

    def out() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        x, y = forest(table.column("a").to_numpy(), table.column("b").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], schema=_PAIR)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= FOREST_LINKS:
            yield out()
            held, rows = [], 0
    if held:
        yield out()


def contract(links: DataFrame) -> DataFrame:
    """Each task's links as a forest with the same components: at most one link for each node it has seen."""
    return links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b").mapInArrow(_contract, "a long, b long")


def connected_components(work: Workspace, links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node it reaches.

    Nulls and self-links are ignored, repeated links count once, an empty table gives an empty result.
    """
    edges = work.save(contract(links).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = work.save(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = work.save(large, "large")
        work.drop(low)
        low = work.save(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        pairs = large.join(low, "a")
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(pairs.select("a", F.col("m").alias("b"))).distinct()
        stars = work.save(small, "small")
        for done in (edges, large, low):
            work.drop(done)
        edges = stars
        many = edges.groupBy("a").count().where("count > 1")
        #: Nodes that links lead to and from; a hub is one row of each task before they meet.
        chained = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a").distinct(), "a", "left_semi")
        if not many.select("a").unionByName(chained).take(1):
            break
    own = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)
