"""Joins that survive hot keys, and connected components by randomized contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A key is hot if it holds more than 1 / HOT_SHARE of all rows; so at most HOT_SHARE keys are ever broadcast.
HOT_SHARE = 1000
#: Edges up to which the driver joins what is left: 16 bytes each.
FEW_EDGES = 1 << 17


def join_hot(left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int, *, share: int = HOT_SHARE, fits: Column | None = None) -> DataFrame:
    """Inner join with right, unique on its keys and telling in column `rows` how many of left's total rows each key has.

    Hot keys, at most `share` of them, are broadcast; the rest are shuffled. fits: which rows of right are narrow
    enough for that, where they are not all.
    """
    hot = F.col(rows) * share > total
    if fits is not None:
        hot = hot & fits
    few = F.broadcast(right.where(hot).drop(rows))
    return left.join(few, on).unionByName(left.join(few.select(*on), on, "left_anti").join(right.where(~hot).drop(rows), on))


def join_few(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, ascending, and the least node that a path joins each with."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return nodes, nodes[np.fromiter(map(find, range(len(nodes))), np.int64, len(nodes))]


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, label) for every node of the edges (a, b), two bigints: nodes have one label exactly if a path joins them.

    Each round points every node to the neighbour (or itself) of least priority, a hash that differs by round, and
    contracts the graph along the pointers; so the number of rounds is logarithmic in expectation for any numbering.
    Every round is written to shared storage. The joins read written tables on both sides, so that adaptive execution
    can split a contracted hub. Once at most `few` edges are left, the driver joins them: the many small rounds at the
    end would cost a few jobs and files each, whatever their size. No edges: no rows.
    """
    edges = materialize(edges.select("a", "b").where("a != b").distinct(), "edges")
    pointers, turn = [], 0
    while edges.count() > few:
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("to"))
        both = edges.select(F.col("a").alias("node"), rank("b").alias("r")).unionByName(edges.select(F.col("b").alias("node"), rank("a").alias("r")))
        point = materialize(both.groupBy("node").agg(F.min("r").alias("r")).select("node", F.least(F.col("r"), rank("node"))["to"].alias("to")), "pointers")
        pointers.append(point)
        ends = edges.join(point.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(point.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = materialize(ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        turn += 1
    left = edges.toArrow()
    nodes, labels = join_few(left["a"].to_numpy(), left["b"].to_numpy())
    final = edges.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "label": pa.array(labels, pa.int64())}), "node bigint, label bigint")
    while pointers:
        later = final.select(F.col("node").alias("to"), F.col("label").alias("onward"))
        final = materialize(pointers.pop().join(later, "to", "left").select("node", F.coalesce("onward", "to").alias("label")), "labels")
    return final
