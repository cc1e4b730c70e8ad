"""Connected components of a link table by alternating large and small stars.

Links are laid in partitions of about LOCAL links, each contracted in its task by
union-find to links to its least nodes; one partition is then the answer. Else a
round replaces links by links to smaller neighbours (two joins and two partial
aggregates), cut by checkpoint(), and contracts again. A hub's minimum is
pre-aggregated before the shuffle and its links are ordinary join rows that AQE
can split. The driver sees only a count and a checksum per round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Links that a task contracts at a time, 16 bytes each.
LOCAL = 250_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node reachable) of the links (a, b), without self-links."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hook the larger root below the smaller one, then flatten
        x, y = root[left], root[right]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (flat := root[root]).tobytes() != root.tobytes():
            root = flat
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
    if held:
        a, b = contract(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """pairs (u, v): link u's neighbours to the smallest of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = pairs.join(least, "u")
    if small:
        out = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.union(least.where("u <> m").select("u", "m")).distinct()
    return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs -> (node, component), component the smallest node
    reachable. Nodes without links don't appear; self-links and nulls are dropped."""
    edges = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _mark(edges)
    while before[0]:
        parts = -(-before[0] // LOCAL)
        edges = checkpoint(edges.coalesce(parts).mapInArrow(_contract, "a long, b long"))
        if parts == 1:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        large = _star(both, small=False)
        edges = checkpoint(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), small=True))
        now = _mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
