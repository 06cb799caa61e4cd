"""Connected components by contraction, with no step that gathers a component.

Each round maps every vertex to the smallest vertex of its closed neighbourhood
under an order that changes from round to round (``id XOR constant``), then
relabels the edges and drops loops.  Stars contract in the first round and
chains by a constant factor in each later one, so the rounds grow with the
logarithm of the longest chain.  A hub is a hot key only in equi-joins whose
other side is unique, which adaptive execution splits.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def local_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the graph with edges (u, v): vertices and the smallest
    vertex of each one's component.  Linear in the edges per sweep."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each end of ``edges`` (u long, v long); roots are
    arbitrary but equal within a component.  No rows for an empty table."""
    rng = random.Random(7)
    pair = lambda a, b: [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]
    left = scratch.write(edges.where("u <> v").select(*pair(F.col("u"), F.col("v"))).distinct(), "edges")
    maps: list[DataFrame] = []
    flip = 0
    while not left.isEmpty():
        order = lambda c, k=flip: F.col(c).bitwiseXOR(F.lit(k).cast("long"))
        both = left.select("u", "v").union(left.select("v", "u"))
        rep = both.groupBy("u").agg(F.min(order("v")).alias("m")).select(F.col("u").alias("node"), F.least("m", order("u")).bitwiseXOR(F.lit(flip).cast("long")).alias("root"))
        rep = scratch.write(rep, "map")
        to = lambda side: rep.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        moved = left.join(to("u"), "u").join(to("v"), "v").where("u_root <> v_root").select(*pair(F.col("u_root"), F.col("v_root"))).distinct()
        following = scratch.write(moved, "edges")
        scratch.drop(left)
        left, flip = following, rng.getrandbits(62)
        maps.append(rep)
    if not maps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = maps[0]
    for step in maps[1:]:
        nxt = step.select(F.col("node").alias("root"), F.col("root").alias("later"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return scratch.write(out, "components")
