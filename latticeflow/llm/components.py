"""Connected components of a graph of long ids by alternating large and small stars.

Every round replaces the edges by stars towards the smallest neighbour and is written to the shared folder; no edge
or label comes to the driver, only a count and a checksum that show when nothing changes any more.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest reachable index of each of ``n`` nodes under the links ``i``-``j``."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label[label] != label).any():
            label = label[label]
        left = label[i] != label[j]
        i, j = i[left], j[left]
    return label


def _star(edges: DataFrame, scratch: Scratch, table: str, *, large: bool) -> DataFrame:
    """Large: every node sends its larger neighbours to its smallest; small: the smaller ones and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = scratch.put(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{table}-least")
    near = both.join(least, "a")
    sent = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        sent = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return scratch.put(sent.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), table)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``root`` (the smallest id reachable) of each node with an edge, roots included.

    ``edges`` has the long columns ``a`` and ``b`` without nulls; loops and repeated edges do no harm.
    """
    now = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, k = None, 0
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == before:
            break
        before, k = state, k + 1
        wide = _star(now, scratch, f"large{k}", large=True)
        now = _star(wide, scratch, f"small{k}", large=False)
        scratch.drop(f"large{k}", f"large{k}-least", f"small{k}-least", f"small{k - 1}", *(["edges"] if k == 1 else []))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
