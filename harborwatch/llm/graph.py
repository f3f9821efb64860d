"""Connected components of links, by large and small stars, on Spark tables only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborwatch.session import staged


def _smaller(edges: DataFrame) -> DataFrame:
    """Each edge once, as (u, v) with v the smaller."""
    return edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """(node, root): the smallest node that each node of the edges (u, v) reaches. Nodes are longs.

    A round hangs the neighbours of every node on the smallest one near it; the number of rounds grows with the
    logarithm of the longest path. Each round is a table in the shared folder, so lineage stays short.
    """
    now = staged(_smaller(edges), label)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _smaller(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(near, "u")
        small = _smaller(near.select("u", F.col("m").alias("v")).unionByName(hung.select(F.col("v").alias("u"), F.col("m").alias("v"))))
        now = staged(small, label)
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if state == seen:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        seen = state


class Joined:
    """Union-find over the links that one task has verified; it only saves work."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, a: int, b: int) -> bool:
        """False if they were joined before."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def group_pairs(starts: np.ndarray, n: int, most: int):
    """(left, right) index arrays of all pairs inside groups of neighbouring rows, about ``most`` pairs at a time."""
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    sums = np.cumsum(place)
    row = 0
    while row < n:
        done = sums[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(sums, done + most, side="right")))
        part = place[row:end]
        right = np.repeat(np.arange(row, end), part)
        left = right - place[right] + (np.arange(len(right)) - np.repeat(np.cumsum(part) - part, part))
        if len(right):
            yield left, right
        row = end
