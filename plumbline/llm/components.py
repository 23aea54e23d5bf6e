"""Connected components of an edge table by alternating large-star and small-star rounds.

Only joins, unions and aggregations: nothing is collected, the minimum per
vertex combines before its shuffle, and a vertex with very many neighbours is
looked up apart (:func:`spread_join`).  Each round is written to the shared
folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise, release


HOT_SHARE, HOT_LEAST = 10_000, 1_000


def spread_join(rows: DataFrame, table: DataFrame, key: str, count: str = "n") -> DataFrame:
    """``rows`` joined with ``table``, which has one row per ``key`` and its number of ``rows`` in ``count``.

    A key with over a 10,000th of the rows (and over 1,000) is looked up in a
    broadcast of such keys, under 10,000 by their definition, so its rows stay
    where they are; the others meet in a shuffled join.
    """
    total, most = table.agg(F.sum(count), F.max(count)).first()
    limit = max(HOT_LEAST, (total or 0) // HOT_SHARE)
    if (most or 0) <= limit:
        return rows.join(table.drop(count), key)
    is_hot = F.col(count) > limit
    hot = F.broadcast(table.filter(is_hot).drop(count))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(table.filter(~is_hot).drop(count), key))


def _stamp(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every vertex of ``edges`` (u, v); component is its smallest vertex.

    Loops and edges with a null end are ignored; repeated edges and either
    direction are fine; no edges give no rows.
    """
    now = materialise(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
    )
    stamp = _stamp(now)
    while stamp[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "cc-least")
        large = materialise(spread_join(both, least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "cc-least")
        small = spread_join(large, low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = materialise(small.select("e.u", "e.v").filter("u <> v").distinct(), "cc")
        release(now, least, large, low)
        last, stamp = stamp, _stamp(after)
        now = after
        if stamp == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


class Roots:
    """Smallest member of each component of the vertices 0 to n - 1; links are folded in as they come."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Link ``i[k]`` with ``j[k]``."""
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            np.minimum.at(self.root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up
