"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


#: The part of all rows from which on a key's rows are too many for one task.
HOT = 0.001


def join_sized(rows: DataFrame, other: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined (inner) with other, which has each key once and knows in ``size`` how many of ``total`` rows have it.

    Keys with more than ``HOT`` of all rows, of which there are 1 / HOT at most, are sent to all workers; their rows stay where they are.
    """
    hot = other.where(F.col(size) > HOT * total)
    cold = other.where(F.col(size) <= HOT * total)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label): the least id of the component of each node of the edges (u, v); loops and nulls are left out.

    Each round is a few shuffles of the edges; rounds grow with the logarithm of the longest path.
    """
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = shared.write_table(e, folder, "edges-0")
    state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    step = 0
    while state[0]:
        step += 1
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = shared.write_table(small, folder, f"edges-{step}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == tuple(state):
            break
        state = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
