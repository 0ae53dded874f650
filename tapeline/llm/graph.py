"""Connected components of a graph of any size, by large-star and small-star rounds.

Edges are rows; each round is two groupings with pre-aggregated minima and two joins, and its result goes to the
shared checkpoint folder. A hub is pre-aggregated before its rows move. The number of rounds grows with the logarithm of the
longest path. Only the number of edges that changed comes to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


SALTS = 4


def salted_join(rows: DataFrame, one_each: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join with a table that has each key once. A hot key's rows go to several tasks, by a hash of ``spread``,
    and what remains uneven can be split by adaptive execution, as both sides are shuffled for this join."""
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    every = one_each.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("_salt", salt).join(every, [key, "_salt"]).drop("_salt")


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Small star: a node's smaller neighbours and itself go to the smallest of them. Large star: its larger
    neighbours do."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # here b is the centre's neighbour and a the centre
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = salted_join(both, least, "a", "b")
    if small:
        out = moved.select(F.col("b").alias("x"), "m").unionByName(moved.select(F.col("a").alias("x"), "m"))
    else:
        out = moved.where("b > a").select(F.col("b").alias("x"), "m")
    return out.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: every node of an edge (a, b), and the smallest node that it reaches.

    Loops, repeated edges and both directions are fine; an edge with a null is none. No edges: no rows.
    """
    now = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    for _ in range(rounds):
        # the count and the sum of the ends tell a fixed point: ends only ever fall
        before = _state(now)
        now = cut(_star(_star(now, small=False), small=True))
        if _state(now) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
    raise RuntimeError(f"the components were not found in {rounds} rounds")


def _state(edges: DataFrame) -> tuple:
    d = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(d)).first())


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Among nodes 0..n-1 with edges (a, b): each node that isn't its component's least, and that least one."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]
