"""Exact top-k by inner product: ball-tree branch and bound in each shard of the candidates.

A tree node knows the centre c and radius r of its vectors; no inner product with q in it exceeds q.c + |q| r. Nodes are
visited by that bound, largest first, and a query stops at the first bound below its current kth score. That score is
shared: each query first searches one shard, and what it found there is where it starts in all others.

How it scales. Candidates are dealt to shards of bounded size by a hash. A task reads a shard's candidates first, builds
their tree once and then lets the queries pass, a batch at a time, so it holds one shard whatever the number of queries;
very many queries are dealt to blocks, which bounds a task's time. Every query meets every shard once, and only k rows
of it leave a task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pick, ready
from .vectors import finite, matrix

LEAF = 128
OUT = "query_id long, vec_id long, score long"
NONE = -(1 << 62)
KEY = ["dim", "shard", "block"]


class BallTree:
    def __init__(self, rows: np.ndarray):
        self.order = np.arange(len(rows))
        self.centre, self.radius, self.range, self.kids = [], [], [], []
        self.points = rows.astype(np.float64)
        stack = [(0, len(rows), -1, 0)]
        while stack:
            lo, hi, parent, side = stack.pop()
            own = self.points[self.order[lo:hi]]
            centre = own.mean(axis=0)
            away = np.sqrt(((own - centre) ** 2).sum(axis=1))
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(away.max())
            self.range.append((lo, hi))
            self.kids.append([-1, -1])
            if parent >= 0:
                self.kids[parent][side] = node
            if hi - lo > LEAF and away.max() > 0:
                first = own[away.argmax()]
                second = own[((own - first) ** 2).sum(axis=1).argmax()]
                along = own @ (second - first)
                half = np.argpartition(along, len(along) // 2)
                self.order[lo:hi] = self.order[lo:hi][half]
                stack += [(lo, lo + len(along) // 2, node, 0), (lo + len(along) // 2, hi, node, 1)]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No score in a node exceeds its bound, for each query and node; with room for rounding."""
        q = queries.astype(np.float64)
        top = q @ self.centre.T + np.sqrt((q * q).sum(axis=1))[:, None] * self.radius[None, :]
        return top + 1e-9 * (np.abs(top) + 1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class Shard:
    """Candidates of one length with their tree."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.tree = BallTree(rows)
        self.rows, self.ids = rows[self.tree.order], ids[self.tree.order]
        self.largest = int(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
        self.tree.points, self.doubles = None, self.rows.astype(np.float64)

    def search(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The k best scores and ids of each query among the candidates of other ids, best first, smaller id first among
        equals; candidates below the query's floor may be left out."""
        exact = int(np.abs(queries).max(initial=0)) * self.largest < 1 << 52  # products of doubles are exact up to there
        points, asked = (self.doubles, queries.astype(np.float64)) if exact else (self.rows, queries)
        tree, out = self.tree, []
        for i, bound in enumerate(tree.bounds(queries)):
            scores, found, least = np.zeros(0, np.int64), np.zeros(0, np.int64), int(floor[i])
            heap = [(-bound[0], 0)]
            while heap:
                top, node = heapq.heappop(heap)
                if -top < least:
                    break
                a, b = tree.kids[node]
                if a >= 0:
                    heapq.heappush(heap, (-bound[a], a))
                    heapq.heappush(heap, (-bound[b], b))
                    continue
                lo, hi = tree.range[node]
                got = (points[lo:hi] @ asked[i]).astype(np.int64)
                keep = (got >= least) & (self.ids[lo:hi] != own[i])
                if keep.any():
                    scores, found = _best(np.concatenate((scores, got[keep])), np.concatenate((found, self.ids[lo:hi][keep])), k)
                    if len(scores) == k:
                        least = max(least, int(scores[-1]))
            out.append((scores, found))
        return out


def _search(k: int):
    def apply(batches):
        """Rows come by key, the candidates of a key before its queries."""
        key, rows, shard = None, [], None
        for batch in batches:
            marks = np.column_stack([batch.column(c).to_numpy() for c in (*KEY, "asked")])
            if not len(marks):
                continue
            first = np.flatnonzero(np.concatenate(([True], (marks[1:] != marks[:-1]).any(axis=1))))
            for a, b in zip(first, [*first[1:], len(marks)], strict=True):
                part, *at, asked = batch.slice(a, b - a), *marks[a]
                if at != key:
                    key, rows, shard = at, [], None
                if not asked:
                    rows.append(part)
                    continue
                if rows:
                    whole = pa.Table.from_batches(rows)
                    shard, rows = Shard(matrix(whole["v"], np.int64), whole["vec_id"].to_numpy()), []
                if shard is None:
                    continue  # no candidates of this length
                part = pa.Table.from_batches([part])
                own = part["vec_id"].to_numpy()
                got = shard.search(matrix(part["v"], np.int64), own, part["floor"].to_numpy(), k)
                n = [len(s) for s, _ in got]
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(own, n), "vec_id": np.concatenate([i for _, i in got]), "score": np.concatenate([s for s, _ in got])})

    return apply


def _meet(candidates: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each query in the shards that it is sent to."""
    columns = [*KEY, "asked", "vec_id", "v", "floor"]
    both = candidates.withColumns({"asked": F.lit(0), "floor": F.lit(NONE).cast("long")}).select(*columns)
    both = both.unionByName(asked.withColumn("asked", F.lit(1)).select(*columns))
    return both.repartition(*KEY).sortWithinPartitions(*KEY, "asked").mapInArrow(_search(k), OUT)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, shard_rows: int = 16384, block_rows: int = 1 << 17) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows of largest integer inner product, ties to smaller vec_id.

    Components become floor(scale * x). Vectors that are null or hold null, NaN or infinite components, and rows without
    vec_id, take no part; neither do candidates of another length than the query, or of its vec_id. Equal rows of one vec_id are one
    query but count each as a candidate. Fewer candidates than k: all. Empty table: no rows. Scores must fit 64 bits.
    ``is_query`` is a condition on vec_id.
    """
    ready(vectors)
    rows = pick(vectors, vec_id="vec_id", embedding="embedding").select(F.col("vec_id").cast("long"), "embedding")
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = cut(rows.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select("vec_id", whole.alias("v"), F.size("embedding").alias("dim")))
    asked = rows.where(is_query).distinct()
    shards, blocks = max(1, -(-rows.count() // shard_rows)), max(1, -(-asked.count() // block_rows))
    hashed = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    candidates = rows.withColumn("shard", hashed(shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", hashed(blocks)).withColumn("home", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int"))
    home = cut(_meet(candidates, asked.withColumns({"shard": F.col("home"), "floor": F.lit(NONE).cast("long")}), k))
    if shards > 1:
        kth = home.groupBy("query_id").agg(F.when(F.count("score") >= k, F.min("score")).alias("kth"))
        others = (
            asked.join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
            .withColumn("floor", F.coalesce("kth", F.lit(NONE).cast("long")))
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
            .where("shard <> home")
        )
        home = home.unionByName(_meet(candidates, others, k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return home.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
