"""Near copies: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

1. Marks. A document gets the SimHash fingerprint of its shingles and ``BANDS`` keys, each made of ``ROWS`` min-hashes of
   their set. Documents of one fingerprint are one node.
2. Neighbourhoods. Nodes that share a key are linked to the least of them, a row for each node and key, and the components of these
   links are found by ``graph``. They play the part of the trie's top levels: without them the trie of a budget of 18 bits
   prunes nothing before its depth, and its work grows with the square of the corpus.
3. Trie join. In each neighbourhood the fingerprints' trie is joined with itself (``simhash.trie_pairs``) within the budget,
   and the pairs are checked exactly on their shingle sets, from the node with the nearest neighbours on; pairs that are in one
   group already are left out, as they can't change it. A task sends the links of a spanning forest.

How it scales. A node's shingles go to one task, unless its neighbourhood is larger than ``block_rows`` nodes or ``block_shingles``
shingles: it is then cut into blocks, and a task gets two of them. Pairs are never rows. In a crowd of near copies that
aren't all alike the comparisons, though not the rows, grow with its square, spread over the pairs of blocks.

Recall. A pair of similarity 0.8 shares a key with a chance of 1 - (1 - 0.8^5)^16 = 0.998, and differs in at most 18 of 64
bits with 0.999; both are higher for more similar pairs. Whatever passes is checked exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, pick, ready, shuffle_partitions
from .graph import components, salted_join
from .simhash import fingerprint, shingle_hashes, trie_pairs

BANDS, ROWS = 16, 5
#: Odd multipliers, one for each min-hash; a key also tells its band.
TURNS = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PART = 1 << 13
SET = "unit long, one boolean, blocks int, block int, place long, fp long"


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of a set that isn't empty."""
    least = np.full(len(TURNS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), PART):  # long texts in parts
        np.minimum(least, (TURNS[:, None] * hashes[None, i : i + PART]).min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def _marks(width: int, seed: int):
    def apply(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps, n, keys = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int32), []
            for i, x in enumerate(texts):
                hashes = shingle_hashes(x.as_py() or b"", width, seed)
                fps[i] = fingerprint(hashes)
                hashes = np.unique(hashes)
                n[i] = len(hashes)
                keys.append(band_keys(hashes) if len(hashes) else hashes.view(np.int64))
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "doc_id": batch.column("doc_id"), "fp": fps.view(np.int64), "n": n, "bands": pa.array(keys, pa.list_(pa.int64()))})

    return apply


def _sets(width: int, seed: int):
    def apply(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            sets = [np.unique(shingle_hashes(x.as_py() or b"", width, seed)).view(np.int64) for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.list_(pa.int64()))], [*batch.schema.names[:-1], "shingles"])

    return apply


def exact_groups(x: np.ndarray, y: np.ndarray, near: np.ndarray, values: np.ndarray, start: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """Roots of sets (of values from start on, n each) after joining the pairs (x, y) that are similar enough, nearest to most others first."""
    root = np.arange(len(n))
    weight = np.bincount(x, near, len(n)) + np.bincount(y, near, len(n))
    swap = weight[y] > weight[x]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    order = np.lexsort((x, -weight[x]))
    x, y = x[order], y[order]
    held = np.zeros(int(values.max(initial=-1)) + 1, bool)
    edges = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else x
    for a, b in zip(edges, [*edges[1:], len(x)], strict=True):
        one, own = x[a], y[a:b]
        own = own[root[own] != root[one]]
        held[values[start[one] : start[one] + n[one]]] = True
        for i in range(0, len(own), 1024):
            some = own[i : i + 1024]
            at = np.cumsum(n[some])
            inner = np.arange(at[-1]) - np.repeat(at - n[some], n[some])
            seen = np.concatenate(([0], np.cumsum(held[values[np.repeat(start[some], n[some]) + inner]])))
            common = seen[at] - seen[at - n[some]]
            good = some[common >= similarity * (n[some] + n[one] - common)]
            if len(good):
                root[np.isin(root, np.append(root[good], root[one]))] = min(root[good].min(), root[one])
        held[values[start[one] : start[one] + n[one]]] = False
    return root


def _links(budget: int, similarity: float):
    def links(batch: pa.Table) -> pa.Table:
        low, high = batch["low"][0].as_py(), batch["high"][0].as_py()
        order = np.argsort(batch["fp"].to_numpy().view(np.uint64))
        batch = batch.take(order)
        fp, block, place = batch["fp"].to_numpy().view(np.uint64), batch["block"].to_numpy(), batch["place"].to_numpy()
        sets = batch["shingles"].combine_chunks()
        n = sets.value_lengths().to_numpy().astype(np.int64)
        left = np.flatnonzero(block == low)
        right = left if low == high else np.flatnonzero(block == high)
        x, y = trie_pairs(fp[left], fp[right], 0, 0, budget, low == high)
        x, y = left[x], right[y]
        small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        keep = (place[x] == place[y]) & (small > 0) & (small >= similarity * large)
        x, y = x[keep], y[keep]
        some = np.unique(np.concatenate((x, y)))
        if not len(some):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        near = (budget + 1 - np.bitwise_count(fp[x] ^ fp[y])).astype(np.float64)
        values = np.unique(sets.take(pa.array(some)).flatten().to_numpy(), return_inverse=True)[1]
        n = n[some]
        root = exact_groups(np.searchsorted(some, x), np.searchsorted(some, y), near, values, np.cumsum(n) - n, n, similarity)
        child = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": fp[some[child]].view(np.int64), "b": fp[some[root[child]]].view(np.int64)})

    return links


def near_copies(docs: DataFrame, key: str, width: int = 5, similarity: float = 0.8, budget: int = 18, seed: int = 42, block_rows: int = 2048, block_shingles: int = 1 << 21) -> DataFrame:
    """fp, first, component: each fingerprint, its first row (struct of none, doc_id, row), and the row of its group that stays.

    Groups are the components of the pairs within ``budget`` bits whose shingle sets have a Jaccard similarity of at
    least ``similarity``. Rows of one fingerprint are one node: equal sets, or such as all 64 bits agree on. Texts without words
    share a group. The row of smallest doc_id stays, null last, ties by ``key``, a column that names rows. Rows of equal doc_id are rows
    of their own; rows of one key are copies of each other. Empty table: no rows.
    """
    spark = ready(docs)
    docs = pick(docs, row=key, doc_id="doc_id", text="text").select("row", F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marked = docs.mapInArrow(_marks(width, seed), "row long, doc_id long, fp long, n int, bands array<long>")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = cut(marked.groupBy("fp").agg(F.min(first).alias("first"), F.min_by("n", first).alias("n"), F.min_by("bands", first).alias("bands")))
    keys = nodes.select("fp", F.explode("bands").alias("band"))
    heads = keys.groupBy("band").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1").select("band", "least")
    places = components(salted_join(keys, heads, "band", "fp").select(F.col("fp").alias("a"), F.col("least").alias("b")))
    placed = cut(nodes.select("fp", F.col("first.row").alias("row"), "n").join(places.toDF("fp", "place"), "fp"))
    sizes = placed.groupBy("place").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block_rows, F.sum("n") / block_shingles)).cast("int").alias("blocks"), F.sum("n").alias("total"))
    sizes = cut(sizes)
    # neighbourhoods of one block share a task
    small = sizes.where("blocks = 1").agg(F.sum("total"), F.count(F.lit(1))).first()
    bins = max(shuffle_partitions(spark), -(-(small[0] or 0) // block_shingles))
    unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("place"), F.lit(bins))).otherwise(F.col("place"))
    dealt = (
        salted_join(placed, sizes.drop("total"), "place", "fp")
        .withColumns({"unit": unit, "one": F.col("blocks") == 1, "block": F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")})
    )
    texts = docs.select("row", "text").join(dealt, "row").dropDuplicates(["fp"])
    sets = texts.select("unit", "one", "blocks", "block", "place", "fp", "text").mapInArrow(_sets(width, seed), f"{SET}, shingles array<long>")
    pairs = (
        cut(sets)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("unit", "one", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "place", "fp", "shingles")
    )
    found = components(pairs.groupBy("unit", "one", "low", "high").applyInArrow(_links(budget, similarity), "a long, b long"))
    rooted = cut(nodes.select("fp", "first").join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    whole = rooted.groupBy("root").agg(F.min("first")["row"].alias("component"))
    return salted_join(rooted, whole, "root", "fp").select("fp", "first", "component")


def keep_first(docs: DataFrame, key: str, **settings) -> DataFrame:
    """One row of docs, all columns, for each group of near copies."""
    keep = near_copies(docs, key, **settings).select(F.col("component").alias(key)).distinct()
    return docs.join(keep, key, "left_semi").dropDuplicates([key])
