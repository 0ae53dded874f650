"""SimHash fingerprints and near-duplicate groups, by a self-join of the fingerprints' binary trie.

Pairs of trie nodes are traversed together: a pair carries the number of bits in which its two prefixes differ, its
children are the pairs of their children, and a pair beyond the budget is dropped with all below it.

The top of the trie is traversed in Spark: a table of pairs of prefixes, joined level by level with the table of the
nodes that exist. A pair leaves this table when it holds few enough fingerprints (or the prefix is whole); the rest
of its traversal is done in one task, on all pairs of ranges of a depth at once. So a crowded part of the trie is split
further and no task gets more than ``task_rows`` fingerprints of a side. Equal fingerprints are one node (their documents are
joined to it at the end), a task sends the links of a spanning forest, and components are found by ``graph``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, ready
from .graph import components, forest, salted_join

STEP_BITS = 4
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - width + 1].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(line[s:e], seed) for s, e in zip(start, end[width - 1 :].tolist(), strict=True)), np.uint64, len(start))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):  # long texts in parts
        part = hashes[i : i + (1 << 15)]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(width: int, seed: int):
    def apply(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            out = np.fromiter((fingerprint(shingle_hashes(x.as_py() or b"", width, seed)) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": out.view(np.int64)})

    return apply


def simhash(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp: the 64-bit fingerprint of each whole text, as a signed long; 0 for a text without words or null."""
    ready(docs)
    docs = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_fingerprints(width, seed), "doc_id long, fp long")


def trie_pairs(a: np.ndarray, b: np.ndarray, depth: int, differ: int, budget: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted arrays a and b (uint64, without repeats, each of one prefix of ``depth`` bits that differ in
    ``differ``) whose values differ in at most ``budget`` bits. same: a is b; each pair once, none with itself."""
    lo_a, hi_a = np.array([0]), np.array([len(a)])
    lo_b, hi_b = np.array([0]), np.array([len(b)])
    bits = np.array([differ])
    twin = np.array([same])  # pairs of a node with itself
    found_a, found_b = [], []
    for level in range(depth, 64):
        rows = (hi_a - lo_a) * (hi_b - lo_b)
        small = rows <= 16
        if small.any():
            x, y = _flat(lo_a[small], hi_a[small], lo_b[small], hi_b[small])
            near = np.bitwise_count(a[x] ^ b[y]) <= budget
            if same:  # the two orders of a pair of nodes aren't both traversed
                near &= x < y
            found_a.append(x[near])
            found_b.append(y[near])
            big = ~small
            lo_a, hi_a, lo_b, hi_b, bits, twin = lo_a[big], hi_a[big], lo_b[big], hi_b[big], bits[big], twin[big]
        if not len(lo_a):
            break
        shift = np.uint64(63 - level)
        mid_a, mid_b = _split(a, lo_a, hi_a, shift), _split(b, lo_b, hi_b, shift)
        part = []
        for xa, ya, xb, yb, more in ((lo_a, mid_a, lo_b, mid_b, 0), (mid_a, hi_a, mid_b, hi_b, 0), (lo_a, mid_a, mid_b, hi_b, 1), (mid_a, hi_a, lo_b, mid_b, 1)):
            keep = (ya > xa) & (yb > xb) & (bits + more <= budget)
            if more and xa is mid_a:
                keep &= ~twin  # its mirror image
            part.append((xa[keep], ya[keep], xb[keep], yb[keep], bits[keep] + more, twin[keep] & (more == 0)))
        lo_a, hi_a, lo_b, hi_b, bits, twin = (np.concatenate(x) for x in zip(*part, strict=True))
    if len(lo_a):  # whole values: each range is one of them
        keep = lo_a < lo_b if same else np.ones(len(lo_a), bool)
        found_a.append(lo_a[keep])
        found_b.append(lo_b[keep])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(found_a), cat(found_b)


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, shift: np.uint64) -> np.ndarray:
    """Where the bit turns to 1 in each range of equal higher bits."""
    edge = ((values[lo] >> shift) | np.uint64(1)) << shift
    return np.clip(np.searchsorted(values, edge), lo, hi)


def _flat(lo_a, hi_a, lo_b, hi_b) -> tuple[np.ndarray, np.ndarray]:
    wide = hi_b - lo_b
    rows = (hi_a - lo_a) * wide
    which = np.repeat(np.arange(len(rows)), rows)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(rows) - rows, rows)
    return lo_a[which] + nth // wide[which], lo_b[which] + nth % wide[which]


def _links(budget: int):
    def links(batch: pa.Table) -> pa.Table:
        left, right, depth, differ = (batch[c][0].as_py() for c in ("left", "right", "depth", "differ"))
        fp, side = batch["fp"].to_numpy().view(np.uint64), batch["side"].to_numpy()
        a = np.sort(fp[side == 0])
        same = left == right
        b = a if same else np.sort(fp[side == 1])
        x, y = trie_pairs(a, b, depth, differ, budget, same)
        child, root = forest(x, y if same else y + len(a), len(a) + (0 if same else len(b)))
        every = a if same else np.concatenate((a, b))
        return pa.table({"a": every[child].view(np.int64), "b": every[root].view(np.int64)})

    return links


def _prefix(depth: int):
    """The first bits of fp, as a long; the whole at 64."""
    return F.col("fp") if depth == 64 else F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")


def _task(fps: DataFrame, pairs: DataFrame, depth: int, more: tuple[str, ...] = ()) -> DataFrame:
    """The fingerprints of both sides of each pair of nodes, and columns more of theirs."""
    side = pairs.select("left", "right", "differ")
    rows = fps.select("fp", *more, _prefix(depth).alias("left"))
    first = side.join(rows, "left").select("left", "right", "differ", "fp", *more, F.lit(0).alias("side"))
    rows = fps.select("fp", *more, _prefix(depth).alias("right"))
    second = side.where("left <> right").join(rows, "right").select("left", "right", "differ", "fp", *more, F.lit(1).alias("side"))
    return first.unionByName(second).withColumn("depth", F.lit(depth))


def _children(fps: DataFrame, pairs: DataFrame, depth: int, budget: int) -> DataFrame:
    """Pairs of children of pairs of nodes of this depth, within the budget."""
    nodes = fps.groupBy(_prefix(depth + STEP_BITS).alias("node")).agg(F.count(F.lit(1)).alias("rows"))
    up = F.shiftrightunsigned("node", STEP_BITS) if depth else F.lit(0).cast("long")
    left = nodes.select(up.alias("left"), F.col("node").alias("l_node"), F.col("rows").alias("l_rows"))
    right = nodes.select(up.alias("right"), F.col("node").alias("r_node"), F.col("rows").alias("r_rows"))
    more = F.bit_count(F.col("l_node").bitwiseXOR(F.col("r_node")).bitwiseAND(F.lit((1 << STEP_BITS) - 1)))
    return (
        pairs.select("left", "right", "differ")
        .join(left, "left")
        .join(right, "right")
        .where("left <> right or l_node <= r_node")
        .select(F.col("l_node").alias("left"), F.col("r_node").alias("right"), (F.col("differ") + more).cast("int").alias("differ"), "l_rows", "r_rows")
        .where(F.col("differ") <= budget)
    )


def near_links(fps: DataFrame, budget: int = 2, task_rows: int = 32768, links=None, more: tuple[str, ...] = ()) -> DataFrame:
    """a, b: links that join all fingerprints (column fp, different ones) within ``budget`` bits; their components are
    those of all links. ``links`` is another function for the tasks, which also get the columns ``more`` of fps."""
    zero = F.lit(0).cast("long")
    pairs = fps.agg(zero.alias("left"), zero.alias("right"), F.lit(0).alias("differ"), F.count(F.lit(1)).alias("l_rows"), F.count(F.lit(1)).alias("r_rows"))
    large = F.greatest("l_rows", "r_rows") > task_rows
    tasks = None
    for depth in range(0, 65, STEP_BITS):
        small = pairs if depth == 64 else pairs.where(~large)
        task = _task(fps, small, depth, more)
        tasks = task if tasks is None else tasks.unionByName(task)
        if depth == 64 or not pairs.where(large).head(1):
            break
        pairs = cut(_children(fps, pairs.where(large), depth, budget))
    return tasks.groupBy("depth", "left", "right").applyInArrow(links or _links(budget), "a long, b long")


def simhash_groups(docs: DataFrame, budget: int = 2, width: int = 3, seed: int = 42, task_rows: int = 32768) -> DataFrame:
    """doc_id, fp, component_id: fingerprint and the smallest doc_id that links of at most ``budget`` bits reach.

    Texts without words, or null, share fingerprint 0 and so one group. Rows of equal doc_id are rows of their own. A
    null doc_id gives a row too, and is never a component's id unless all its ids are null. Empty table: no rows.
    """
    marked = cut(simhash(docs, width, seed))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(near_links(fps.select("fp"), budget, task_rows))
    rooted = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(salted_join(rooted.select("fp", "root"), whole, "root", "fp").select("fp", "component_id"))
    # exact copies share a fingerprint, so its rows are spread
    return salted_join(marked, named, "fp", "doc_id").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, budget: int = 2) -> DataFrame:
    """The rows of docs that come first in their group: smallest doc_id, and one row of it if it is repeated."""
    groups = simhash_groups(docs, budget)
    keep = groups.where("doc_id = component_id").select("doc_id").distinct()
    ids = docs.where("doc_id is not null")
    return ids.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
