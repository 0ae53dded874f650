"""Near-duplicate vectors: spherical k-means cells, blocked cosine products in each cell, one row of a group kept.

Equal vectors of a label are one node with a count, made before anything is shuffled by cell. The centres are fitted on a
bounded sample of nodes (``sample_rows``); every node is then assigned to its nearest centre, its home, and looked for
also in the cells whose centre is nearly as close (``margin``), as the other end of a link may have its home there. A pair is
judged in one cell only, so links are counted once. Measured recall is in the README.

How it scales. The number of cells grows with the nodes. The cells of a label are put into groups that a task holds (``held_bytes``),
a cell that is more is cut into several; a node goes to the group of its home, and once, as a guest, to each other group that has a cell where it's
looked for. Guests stream past what is held. So a node is copied as often as its label has groups, at most, however many
cells it's looked for in, and a label with a third of all rows becomes many tasks. Products are made in blocks of ``block_rows``. A task sends sums of links and a spanning
forest, never pairs; components are found by ``graph``.
"""

from __future__ import annotations

from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, ready, shuffle_partitions
from .graph import components, forest, salted_join
from .vectors import finite, matrix

FOUND = "kind int, a long, b long"
DEALT = "part int, label string, dim int, grp int, guest boolean, own int, node long, copies long, home int, cells binary, embedding array<{kind}>"
#: Held nodes that are judged among themselves at a time; those that stream past come in Spark's batches.
BATCH = 8192
#: In how many groups at most a key is cut for more tasks alone; each may take a copy of the key's nodes.
SPREAD = 8


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(rows: np.ndarray, k: int, turns: int = 12, seed: int = 11) -> np.ndarray:
    """Unit centres; an empty cell takes the row that fits its own centre worst."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(turns):
        fit = rows @ centres.T
        cell, best = fit.argmax(axis=1), fit.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, rows)
        size = np.sqrt((sums * sums).sum(axis=1))
        poor = iter(np.argsort(best))
        for c in np.flatnonzero(size < 1e-12):
            sums[c], size[c] = rows[next(poor)], 1.0
        centres = sums / size[:, None]
    return centres


def _near(rows: np.ndarray, centres: np.ndarray | None, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of unit rows, and for each cell whether a row is looked for there, its home included."""
    fit = rows @ centres.T if centres is not None else np.zeros((len(rows), 1))
    return fit.argmax(axis=1).astype(np.int32), fit >= fit.max(axis=1, keepdims=True) - margin


def _parts(batch: pa.RecordBatch, centres: dict[int, np.ndarray], margin: float):
    """The rows of a batch by length of their vectors, with their homes and cells."""
    dims = batch["dim"].to_numpy()
    for dim in np.unique(dims):
        part = pa.Table.from_batches([batch]).take(np.flatnonzero(dims == dim))
        yield int(dim), part, *_near(_unit(matrix(part["embedding"], np.float64)), centres.get(int(dim)), margin)


def _homes(centres: dict[int, np.ndarray], margin: float, large: set[tuple[str, int]]):
    """How many nodes of the large keys have their home in each cell."""

    def apply(batches):
        for batch in batches:
            for dim, part, home, _ in _parts(batch, centres, margin):
                label = part["label"].to_numpy(zero_copy_only=False)
                for own in part["label"].unique().to_pylist():
                    if (own, dim) in large:
                        cell, count = np.unique(home[label == own], return_counts=True)
                        yield pa.RecordBatch.from_pydict({"label": [own] * len(cell), "dim": pa.array([dim] * len(cell), pa.int32()), "home": cell, "n": count})

    return apply


class Layout:
    """The cells of a key in groups of at most ``held`` nodes; a cell of more is cut into groups of its own."""

    def __init__(self, cells: int, counts: dict[int, int], held: int):
        self.first, self.parts, self.groups = np.zeros(cells, np.int64), np.zeros(cells, np.int64), 0
        room = 0
        for cell, n in sorted(counts.items()):
            self.parts[cell] = -(-n // held)
            if self.parts[cell] > 1 or n > room:
                self.first[cell], self.groups, room = self.groups, self.groups + self.parts[cell], held if self.parts[cell] == 1 else 0
            else:
                self.first[cell] = self.groups - 1
            room -= min(n, room)
        self.groups = int(self.groups)
        group = np.arange(self.groups)
        self.within = ((group >= self.first[:, None]) & (group < (self.first + self.parts)[:, None])).astype(np.float32)


def _deal(centres: dict[int, np.ndarray], margin: float, layouts: dict[tuple[str, int], tuple[int, Layout]]):
    """Each node once in the group of its home, and once, as a guest, in each other group that has one of its cells."""

    def rows(part, at, where, grp, guest, own, cells, home):
        taken = part.select(["label", "dim", "node", "copies", "embedding"]).take(at)
        width = cells.shape[1]
        offsets = np.arange(len(at) + 1, dtype=np.int32) * width
        packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(cells[at]))])
        full = {
            "part": pa.array(where, pa.int32()), "label": taken["label"], "dim": taken["dim"], "grp": pa.array(grp, pa.int32()), "guest": pa.array(np.full(len(at), guest)), "own": pa.array(own, pa.int32()),
            "node": taken["node"], "copies": taken["copies"], "home": pa.array(home[at], pa.int32()), "cells": packed, "embedding": taken["embedding"],
        }
        return pa.table(full).to_batches()

    def apply(batches):
        for batch in batches:
            for dim, part, home, near in _parts(batch, centres, margin):
                cells = np.packbits(near, axis=1)
                label, where, node = part["label"].to_numpy(zero_copy_only=False), part["spread"].to_numpy(), part["node"].to_numpy()
                rest = np.ones(len(label), bool)
                for own in part["label"].unique().to_pylist():
                    if (own, dim) not in layouts:
                        continue
                    base, layout = layouts[own, dim]
                    at = np.flatnonzero(label == own)
                    rest[at] = False
                    group = layout.first[home[at]] + (node[at] >> 8) % np.maximum(layout.parts[home[at]], 1)
                    yield from rows(part, at, base + group, group, False, group, cells, home)
                    visits = near[at].astype(np.float32) @ layout.within > 0
                    visits[np.arange(len(at)), group] = False
                    x, g = np.nonzero(visits)
                    for begin in range(0, len(x), len(label)):
                        of, to = x[begin : begin + len(label)], g[begin : begin + len(label)]
                        yield from rows(part, at[of], base + to, to, True, group[of], cells, home)
                at = np.flatnonzero(rest)
                if len(at):
                    none = np.zeros(len(at), np.int32)
                    yield from rows(part, at, where[at], none, False, none, cells, home)

    return apply


class _Rows:
    """Nodes as arrays."""

    def __init__(self, part: pa.Table):
        self.node, self.copies, self.home, self.own, self.grp = (part[c].to_numpy() for c in ("node", "copies", "home", "own", "grp"))
        self.cells = np.frombuffer(b"".join(part["cells"].to_pylist()), np.uint8).reshape(len(part), -1)
        self.vectors = matrix(part["embedding"], None)

    def has(self, row, cell) -> np.ndarray:
        """Whether rows are looked for in cells."""
        return (self.cells[row, cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)

    def take(self, at) -> _Rows:
        out = copy(self)
        for name, values in vars(self).items():
            setattr(out, name, values[at])
        return out


class _Task:
    """A group's nodes, held, and the links of what streams past them."""

    def __init__(self, threshold: float, block_rows: int, put):
        self.threshold, self.block_rows, self.put = threshold, block_rows, put
        self.came, self.home, self.ready = [], None, False

    def take(self, part: pa.RecordBatch) -> None:
        guest = part["guest"].to_numpy(zero_copy_only=False)
        n = int(np.count_nonzero(~guest))
        if n:
            self.came.append(part.slice(0, n))
        if n < len(guest):
            self._settle()
            self._judge(_Rows(pa.Table.from_batches([part.slice(n)])))

    def _settle(self) -> None:
        """All homes have come: they are judged among themselves."""
        if self.ready:
            return
        self.ready = True
        if self.came:
            held, self.came = _Rows(pa.Table.from_batches(self.came)), []
            self.home = held = held.take(np.argsort(held.home, kind="stable"))
            self.root, self.links = np.arange(len(held.node)), np.zeros(len(held.node), np.int64)
            self.ranges = [(c, *np.searchsorted(held.home, [c, c + 1])) for c in np.unique(held.home)]
            for begin in range(0, len(held.node), BATCH):
                self._judge(held.take(slice(begin, begin + BATCH)), begin)

    def _judge(self, rows: _Rows, inside: int | None = None) -> None:
        """Links of some rows with the homes. ``inside``: the rows are homes themselves, from this place on.

        A pair meets where one is at home and the other is looked for; if that holds both ways, the lesser place counts it.
        """
        held, size = self.home, self.block_rows
        if held is None:
            return
        unit, links, a_found, b_found = _unit(rows.vectors.astype(np.float64)), np.zeros(len(rows.node), np.int64), [], []
        after = len(held.node) if inside is None else inside
        for cell, begin, end in self.ranges:
            who = np.flatnonzero(rows.has(slice(None), cell))
            same = rows.home[who] == cell
            for low in range(begin, end, size):
                block = None
                for some in (who[same], who[~same]):
                    if inside is not None and len(some) and rows.home[some[0]] == cell:
                        some = some[some + inside < min(low + size, end)]
                    for at in range(0, len(some), size):
                        part = some[at : at + size]
                        block = _unit(held.vectors[low : min(low + size, end)].astype(np.float64)) if block is None else block
                        x, y = np.nonzero(unit[part] @ block.T >= self.threshold)
                        if not len(x):
                            continue
                        x, y = part[x], low + y
                        back = held.has(y, rows.home[x])  # the pair also meets where x is at home
                        if inside is None:
                            keep = ~(back & (rows.own[x] < rows.grp[x]))
                        else:
                            keep = np.where(rows.home[x] == cell, x + inside < y, ~(back & (rows.home[x] < cell)))
                        x, y = x[keep], y[keep]
                        np.add.at(links, x, held.copies[y])
                        np.add.at(self.links, y, rows.copies[x])
                        xs, ys = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
                        code = np.concatenate((xs[0] + after, ys[0]))
                        child, root = forest(xs[1], len(xs[0]) + ys[1], len(code)) if len(x) else (xs[1], ys[1])
                        a_found.append(code[child])
                        b_found.append(code[root])
        if a_found:
            n = len(held.node)
            moved = np.flatnonzero(self.root != np.arange(n))
            child, root = forest(np.concatenate((*a_found, moved)), np.concatenate((*b_found, self.root[moved])), n + len(rows.node))
            own = child < n  # homes have the least numbers, so that they are the roots
            self.root[child[own]] = root[own]
            self.put(0, rows.node[child[~own] - n], held.node[root[~own]])
        if inside is None:
            linked = np.flatnonzero(links)
            self.put(1, rows.node[linked], links[linked])
        else:
            self.links[inside : inside + len(links)] += links

    def done(self) -> None:
        self._settle()
        if self.home is not None:
            moved, linked = np.flatnonzero(self.root != np.arange(len(self.root))), np.flatnonzero(self.links)
            self.put(0, self.home.node[moved], self.home.node[self.root[moved]])
            self.put(1, self.home.node[linked], self.links[linked])


def _judge(threshold: float, block_rows: int):
    def apply(batches):
        out, key, task = [], None, None

        def flush():
            kind, a, b = (np.concatenate([x[i] for x in out]) for i in range(3))
            out.clear()
            return pa.RecordBatch.from_pydict({"kind": kind, "a": a, "b": b})

        def put(kind: int, a: np.ndarray, b: np.ndarray) -> None:
            if len(a):
                out.append((np.full(len(a), kind, np.int32), a.astype(np.int64), b.astype(np.int64)))

        for batch in batches:
            names = [batch[c] for c in ("label", "dim", "grp")]
            other = np.zeros(max(len(batch) - 1, 0), bool)
            for c in names:
                other |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(other) + 1), len(batch)]
            for begin, end in zip(edges, edges[1:]):
                if begin == end:
                    continue
                own = tuple(c[begin].as_py() for c in names)
                if own != key:
                    if task is not None:
                        task.done()
                    key, task = own, _Task(threshold, block_rows, put)
                task.take(batch.slice(begin, end - begin))
                if sum(len(x[0]) for x in out) > 8192:
                    yield flush()
        if task is not None:
            task.done()
        if out:
            yield flush()

    return apply


def _layouts(nodes: DataFrame, total: int, centres: dict[int, np.ndarray], margin: float, block_rows: int, held_bytes: int) -> dict[tuple[str, int], tuple[int, Layout]]:
    """The first task number and the layout of each key that is more than a group; others are a group each."""
    wanted = max(block_rows, total // (2 * nodes.sparkSession.sparkContext.defaultParallelism))
    item = 4 if nodes.schema["embedding"].dataType.elementType.typeName() == "float" else 8
    fits = F.greatest(F.lit(1), F.floor(F.lit(held_bytes) / (F.col("dim") * item + 24)))
    sizes = nodes.groupBy("label", "dim").count().withColumn("held", F.least(fits, F.greatest(F.lit(wanted), F.ceil(F.col("count") / SPREAD)))).where("count > held")
    held = {(x.label, x.dim): int(x.held) for x in sizes.collect()}
    if not held:
        return {}
    counts: dict[tuple[str, int], dict[int, int]] = {key: {} for key in held}
    homes = nodes.select("label", "dim", "embedding").mapInArrow(_homes(centres, margin, set(held)), "label string, dim int, home int, n long")
    for x in homes.groupBy("label", "dim", "home").agg(F.sum("n").alias("n")).collect():
        counts[x.label, x.dim][x.home] = x.n
    out, base = {}, 0
    for key in sorted(held):
        layout = Layout(len(centres[key[1]]) if key[1] in centres else 1, counts[key], held[key])
        out[key], base = (base, layout), base + layout.groups
    return out


def embedding_groups(
    vectors: DataFrame, threshold: float = 0.93, cell_rows: int = 8192, margin: float = 0.25, block_rows: int = 2048, sample_rows: int = 16384, most_cells: int = 2048, held_bytes: int = 1 << 26
) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each vector.

    Vectors of equal label, not null, link at a cosine of ``threshold`` or more, in double precision; those of different length don't. A
    vector that is null, zero or holds null or non-finite components, or has no vec_id, links with nothing: 0 links, its own
    component, kept. component_id is the smallest vec_id that links reach. Repeated rows are vectors of their own.
    Empty table: no rows. Other columns are ignored.
    """
    spark = ready(vectors)
    rows = pick(vectors, vec_id="vec_id", embedding="embedding", label="label")
    kind = "float" if dict(rows.dtypes)["embedding"] == "array<float>" else "double"  # floats are moved as they are and judged as doubles
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast(f"array<{kind}>"))
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    # 0.0 and -0.0 are equal, so they must hash alike
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))
    marked = rows.withColumn("node", F.when(able, F.xxhash64("label", plain)))
    nodes = cut(
        marked.where("node is not null")
        .groupBy("node")
        .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
        .withColumn("dim", F.size("embedding"))
    )
    total = nodes.count()
    spread = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 30))
    share = min(1.0, sample_rows / max(total, 1))
    sample = nodes.where(spread < int(share * (1 << 30))).select("dim", "embedding").toArrow()
    dims, centres = sample["dim"].to_numpy(), {}
    for dim in np.unique(dims):
        own = _unit(matrix(sample.filter(pa.array(dims == dim))["embedding"], np.float64))
        centres[int(dim)] = spherical_kmeans(own, int(min(max(1, -(-total // cell_rows)), most_cells, len(own))))
    layouts = _layouts(nodes, total, centres, margin, block_rows, held_bytes)
    tasks, others = sum(layout.groups for _, layout in layouts.values()), shuffle_partitions(spark)
    small = F.lit(tasks) + F.pmod(F.xxhash64("label", "dim"), F.lit(others)).cast("int")
    dealt = nodes.select("label", "dim", "node", "copies", "embedding", small.alias("spread")).mapInArrow(_deal(centres, margin, layouts), DEALT.format(kind=kind))
    dealt = dealt.repartitionById(tasks + others, "part").drop("part").sortWithinPartitions("label", "dim", "grp", "guest")
    found = cut(dealt.mapInArrow(_judge(threshold, block_rows), FOUND))
    counts = found.where("kind = 1").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    reached = components(found.where("kind = 0").select("a", "b"))
    rooted = nodes.select("node", "least", "copies").join(reached, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = salted_join(rooted.join(counts, "node", "left"), ids, "root", "node")
    named = cut(named.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    out = salted_join(marked.where("node is not null"), named, "node", "vec_id").select("vec_id", "n_links", "component_id")
    alone = marked.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
