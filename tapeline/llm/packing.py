"""Best-fit packing of documents into sequences of fixed length, by hierarchical residual packing.

Documents are encoded where they are read and cut into pieces of at most a sequence. Each task then packs its own pieces,
longest first, each into the fullest bin that has room, and emits the bins that are nearly full. The others go up a tree: a
node takes the underfull bins of 16 nodes below it as items and packs them again; bins that are underfull even then are dissolved and
their pieces packed once more, and what is nearly full is emitted. The root emits what is left.

Only (number, length) of pieces are packed; their ids stay in a Parquet table of the shared folder, which is written once and also
fixes the pieces' numbers. Each level is checkpointed, so a lost executor repeats a level at most. There are no keys, so copies and
long documents are no skew: a task packs at most ``most_pieces`` at once, and a node above holds but the underfull rest.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, ready, shared_dir
from .token_store import encoder

PIECES = "doc_id long, piece int, start long, length int, ids binary"
BINS = "node int, done boolean, numbers array<long>, lengths array<int>"
_BINS = pa.schema([("node", pa.int32()), ("done", pa.bool_()), ("numbers", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))])


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, largest first, goes to the fullest bin that has room for it."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room that is left
    rooms = 0  # bit r is set where a bin with room r exists, so the least room that suffices is a lowest bit
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fitting = rooms >> sizes[i]
        if fitting:
            room = sizes[i] + (fitting & -fitting).bit_length() - 1
            own = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
            bins[own].append(i)
        else:
            own, room = len(bins), capacity
            bins.append([i])
        with_room[room - sizes[i]].append(own)
        rooms |= 1 << (room - sizes[i])
    return bins


def merge(bins: list[list[tuple[int, int]]], capacity: int, slack: int) -> tuple[list, list]:
    """Packs bins, lists of (number, length), as items: the nearly full ones, and the underfull rest.

    The rest's pieces are packed once more by themselves, and that is kept if it takes no more bins.
    """

    def packed(items):
        found = [[p for i in own for p in items[i]] for own in best_fit([sum(n for _, n in x) for x in items], capacity)]
        full = [sum(n for _, n in x) >= capacity - slack for x in found]
        return [x for x, yes in zip(found, full, strict=True) if yes], [x for x, yes in zip(found, full, strict=True) if not yes]

    full, rest = packed(bins)
    loose = [[p] for x in rest for p in x]
    if len(loose) > len(rest):
        more, again = packed(loose)
        if len(more) + len(again) <= len(rest):
            full, rest = full + more, again
    return full, rest


def _rows(node: int, groups: list[tuple[list, bool]]) -> pa.Table:
    bins = [(x, done) for own, done in groups for x in own]
    columns = [[node] * len(bins), [done for _, done in bins], [[i for i, _ in x] for x, _ in bins], [[n for _, n in x] for x, _ in bins]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BINS, strict=True)], schema=_BINS)


def _pack_own(capacity: int, slack: int, most: int):
    """Packs a task's pieces, up to most at once."""

    def flush(held):
        return _rows(TaskContext.get().partitionId(), list(zip(merge(held, capacity, slack), (True, False), strict=True))).to_batches()

    def apply(batches):
        held = []
        for batch in batches:
            held += [[p] for p in zip(batch.column("number").to_pylist(), batch.column("length").to_pylist(), strict=True)]
            while len(held) >= most:
                yield from flush(held[:most])
                held = held[most:]
        if held:
            yield from flush(held)

    return apply


def _pack_node(capacity: int, slack: int, most: int, root: bool):
    def apply(key, table):
        items = [list(zip(a, b, strict=True)) for a, b in zip(table.column("numbers").to_pylist(), table.column("lengths").to_pylist(), strict=True)]
        items.sort()
        parts, part, held = [], [], 0
        for x in items:
            if part and held + len(x) > most:
                parts.append(part)
                part, held = [], 0
            part.append(x)
            held += len(x)
        found = [merge(x, capacity, slack) for x in [*parts, part]]
        return _rows(key[0].as_py(), [(x, True) for x, _ in found] + [(x, root) for _, x in found])

    return apply


def pack(items: DataFrame, capacity: int, slack: int = 1, fan_in: int = 16, most_pieces: int = 1_000_000) -> DataFrame:
    """number, sequence_id, offset of items (number long, length int), whose numbers differ and whose lengths are 1 to
    ``capacity``: in each sequence the offsets are gapless from 0, and no sequence exceeds ``capacity``.

    ``slack`` is how much room a bin may have to count as nearly full below the root. Empty table: no rows.
    """
    ready(items)
    whole = items.where(F.col("length") == capacity).select("number", F.col("number").alias("sequence_id"), F.lit(0).alias("offset"))
    level = cut(items.where(F.col("length") < capacity).select("number", "length").mapInArrow(_pack_own(capacity, slack, most_pieces), BINS))
    nodes = (level.agg(F.max("node")).first()[0] or 0) + 1
    levels = [level]
    while not levels[-1].where("not done").isEmpty():
        nodes = -(-nodes // fan_in)
        left = levels[-1].where("not done").withColumn("node", F.floor(F.col("node") / fan_in).cast("int"))
        levels.append(cut(left.groupBy("node").applyInArrow(_pack_node(capacity, slack, most_pieces, nodes == 1), BINS)))
    done = reduce(DataFrame.unionByName, [x.where("done") for x in levels])
    # a sequence is named by its first piece; an offset is the length of the pieces before
    at = F.expr("transform(sequence(0, size(lengths) - 1), i -> aggregate(slice(lengths, 1, i), 0, (a, b) -> a + b))")
    placed = done.select(F.col("numbers")[0].alias("sequence_id"), F.explode(F.arrays_zip("numbers", at.alias("offset"))).alias("p"))
    return placed.select(F.col("p.numbers").alias("number"), "sequence_id", F.col("p.offset").alias("offset")).unionByName(whole)


def _cut_ids(path: str, end: int, capacity: int):
    def apply(batches):
        step = 4 * capacity
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            ids = encoder(path).encode(texts, end)
            count = np.array([-(-len(x) // step) for x in ids], np.int64)
            row = np.repeat(np.arange(len(ids)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            cuts = [ids[r][step * p : step * (p + 1)] for r, p in zip(row.tolist(), piece.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(row)),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(piece * capacity, pa.int64()),
                    "length": pa.array([len(x) // 4 for x in cuts], pa.int32()),
                    "ids": pa.array(cuts, pa.binary()),
                }
            )

    return apply


def write_pieces(docs: DataFrame, path: str, folder: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Encodes each whole text by the tokenizer file at ``path``, ends it with ``end_id``, cuts it into pieces of ``capacity`` ids,
    the last one maybe shorter, and writes them to ``folder``; returns that table: number, doc_id, piece, start, length, ids.

    ids are little-endian unsigned 32-bit integers; number tells pieces apart, also those of repeated or null doc_ids.
    """
    ready(docs)
    docs = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = docs.mapInArrow(_cut_ids(path, end_id, capacity), PIECES).withColumn("number", F.monotonically_increasing_id())
    pieces.write.option("compression", "zstd").mode("error").parquet(folder)
    return docs.sparkSession.read.schema(f"number long, {PIECES}").parquet(folder)


def packed_pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each document, in as few sequences as the packing finds.

    ids_crc32 is over the piece's little-endian 32-bit ids. Null text: as an empty one, so the end id alone. Null and repeated
    doc_ids: a document a row. Empty table: no rows. Other columns are ignored. ``how``: see ``pack``.
    """
    pieces = write_pieces(docs, path, shared_dir(ready(docs)), end_id, capacity)
    places = pack(pieces.select("number", "length"), capacity, **how)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids").join(places, "number").drop("number")


def packed_sequences(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, **how) -> DataFrame:
    """sequence_id, n_ids, ids (little-endian 32-bit), doc_ids, starts: each sequence as a trainer reads it, with the document of
    each of its pieces and where that starts. Rows as for ``packed_pieces``."""
    pieces = write_pieces(docs, path, shared_dir(ready(docs)), end_id, capacity)
    places = pack(pieces.select("number", "length"), capacity, **how)
    own = pieces.join(places, "number").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return own.select("sequence_id", (F.octet_length(ids) / 4).cast("int").alias("n_ids"), ids.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))
