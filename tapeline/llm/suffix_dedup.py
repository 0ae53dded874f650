"""Removal of byte strings of a fixed length that also start earlier in the corpus, by suffix arrays.

1. Anchors. Every window (``length`` bytes of one document) has an anchor, its 32-byte part of least hash; windows
   that are equal have equal anchors at the same place. Chunks of documents send one row for each different anchor, and
   get back those that occur more than once anywhere. All other windows are unique.
2. Crowded anchors only (more than ``crowd`` occurrences): the hashes of their windows are compared too, packed many to a
   row, and windows that are unique leave. So a passage that a third of all documents share isn't dragged along with each
   document's own surroundings.
3. Segments. The windows of one anchor occurrence that are left, with the bytes they cover, go to the task of their
   anchor; equal segments are sent once by a chunk and become one in the task, by their bytes. A suffix array
   of each anchor's segments (``suffix_groups``) puts equal windows side by side, bytes are compared, and all but
   the earliest start of a window are marked. The windows of one segment all differ, as their anchor stands elsewhere in
   each, so an anchor with a single segment is sorted already.
4. Marks go back to their chunks, which cut out the covered bytes.

Hashes only tell what can't occur twice; bytes decide the rest, so the result is exact.

How it scales. Documents are shuffled once, to chunks of a few MB, and reused by all passes; an anchor has at most one
row per chunk in pass 1, and its segments in pass 3 are different strings. A crowded anchor's segments are cut where the place
of the anchor in the window passes a multiple of ``TURN``, and go by a hash of the bytes that all windows of the piece
have: equal windows still meet, and one anchor becomes many tasks. Tasks sort anchors in parts of about
a MB. Nothing is collected and nothing is cached: Spark rebuilds what a lost executor held.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTE_CODE, NO_ID, Rolling, chunked, chunks_for, joined, leftmost_least, mix, pick, ready
from .suffix_groups import suffix_arrays

GRAM = 32
TURN = 16
PART_BYTES = 1 << 20
GROUP = 1 << 17
#: What an answer to a chunk has: anchors that occur more than once, crowded ones, windows of these that do, marks.
PLAIN, CROWDED, TWICE, MARKS = range(4)


def _known(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def _told(answers: pa.Table, kind: int) -> np.ndarray:
    """The hashes of one kind that a chunk got back, sorted."""
    own = answers.filter(pc.equal(answers["kind"], kind))["hashes"]
    return np.sort(own.combine_chunks().flatten().to_numpy().view(np.uint64))


class Chunk:
    """The documents of a chunk in one byte array, in a fixed order, and the runs of windows that share an anchor.

    A run is known by the hash of its anchor (``gram``), its first window and the number of windows. Hashes are made for
    a hundred kilobytes at a time, which stay in the cache.
    """

    def __init__(self, docs: pa.Table, length: int):
        ids = docs["doc_id"].combine_chunks().fill_null(NO_ID).to_pylist()
        texts = [x or b"" for x in docs["text"].cast(pa.binary()).to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.order = order
        self.ids, self.texts = np.array([ids[i] for i in order], np.int64), [texts[i] for i in order]
        self.number, self.length, self.short = docs["chunk"][0].as_py(), length, min(GRAM, length)
        self.data, self.start, self.end = joined(self.texts)
        self.view: bytes | None = None
        runs, low = [], 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(self.end, self.start[low] + GROUP)))
            runs.append(self._runs(low, high))
            low = high
        self.gram, self.anchor, self.begin, self.count, self.doc = (np.concatenate(x) for x in zip(*runs, strict=True))

    def _rolling(self, low: int, high: int) -> tuple[Rolling, int]:
        base = int(self.start[low])
        return Rolling(BYTE_CODE[self.data[base : self.end[high - 1] + 1]]), base

    def _runs(self, low: int, high: int) -> tuple[np.ndarray, ...]:
        rolling, base = self._rolling(low, high)
        count = np.maximum(self.end[low:high] - self.start[low:high] - self.length + 1, 0)
        doc = np.repeat(np.arange(low, high), count)
        at = np.arange(count.sum()) + np.repeat(self.start[low:high] - base - (np.cumsum(count) - count), count)
        if not len(at):
            none = np.zeros(0, np.int64)
            return none.view(np.uint64), none, none, none, none
        grams = rolling.every(self.short)
        anchor = leftmost_least(grams, self.length - self.short + 1)[at]
        first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
        many = np.diff(np.concatenate((first, [len(at)])))
        begin, anchor = at[first], anchor[first]
        return grams[anchor], anchor + base, begin + base, many, doc[first]

    def crowded_windows(self, answers: pa.Table):
        """For each part of the documents with crowded anchors: its rolling hash and base, the runs, and for each of
        their windows the run, start and hash."""
        hot = np.flatnonzero(_known(self.gram, _told(answers, CROWDED)))
        while len(hot):
            low = self.doc[hot[0]]
            high = max(low + 1, int(np.searchsorted(self.end, self.start[low] + GROUP)))
            own, hot = hot[self.doc[hot] < high], hot[self.doc[hot] >= high]
            rolling, base = self._rolling(low, high)
            run = np.repeat(own, self.count[own])
            at = np.arange(len(run)) + np.repeat(self.begin[own] - (np.cumsum(self.count[own]) - self.count[own]), self.count[own])
            yield rolling, base, run, at, rolling.spans(at - base, at - base + self.length)

    def segments(self, answers: pa.Table) -> tuple[np.ndarray, ...]:
        """What may occur twice, by the answers of the first two passes: runs, and of runs with crowded anchors the
        parts whose windows do. Returns run, first window, count, key of the task, and for each the first of equal bytes."""
        plain, twice = np.flatnonzero(_known(self.gram, _told(answers, PLAIN))), _told(answers, TWICE)
        parts = [(plain, self.begin[plain], self.count[plain], self.gram[plain])]
        turn = max(1, min(TURN, self.length // 2))
        for rolling, base, run, at, hashes in self.crowded_windows(answers):
            keep = np.flatnonzero(_known(hashes, twice))
            if not len(keep):
                continue
            run, at = run[keep], at[keep]
            place = (self.anchor[run] - at) // turn
            first = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1]))))
            many = np.diff(np.concatenate((first, [len(at)])))
            run, begin, place = run[first], at[first], place[first]
            core = self.anchor[run] - base - place * turn  # from here on all windows of the piece have these bytes
            parts.append((run, begin, many, mix(rolling.spans(core, core + self.length - turn + 1) + self.gram[run])))
        run, begin, count, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(begin, kind="stable")
        run, begin, count, key = run[order], begin[order], count[order], key[order]
        return run, begin, count, key, _leaders(self.bytes_of(begin, count))

    def bytes_of(self, begin: np.ndarray, count: np.ndarray) -> pa.Array:
        if self.view is None:
            self.view = self.data.tobytes()
        return pa.array([self.view[s:e] for s, e in zip(begin.tolist(), (begin + count + self.length - 1).tolist(), strict=True)], pa.binary())


def _leaders(parts: pa.Array) -> np.ndarray:
    """For each byte string the place of the first equal one."""
    code = parts.dictionary_encode().indices.to_numpy()
    return np.unique(code, return_index=True)[1][code] if len(code) else np.zeros(0, np.int64)


def _send_anchors(length: int):
    def send(docs: pa.Table) -> pa.Table:
        c = Chunk(docs, length)
        # documents' runs with one anchor follow each other
        new = np.concatenate(([True], c.anchor[1:] != c.anchor[:-1])) if len(c.anchor) else np.zeros(0, bool)
        hashes, n = np.unique(c.gram[new], return_counts=True)
        return pa.table({"hash": hashes.view(np.int64), "chunk": pa.array(np.full(len(n), c.number, np.int32)), "n": pa.array(n, pa.int32())})

    return send


def _send_crowded(length: int, buckets: int):
    """Hashes of the windows of crowded anchors, packed by range; a hash that occurs more than once is sent twice."""

    def send(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary())])
        if not docs.num_rows or not len(_told(answers, CROWDED)):
            return schema.empty_table()
        c = Chunk(docs, length)
        every = [x[-1] for x in c.crowded_windows(answers)]
        hashes, n = np.unique(np.concatenate(every) if every else np.zeros(0, np.uint64), return_counts=True)
        hashes = np.repeat(hashes, np.minimum(n, 2))
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else bucket
        parts = [x.astype("<u8").tobytes() for x in np.split(hashes, edge[1:])] if len(edge) else []
        return pa.table([pa.array(bucket[edge], pa.int32()), pa.array(np.full(len(edge), c.number, np.int32)), pa.array(parts, pa.binary())], schema=schema)

    return send


def _match_crowded(batch: pa.Table) -> pa.Table:
    """To each chunk its hashes that occur more than once in the bucket."""
    parts = [np.frombuffer(x.as_py(), "<u8") for x in batch["hashes"]]
    every = np.sort(np.concatenate(parts))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = [np.unique(x[_known(x, twice)]).view(np.int64) for x in parts]
    return pa.table({"chunk": batch["chunk"], "hashes": pa.array(out, pa.list_(pa.int64()))})


SEGMENT = "bucket int, hash long, chunk int, doc long, pos long, at long, seg binary"


def _send_segments(length: int, buckets: int):
    def send(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["bucket", "hash", "chunk", "doc", "pos", "at", "seg"]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        if not docs.num_rows or not answers.num_rows:
            return pa.schema(list(zip(names, types, strict=True))).empty_table()
        c = Chunk(docs, length)
        run, begin, count, key, leader = c.segments(answers)
        lead = np.unique(leader)
        run, begin, count, key = run[lead], begin[lead], count[lead], key[lead]
        doc = c.doc[run]
        parts = [key % np.uint64(buckets), key.view(np.int64), np.full(len(run), c.number), c.ids[doc], begin - c.start[doc], begin]
        return pa.table([*[pa.array(x.astype(k.to_pandas_dtype()), k) for x, k in zip(parts, types[:-1], strict=True)], c.bytes_of(begin, count)], names=names)

    return send


def _mark(data: np.ndarray, begin: np.ndarray, size: np.ndarray, anchor: np.ndarray, doc: np.ndarray, pos: np.ndarray, length: int) -> np.ndarray:
    """For different segments, sorted by anchor: which windows (of the first, of the second and so on) also start earlier, by the suffix arrays of the
    anchors' segments."""
    new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    # a separator before each anchor's first segment and after every segment
    lead = np.cumsum(new)
    start = np.cumsum(size + 1) - (size + 1) + lead
    code = np.zeros(int((size + 1).sum() + new.sum()), np.int64)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    code[np.repeat(start, size) + inner] = data[np.repeat(begin, size) + inner].astype(np.int64) + 1
    blocks = np.concatenate((start[new] - 1, [len(code)]))
    order = suffix_arrays(code, blocks)
    owner = np.full(len(code), -1)
    owner[np.repeat(start, size) + inner] = np.repeat(np.arange(len(size)), size)
    own = owner[order]
    offset = order - start[own]
    good = (own >= 0) & (offset + length <= size[own])
    order, own, offset = order[good], own[good], offset[good]
    windows = np.lib.stride_tricks.sliding_window_view((code - 1).astype(np.uint8), length)
    equal = np.zeros(len(order), bool)
    for i in range(1, len(order), 1 << 15):
        a = order[i - 1 : i - 1 + (1 << 15) + 1]
        rows = windows[a]
        equal[i : i + len(a) - 1] = (rows[1:] == rows[:-1]).all(axis=1) & (anchor[own[i : i + len(a) - 1]] == anchor[own[i - 1 : i + len(a) - 2]])
    group = np.cumsum(~equal)
    where = pos[own] + offset
    rank = np.lexsort((where, doc[own], group))
    head = np.concatenate(([True], group[rank][1:] != group[rank][:-1]))
    best = rank[head][np.cumsum(head) - 1]
    later = np.zeros(len(order), bool)
    later[rank] = (doc[own[rank]] != doc[own[best]]) | (where[rank] != where[best])
    count = size - length + 1
    base = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), bool)
    out[base[own] + offset] = later
    return out


def _marks(length: int):
    """chunk, at, marks for the segments that have windows to remove: a bit for each window, or null for all."""
    width = -(-(length - min(GRAM, length) + 1) // 8)

    def marks(batch: pa.Table) -> pa.Table:
        chunk, at, anchor, doc, pos = (batch[c].to_numpy() for c in ("chunk", "at", "hash", "doc", "pos"))
        texts = batch["seg"].combine_chunks()
        same = texts.dictionary_encode().indices.to_numpy()
        # equal segments side by side, the earliest first; anchors side by side
        order = np.lexsort((pos, doc, same, anchor))
        new = np.concatenate(([True], (anchor[order][1:] != anchor[order][:-1]) | (same[order][1:] != same[order][:-1])))
        lead = order[new]
        leader = np.empty(len(order), np.int64)
        leader[order] = np.cumsum(new) - 1
        texts = texts.take(pa.array(lead))
        size = pc.binary_length(texts).to_numpy().astype(np.int64)
        texts = texts.to_pylist()
        # anchors with like numbers of bytes are sorted in step
        head = np.flatnonzero(np.concatenate(([True], anchor[lead][1:] != anchor[lead][:-1])))
        total = np.add.reduceat(size, head)
        runs = np.split(np.arange(len(lead)), head[1:])
        bits = np.zeros((len(lead), width), np.uint8)
        part, held = [], 0
        several = np.flatnonzero(np.diff(np.concatenate((head, [len(lead)]))) > 1)
        for r in [*several[np.argsort(total[several], kind="stable")], None]:
            if r is not None:
                part.append(runs[r])
                held += total[r]
            if part and (r is None or held > PART_BYTES):
                own = np.concatenate(part)
                some, sizes = lead[own], size[own]
                data = np.frombuffer(b"".join([texts[i] for i in own]), np.uint8)
                group = np.cumsum(np.concatenate(([0], anchor[some][1:] != anchor[some][:-1])))
                later = _mark(data, np.cumsum(sizes) - sizes, sizes, group, doc[some], pos[some], length)
                many = sizes - length + 1
                row = np.repeat(np.arange(len(own)), many)
                wide = np.zeros((len(own), 8 * width), bool)
                wide[row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)] = later
                bits[own] = np.packbits(wide, axis=1)
                part, held = [], 0
        first = (doc == doc[lead[leader]]) & (pos == pos[lead[leader]])
        some = np.flatnonzero(first & bits.any(axis=1)[leader])
        every = np.flatnonzero(~first)
        rows = np.concatenate((some, every))
        data = pa.array([x.tobytes() for x in bits[leader[some]]] + [None] * len(every), pa.binary())
        return pa.table({"chunk": pa.array(chunk[rows], pa.int32()), "at": pa.array(at[rows], pa.int64()), "marks": data})

    return marks


def _finish(length: int, as_text: bool, keyed: bool = False):
    width = -(-(length - min(GRAM, length) + 1) // 8)

    def finish(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        types = [pa.int64()] * 4 + [pa.string() if as_text else pa.binary()]
        if not docs.num_rows:
            return pa.schema([*zip(names, types, strict=True), *([("key", pa.int64())] if keyed else [])]).empty_table()
        c = Chunk(docs, length)
        marks = answers.filter(pc.equal(answers["kind"], MARKS))
        run, begin, count, _, leader = c.segments(answers)
        doc = c.doc[run]
        # later copies in this chunk go as a whole; rows of the leader's id and place share its marks
        pos, ids = begin - c.start[doc], c.ids[doc]
        whole = (ids != ids[leader]) | (pos != pos[leader])
        at, given = marks["at"].to_numpy(), marks["marks"].combine_chunks()
        null = given.is_null().to_numpy(zero_copy_only=False)
        whole |= np.isin(begin[leader], at[null])
        cover = np.zeros(len(c.data) + 1, np.int64)
        np.add.at(cover, begin[whole], 1)
        np.add.at(cover, begin[whole] + count[whole] + length - 1, -1)
        rows = np.frombuffer(b"".join(given.filter(pa.array(~null)).to_pylist()), np.uint8).reshape(-1, width)
        at = at[~null]
        by = np.argsort(at)
        some = np.flatnonzero(~whole & _known(begin[leader], at[by]))
        bits = np.unpackbits(rows[by[np.searchsorted(at[by], begin[leader[some]])]], axis=1) if len(some) else np.zeros((0, 8 * width), np.uint8)
        row, column = np.nonzero(bits)
        first = begin[some[row]] + column
        np.add.at(cover, first, 1)
        np.add.at(cover, first + length, -1)
        removed = np.cumsum(cover[:-1]) > 0
        # windows of two documents never touch, as a byte stands between them
        edge = np.flatnonzero(removed & ~np.concatenate(([False], removed[:-1])))
        spans = np.bincount(np.searchsorted(c.end, edge), minlength=len(c.ids))
        size, lost, kept = c.end - c.start, np.zeros(len(c.ids), np.int64), []
        for i, text in enumerate(c.texts):
            if spans[i]:
                left = ~removed[c.start[i] : c.end[i]]
                lost[i] = size[i] - left.sum()
                text = c.data[c.start[i] : c.end[i]][left].tobytes()
            kept.append(text.decode(errors="ignore") if as_text else text)
        out = pa.table([pa.array(c.ids, mask=c.ids == NO_ID), pa.array(size), pa.array(lost), pa.array(spans, pa.int64()), pa.array(kept, types[-1])], names=names)
        return out.append_column("key", docs["key"].take(pa.array(c.order, pa.int64()))) if keyed else out

    return finish


def suffix_dedup(docs: DataFrame, length: int = 100, chunk_bytes: int = 4 << 20, crowd: int = 256, as_text: bool = False, key: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: each whole text, as UTF-8 bytes, without the bytes that a string of
    ``length`` bytes covers which also starts earlier: in a smaller doc_id, or before in the same document.

    Strings never cross documents, may overlap, and are judged on the input. Null text: empty. Null doc_id: after all
    others. Rows of one doc_id count as one document, their starts each from their own begin. Empty table: no rows.
    Other columns are ignored, also those named alike. kept is binary, as a cut may divide a character; or, with
    ``as_text``, a string without the remains of divided characters. ``key`` names a long column to pass along, as key.
    """
    ready(docs)
    more = {"key": key} if key else {}
    docs = pick(docs, doc_id="doc_id", text="text", **more).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)
    n = chunks_for(docs, "text", chunk_bytes)
    docs = chunked(docs, n)
    groups = docs.groupBy("chunk")
    anchors = groups.applyInArrow(_send_anchors(length), "hash long, chunk int, n int")
    # one row for each chunk and kind, so that every later use shares the exchange behind it
    crowded = F.when(F.col("total") > crowd, CROWDED).otherwise(PLAIN)
    first = (
        anchors.withColumn("total", F.sum("n").over(Window.partitionBy("hash")))
        .where("total > 1")
        .groupBy("chunk", crowded.alias("kind"))
        .agg(F.collect_list("hash").alias("hashes"))
    )
    packed = groups.cogroup(first.groupBy("chunk")).applyInArrow(_send_crowded(length, max(1, n // 4)), "bucket int, chunk int, hashes binary")
    second = packed.groupBy("bucket").applyInArrow(_match_crowded, "chunk int, hashes array<long>").withColumn("kind", F.lit(TWICE))
    answers = first.unionByName(second)
    segments = groups.cogroup(answers.groupBy("chunk")).applyInArrow(_send_segments(length, n), SEGMENT)
    marks = segments.groupBy("bucket").applyInArrow(_marks(length), "chunk int, at long, marks binary").withColumn("kind", F.lit(MARKS))
    told = answers.unionByName(marks, allowMissingColumns=True)
    return groups.cogroup(told.groupBy("chunk")).applyInArrow(
        _finish(length, as_text, bool(key)), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}{', key long' if key else ''}"
    )
