"""Removal of word windows that an earlier document already has, by level-wise doubling.

The lengths double from a short seed up to the wanted one (7, then 13 words; 7, 14, 28, 50 for 50). Only parts that
are repeated at one length are extended to twice that length, so that most of the corpus leaves after the first
level; a level without survivors sends nothing on.

How it scales. Documents are dealt to chunks of a few MB. At each level a chunk sends one row for each different
window it still follows: hash, chunk, smallest doc_id. The first level sends only the seed of least hash of each
wanted window (about a quarter of all seeds; windows that are equal agree on it, so none is missed). Spark brings
equal hashes together, and each chunk gets back the hashes that count. A hash has one row per chunk at most, however
many copies there are, so no key is hot. Nothing is collected, and the plan has no checkpoint: Spark rebuilds
whatever a lost executor held. The documents are shuffled once; later levels reuse that exchange.

Hashes have 64 bits: of 10^13 windows about one in a million would be removed wrongly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (
    BYTE_CODE,
    Rolling,
    chunked,
    chunks_for,
    ids_of,
    joined,
    leftmost_least,
    pick,
    ready,
)

#: A word ends at these bytes.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SENT = "hash long, chunk int, first long"


def levels(words: int, seed: int) -> list[int]:
    """Lengths from the seed on, doubled, the last one cut to the wanted length."""
    out = [min(seed, words)]
    while out[-1] < words:
        out.append(min(2 * out[-1], words))
    return out


class Words:
    """The words of a chunk's documents: hashes, document of each, and windows by start."""

    def __init__(self, texts: list[bytes | None]):
        data, start, end = joined(texts)
        space = SPACES[data]
        edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        code = Rolling(BYTE_CODE[data])
        self.rolling = Rolling(code.spans(first, last) | np.uint64(1))
        self.doc = np.searchsorted(end, first, side="left")
        self.count = np.bincount(self.doc, minlength=len(texts))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows that lie in one document, and their hashes."""
        n = max(0, len(self.doc) - length + 1)
        starts = np.flatnonzero(self.doc[:n] == self.doc[length - 1 : length - 1 + n])
        return starts, self.rolling.every(length)[starts]


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in known, a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _least(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes, sorted, and the smallest id of each."""
    order = np.argsort(hashes, kind="stable")
    h, i = hashes[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], np.minimum.reduceat(i, first) if len(h) else i


def _columns(batch: pa.Table) -> tuple[int, np.ndarray, list[bytes | None]]:
    return batch["chunk"][0].as_py(), ids_of(batch["doc_id"].combine_chunks()), batch["text"].cast(pa.binary()).to_pylist()


def _answer(table: pa.Table) -> np.ndarray:
    """Hashes that a chunk got back, sorted."""
    lists = [np.asarray(x.values.to_numpy()) for x in table["hashes"] if x.is_valid]
    return np.sort(np.concatenate(lists).view(np.uint64)) if lists else np.zeros(0, np.uint64)


def _parts(words: Words, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of the wanted length, the last of ``lengths``, and of the part of each that is looked at
    once it has been extended to the last length but one.

    The first part is the seed of least hash. Each later one begins where the one before does, or as much earlier as it must
    to end in the window. So equal windows have equal parts at every level.
    """
    wanted, reached = lengths[-1], lengths[:-1]
    n = max(0, len(words.doc) - wanted + 1)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(words.doc[:n] == words.doc[wanted - 1 : wanted - 1 + n])
    at = leftmost_least(words.rolling.every(reached[0]), wanted - reached[0] + 1)[starts]
    for length in reached[1:]:
        at = np.minimum(at, starts + wanted - length)
    return starts, at


def _rows(chunk: int, hashes: np.ndarray, ids: np.ndarray) -> pa.Table:
    h, i = _least(hashes, ids)
    return pa.table({"hash": h.view(np.int64), "chunk": pa.array(np.full(len(h), chunk, np.int32)), "first": i})


def _send_seeds(wanted: int, seed: int):
    def send(batch: pa.Table) -> pa.Table:
        chunk, ids, texts = _columns(batch)
        words = Words(texts)
        at = np.unique(_parts(words, [seed, wanted])[1])
        return _rows(chunk, words.rolling.every(seed)[at], ids[words.doc[at]])

    return send


def _send_level(wanted: int, lengths: list[int]):
    """Windows whose part was repeated at the last length but one send their part of the last length."""

    def send(key, docs: pa.Table, answer: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows(0, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        chunk, ids, texts = _columns(docs)
        words = Words(texts)
        starts, at = _parts(words, [*lengths[:-1], wanted])
        if len(starts):
            alive = _is_in(words.rolling.every(lengths[-2])[at], _answer(answer))
            at = np.unique(np.minimum(at[alive], starts[alive] + wanted - lengths[-1]))
        return _rows(chunk, words.rolling.every(lengths[-1])[at], ids[words.doc[at]])

    return send


def _finish(length: int):
    """Local copies are judged here; copies of windows that start in other chunks come with the answer."""

    def finish(key, docs: pa.Table, answer: pa.Table) -> pa.Table:
        n = docs.num_rows
        if not n:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        _, ids, texts = _columns(docs)
        words = Words(texts)
        starts, hashes = words.windows(length)
        own = ids[words.doc[starts]]
        different, least = _least(hashes, own)
        gone = _is_in(hashes, _answer(answer))
        if len(different):
            gone |= least[np.searchsorted(different, hashes)] < own
        cover = np.zeros(len(words.doc) + 1, np.int64)
        np.add.at(cover, starts[gone], 1)
        np.add.at(cover, np.minimum(starts[gone] + length, len(words.doc)), -1)
        removed = np.cumsum(cover[:-1]) > 0
        kept, begin = [], 0
        for text, count in zip(texts, words.count, strict=True):
            parts = (text or b"").split()
            lost = removed[begin : begin + count]
            if lost.any():
                parts = [parts[i] for i in np.flatnonzero(~lost)]
            kept.append(b" ".join(parts))
            begin += count
        return pa.table(
            {
                "doc_id": docs["doc_id"].cast(pa.int64()),
                "n_words": words.count.astype(np.int64),
                "n_removed": np.bincount(words.doc[removed], minlength=n).astype(np.int64),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    return finish


def substring_dedup(docs: DataFrame, words: int = 13, seed: int = 7, chunk_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept: each text without the words of windows that a smaller doc_id also has.

    A window is ``words`` consecutive words of one document, judged on the input. Kept words are joined by one space.
    Null text: no words, empty kept. Null doc_id: larger than any id; rows of equal id never remove from each other.
    Empty table: no rows. Other columns are ignored, also those named alike. Texts are never cut, however long.
    """
    ready(docs)
    docs = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    docs = chunked(docs, chunks_for(docs, "text", chunk_bytes))
    lengths = levels(words, seed)
    groups = docs.groupBy("chunk")
    sent = groups.applyInArrow(_send_seeds(words, lengths[0]), SENT)
    for k, length in enumerate(lengths):
        last = length == words
        same = Window.partitionBy("hash")
        if last:  # what another chunk has in a smaller document
            told = sent.withColumn("least", F.min("first").over(same)).where("least < first")
        else:  # what several chunks have; a chunk sees its own copies itself
            told = sent.withColumn("n", F.count(F.lit(1)).over(same)).where("n > 1")
        answer = told.groupBy("chunk").agg(F.collect_list("hash").alias("hashes"))
        pair = docs.groupBy("chunk").cogroup(answer.groupBy("chunk"))
        if last:
            return pair.applyInArrow(_finish(words), "doc_id long, n_words long, n_removed long, kept string")
        sent = pair.applyInArrow(_send_level(words, lengths[: k + 2]), SENT)
    raise AssertionError("the last level returns")
