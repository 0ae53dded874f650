"""Alignment of two tokenizers' tokens by the bytes they cover, with corpus-wide counts of aligned id pairs.

Both token sequences of a text cover the same bytes, a space and the text. Places where a token of either ends cut them into stretches;
each stretch lies in one token of both, and each overlapping pair of tokens shares exactly one stretch, so the links of a text are its stretches.
Places where both end cut the tokens into groups. As texts cover their bytes one after the other, a whole run of texts is aligned at once.

A pair of ids is one 64-bit key. Each task counts the keys of its documents with ``np.unique``, the partial counts are range-partitioned and
sorted, and runs of equal keys are summed into shards of sorted keys and counts, files of the shared folder. A second pass over
the tokens looks its keys up in the memory-mapped shards, from which a task touches only the pages it needs. A key is at most one row of
a task's partial counts, so no pair is a hot one, and there are no more keys than pairs of ids, however large the corpus.

What goes through the driver is a line for each shard and, for each id of the first tokenizer, its highest count: both are bounded by the vocabularies.
"""

from __future__ import annotations

import functools
import json
import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_characters
from .common import cut, pick, ready, shared_dir

GROUP_BYTES = 1 << 19  # so many bytes of text are aligned at once, or one text
HELD_KEYS = 1 << 20  # so many different keys are counted in a task before they are passed on
MEMO = 400_000  # so many segments' ids are kept in a process
LONGEST = 64  # of so many characters at most
#: A segment starts with spaces and ends before a space that no white space precedes. Neither tokenizer joins it to the next one.
SEGMENTS = re.compile(r" *(?:\S+|[^\S ] *)+| +")
#: Python counts these as white space and the pattern of the first tokenizer doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: A model that gives these back byte by byte changes no text before it splits it.
PROBES = ["  two  spaces ", "\t\n \r\n", "ﬁ ① e\u0301 \u1112\u1161\u11ab ½", "A\u00a0\u3000B\u200b"]


class Vocabularies:
    """Two tokenizers, the bytes of their tokens, and how their ids are printed."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings inside texts are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {c: b for b, c in enumerate(byte_characters())}
        known = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(known.values(), default=-1) + 1)
        for token, i in known.items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.memo: dict[str, tuple[bytes, bytes] | None] = {}
        self.segmented = self._segmented()
        self.size_a, self.size_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        self.type_a, self.type_b = (np.dtype("<u2" if len(own) <= 1 << 16 else "<u4") for own in (self.bytes_a, self.bytes_b))
        # the ids of A with what may follow them, then those of B
        self.print_b = 2 * len(self.bytes_a)
        self.printed = [f"{i}{c}" for i in range(len(self.bytes_a)) for c in ",|"] + [f"{i}{c}" for i in range(len(self.bytes_b)) for c in (",", ";", "")]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _segmented(self) -> bool:
        """Whether both tokenizers encode a text segment by segment: the first one has the pattern of byte-level BPE, the second changes
        nothing, and none of its pieces has a space but at its start."""
        state = json.loads(self.a.to_str())
        plain = state["normalizer"] is None and state["model"]["type"] == "BPE" and state["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        apart = not any(b" " in x.lstrip(b" ") for x in self.bytes_b)
        return plain and apart and all(b"".join(self.bytes_b[i] for i in self.b.encode(x)) == b" " + x.encode() for x in PROBES)

    def _ids(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of strings by both, with a space before each; None where bytes change."""
        by_a = self.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)
        by_b = self.b.encode(texts, num_threads=1)
        out = []
        for text, a, b in zip(texts, by_a, by_b, strict=True):
            a, own = a.ids, b" " + text.encode()
            same = b"".join(map(self.bytes_a.__getitem__, a)) == own and b"".join(map(self.bytes_b.__getitem__, b)) == own
            out.append((np.array(a, self.type_a).tobytes(), np.array(b, self.type_b).tobytes()) if same else None)
        return out

    def _learn(self, segments: set[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """The ids of segments. Many are one text, which is cut where they end; those that end with white space could join the next."""
        closed = [x for x in segments if not x[-1].isspace()]
        found: dict[str, tuple[bytes, bytes] | None] = {}
        for i in range(0, len(closed), 4096):
            found |= self._cut(closed[i : i + 4096])
        rest = [x for x in segments if x not in found]
        found |= dict(zip(rest, self._ids([x[1:] for x in rest]), strict=True))
        short = {x: y for x, y in found.items() if len(x) <= LONGEST}
        if len(self.memo) + len(short) > MEMO:
            self.memo.clear()
        self.memo.update(short)
        return found

    def _cut(self, segments: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """The ids of segments, from those of all of them as one text; nothing if that changes bytes."""
        both = self._ids(["".join(segments)[1:]])[0]
        if both is None:
            return {}
        ends = np.cumsum([len(x.encode()) for x in segments])
        parts = []
        for data, kind, size in zip(both, (self.type_a, self.type_b), (self.size_a, self.size_b), strict=True):
            bounds = kind.itemsize * np.searchsorted(np.cumsum(size[np.frombuffer(data, kind)]), ends, side="right")
            parts.append(map(data.__getitem__, map(slice, [0, *bounds[:-1].tolist()], bounds.tolist())))
        return dict(zip(segments, zip(*parts, strict=True), strict=True))

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """The ids of each text by both; none if the text is empty, isn't UTF-8, or either loses or changes bytes."""
        out: list[tuple[bytes, bytes] | None] = [None] * len(texts)
        whole, split = [], {}
        for i, data in enumerate(texts):
            try:
                text = data.decode()
            except UnicodeDecodeError:
                text = ""
            if not text:
                out[i] = b"", b""
            elif self.segmented and not SEPARATORS.search(text):
                split[i] = SEGMENTS.findall(" " + text)
            else:
                whole.append(i)
        known = {i: list(map(self.memo.get, parts)) for i, parts in split.items()}
        missing = {x for i, own in known.items() if None in own for x, y in zip(split[i], own, strict=True) if y is None}
        new = self._learn(missing) if missing else {}
        for i, own in known.items():
            if None in own:
                own = [new[x] if y is None else y for x, y in zip(split[i], own, strict=True)]
            if None in own:  # a segment changes; the text as a whole decides
                whole.append(i)
            else:
                a, b = zip(*own, strict=True)
                out[i] = b"".join(a), b"".join(b)
        for i, own in zip(whole, self._ids([texts[i].decode() for i in whole]), strict=True):
            out[i] = own or (b"", b"")
        return out


@functools.lru_cache(2)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


class Aligned:
    """Texts, one after the other: ``a`` and ``b`` their ids, ``key`` the pair of each link, ``doc`` the text of each."""

    def __init__(self, v: Vocabularies, ids: list[tuple[bytes, bytes]]):
        self.v = v
        self.n_a, self.n_b = (np.array([len(x[side]) for x in ids], np.int64) // t.itemsize for side, t in ((0, v.type_a), (1, v.type_b)))
        self.a = np.frombuffer(b"".join(x for x, _ in ids), v.type_a).astype(np.int64)
        self.b = np.frombuffer(b"".join(x for _, x in ids), v.type_b).astype(np.int64)
        self.end_a, self.end_b = np.cumsum(v.size_a[self.a]), np.cumsum(v.size_b[self.b])
        size = int(self.end_a[-1]) if len(self.end_a) else 0
        ends = np.zeros((2, size + 1), bool)
        ends[0, self.end_a] = ends[1, self.end_b] = True
        self.both = np.flatnonzero(ends[0] & ends[1])
        stretch = np.flatnonzero(ends[0] | ends[1])
        self.key_a = self.a[np.searchsorted(self.end_a, stretch)]
        self.key = self.key_a * len(v.bytes_b) + self.b[np.searchsorted(self.end_b, stretch)]
        # texts without tokens take no bytes, so a place belongs to the first text that ends there or later
        self.last = np.append(0, self.end_a)[np.cumsum(self.n_a)]
        self.doc = np.searchsorted(self.last, stretch)

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of integers, one for each link, by text."""
        before = np.append(0, np.cumsum(values))
        bounds = np.searchsorted(self.doc, np.arange(len(self.n_a) + 1))
        return before[bounds[1:]] - before[bounds[:-1]]

    def groups_by_doc(self) -> np.ndarray:
        return np.bincount(np.searchsorted(self.last, self.both), minlength=len(self.n_a))

    def printed(self) -> list[str]:
        """The groups of each text: A's ids, a bar, B's ids, with commas inside and semicolons between groups."""
        group_a, group_b = np.searchsorted(self.both, self.end_a), np.searchsorted(self.both, self.end_b)
        b_before = np.append(0, np.searchsorted(self.end_b, self.both, side="right"))  # tokens of B before each group
        a_until = np.searchsorted(self.end_a, self.both, side="right")  # tokens of A up to the end of each
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + b_before[group_a]] = 2 * self.a + (self.end_a == self.both[group_a])
        closes = (self.end_b == self.both[group_b]).astype(np.int64)
        closes[np.cumsum(self.n_b)[self.n_b > 0] - 1] = 2
        codes[np.arange(len(self.b)) + a_until[group_b]] = self.v.print_b + 3 * self.b + closes
        at = np.append(0, np.cumsum(self.n_a + self.n_b)).tolist()
        parts = list(map(self.v.printed.__getitem__, codes.tolist()))
        return ["".join(parts[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]


def _encode(paths: tuple[str, str]):
    def apply(batches):
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            for some in _runs([len(x) for x in texts]):
                ids = vocabularies(*paths).encode(texts[some])
                a, b = zip(*ids, strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[some], "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return apply


def _runs(sizes: list[int]):
    """Neighbours of about GROUP_BYTES together, as slices."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= GROUP_BYTES or i == len(sizes) - 1:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0


def _aligned(batches, paths):
    """Runs of documents: their part of a batch and their alignment."""
    v = vocabularies(*paths)
    for batch in batches:
        ids = list(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True))
        for some in _runs([2 * len(a) for a, _ in ids]):
            yield batch.slice(some.start, some.stop - some.start), Aligned(v, ids[some])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, once each, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _partial(paths: tuple[str, str]):
    """How many documents of a task hold each pair."""

    def rows(keys, counts):
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_pydict({"key": keys[i : i + (1 << 16)], "n": counts[i : i + (1 << 16)]})

    def apply(batches):
        v = vocabularies(*paths)
        pairs = len(v.bytes_a) * len(v.bytes_b)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, x in _aligned(batches, paths):
            # a pair counts once for each document, so documents and pairs are one number here
            own, n = np.unique(np.unique(x.doc * pairs + x.key) % pairs, return_counts=True)
            keys, counts = summed(np.concatenate((keys, own)), np.concatenate((counts, n)))
            if len(keys) >= HELD_KEYS:
                yield from rows(keys, counts)
                keys, counts = keys[:0], counts[:0]
        yield from rows(keys, counts)

    return apply


def _shards(folder: str, n_b: int, most: int):
    """Sums runs of equal keys of a sorted partition and writes them, a file for about ``most`` keys."""

    def write(keys, counts):
        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        name = uuid.uuid4().hex  # a repeated task writes other files; only those of the one that counts are ever named
        with store.open_output_stream(f"{place}/{name}") as out:
            out.write(np.concatenate((keys, counts)).astype("<i8").tobytes())
        a = keys // n_b
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        best = np.concatenate((a[first], np.maximum.reduceat(counts, first))).astype("<i8").tobytes()
        return pa.RecordBatch.from_pylist([{"name": name, "first_key": int(keys[0]), "size": len(keys), "best": best}], pa.schema([("name", pa.string()), ("first_key", pa.int64()), ("size", pa.int64()), ("best", pa.binary())]))

    def apply(batches):
        held_keys, held_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys, counts = summed(batch.column("key").to_numpy(), batch.column("n").to_numpy())
            held_keys, held_counts = summed(np.concatenate((held_keys, keys)), np.concatenate((held_counts, counts)))
            if len(held_keys) > most:  # the last key may go on
                yield write(held_keys[:-1], held_counts[:-1])
                held_keys, held_counts = held_keys[-1:], held_counts[-1:]
        if len(held_keys):
            yield write(held_keys, held_counts)

    return apply


@functools.lru_cache(64)
def mapped(uri: str) -> np.ndarray:
    """The 64-bit integers of a file, mapped into memory, or read where the shared folder is not mounted."""
    store, place = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(place, "<i8", "r")
    with store.open_input_file(place) as file:
        return np.frombuffer(file.read(), "<i8")


class Counts:
    """Sorted count shards of a folder: how many documents hold a pair, and the highest count of each id of A."""

    def __init__(self, folder: str, names: list[str], first_keys: list[int], sizes: list[int]):
        self.folder, self.names, self.sizes = folder, names, sizes
        self.first_keys = np.array(first_keys, np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key; 0 for one that no document holds."""
        own, where = np.unique(keys, return_inverse=True)
        out = np.zeros(len(own), np.int64)
        cuts = np.append(np.searchsorted(own, self.first_keys), len(own))
        for name, size, x, y in zip(self.names, self.sizes, cuts[:-1], cuts[1:], strict=True):
            if x < y:
                data = mapped(f"{self.folder}/{name}")
                at = np.minimum(np.searchsorted(data[:size], own[x:y]), size - 1)
                out[x:y] = np.where(data[at] == own[x:y], data[size + at], 0)
        return out[where]

    def best(self) -> np.ndarray:
        return mapped(f"{self.folder}/best")


def count_pairs(tokens: DataFrame, paths: tuple[str, str], shard_keys: int = 1 << 20) -> Counts:
    """Writes the sorted count shards of all documents' tokens to a new folder under the shared one."""
    spark = ready(tokens)
    folder = shared_dir(spark)
    v = vocabularies(*paths)
    partial = cut(tokens.mapInArrow(_partial(paths), "key long, n long"))
    parts = max(1, -(-partial.count() // shard_keys))
    by_key = partial.repartitionByRange(parts, "key").sortWithinPartitions("key")
    found = sorted(by_key.mapInArrow(_shards(folder, len(v.bytes_b), shard_keys), "name string, first_key long, size long, best binary").collect(), key=lambda r: r.first_key)
    best = np.zeros(len(v.bytes_a), np.int64)
    for r in found:
        a, n = np.frombuffer(r.best, "<i8").reshape(2, -1)
        best[a] = np.maximum(best[a], n)
    store, place = fs.FileSystem.from_uri(folder)
    store.create_dir(place, recursive=True)
    with store.open_output_stream(f"{place}/best") as out:
        out.write(best.astype("<i8").tobytes())
    return Counts(folder, [r.name for r in found], [r.first_key for r in found], [r.size for r in found])


def pair_counts(spark, counts: Counts, paths: tuple[str, str]) -> DataFrame:
    """a, b, n of every linked pair of ids, read from the shards, a row for each."""

    def apply(batches):
        n_b = len(vocabularies(*paths).bytes_b)
        for batch in batches:
            for name, size in zip(batch.column("name").to_pylist(), batch.column("size").to_pylist(), strict=True):
                data = mapped(f"{counts.folder}/{name}")
                for i in range(0, size, 1 << 16):
                    keys = data[i : min(i + (1 << 16), size)]
                    yield pa.RecordBatch.from_pydict({"a": keys // n_b, "b": keys % n_b, "n": data[size + i : size + i + len(keys)]})

    shards = spark.createDataFrame(list(zip(counts.names, counts.sizes, strict=True)), "name string, size long")
    return ready(shards) and shards.repartition(max(1, len(counts.names)), "name").mapInArrow(apply, "a long, b long, n long")


def _digest(paths: tuple[str, str], counts: Counts):
    def apply(batches):
        best = counts.best()
        for part, x in _aligned(batches, paths):
            n = counts.of(x.key)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "n_a": x.n_a,
                    "n_b": x.n_b,
                    "n_groups": x.groups_by_doc(),
                    "n_links": x.per_doc(np.ones(len(x.key), np.int64)),
                    "n_best": x.per_doc((n == best[x.key_a]).astype(np.int64)),
                    "count_sum": x.per_doc(n),
                    "groups": pa.array(x.printed(), pa.string()),
                }
            )

    return apply


def write_aligned_tokens(docs: DataFrame, path_a: str, path_b: str, folder: str) -> DataFrame:
    """Encodes each whole text by both tokenizers, with a space before it, and writes doc_id and both ids to ``folder``; returns that table."""
    ready(docs)
    docs = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shape = "doc_id long, a binary, b binary"
    docs.mapInArrow(_encode((path_a, path_b)), shape).write.option("compression", "zstd").mode("error").parquet(folder)
    return docs.sparkSession.read.schema(shape).parquet(folder)


def align(docs: DataFrame, path_a: str, path_b: str, shard_keys: int = 1 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of each document.

    ``path_a`` is a byte-level BPE file of the tokenizers library, ``path_b`` a sentencepiece model that puts a space before a text.
    A link is a token of A and one of B whose bytes overlap; the count of its ids is how many documents hold them linked; n_best are
    the links whose count is the highest of their A id, ties included, count_sum sums the counts of all links. groups has a group
    for each place where both end, as ``a1,a2|b1;a3|b2,b3``.

    A text that is null or empty, isn't valid UTF-8, or whose bytes either tokenizer doesn't give back has no tokens: zeros and ''.
    Null and repeated doc_ids: a document a row. Empty table: no rows. Other columns are ignored.
    """
    paths = path_a, path_b
    tokens = write_aligned_tokens(docs, *paths, shared_dir(ready(docs)))
    counts = count_pairs(tokens, paths, shard_keys)
    shape = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return tokens.mapInArrow(_digest(paths, counts), shape)
