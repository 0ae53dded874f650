"""Token ids in binary shards, each with a minimal perfect hash index from document key to its place.

A shard is one row of a Parquet table in the shared folder, written and committed by Spark, so a lost or repeated
task leaves no half shard: ``payload`` holds the ids of its documents as little-endian unsigned 32-bit integers, in
ascending doc_id order, ``seeds``, ``prints`` and ``places`` are its index, ``bounds`` the offset of each document and
of the end. Shards close at about ``shard_ids`` ids, also between rows of one key, so no number of them makes a shard larger.

The index is hash-and-displace: keys are hashed to buckets of about four; from the largest bucket on, each finds a
pair of a hash turn and a shift that sends its keys to free slots, and the n keys fill n slots. A slot stores a 32-bit
fingerprint of its key, which tells absent keys, and the key's place. Looking up a key costs one hash, one bucket
and one slot, however many keys there are.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, cut, ids_of, mix, pick, ready, shared_dir

MEMO = 600_000
SHARD = "part int, shard int, first_id long, last_id long, n_docs long, n_ids long, payload binary, bounds binary, ids binary, seeds binary, prints binary, places binary"


def _hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each key: bucket hash, slot hash and fingerprint."""
    h = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return h >> np.uint64(32), mix(h + np.uint64(0x9E3779B97F4A7C15)), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _slots(slot: np.ndarray, turn, n: int) -> np.ndarray:
    """The slot of each slot hash in one of its turns, before the shift."""
    return (mix(slot + np.asarray(turn, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """seeds (two for each bucket), fingerprints and key numbers by slot, for different keys."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    buckets = -(-n // 4)
    bucket, slot, prints = _hashes(keys)
    bucket = (bucket % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=buckets)
    end = np.cumsum(size)
    seeds, taken, holder = np.zeros((buckets, 2), np.uint32), np.zeros(n, bool), np.zeros(n, np.uint32)
    free = None
    for b in np.argsort(-size, kind="stable"):
        own = order[end[b] - size[b] : end[b]]
        if not len(own):
            break
        if len(own) == 1:  # a single key goes to any slot that is left
            free = iter(np.flatnonzero(~taken)) if free is None else free
            at = np.array([next(free)])
            seeds[b] = 0, (at[0] - _slots(slot[own], 0, n)[0]) % n
        else:
            at = _displace(seeds[b], slot[own], taken, n)
        taken[at] = True
        holder[at] = own
    return seeds.ravel(), prints[holder], holder


def _displace(seed: np.ndarray, slot: np.ndarray, taken: np.ndarray, n: int) -> np.ndarray:
    """Sets the first pair of turn and shift that sends the keys of a bucket to different free slots."""
    shifts = np.arange(min(n, 256))
    for turn in range(1 << 20):
        base = _slots(slot, turn, n)
        if len(np.unique(base)) < len(base):
            continue
        for begin in range(0, n, len(shifts)):
            shift = shifts + begin
            at = (base[None, :] + shift[:, None]) % n
            good = np.flatnonzero(~taken[at].any(axis=1) & (shift < n))
            if len(good):
                seed[:] = turn, shift[good[0]]
                return at[good[0]]
    raise ValueError("two keys of an index have the same hash")


def look_up(keys: np.ndarray, seeds: np.ndarray, prints: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The number that each key was given when the index was built; -1 where the fingerprint differs."""
    n = len(prints)
    if not n:
        return np.full(len(keys), -1)
    bucket, slot, own = _hashes(keys)
    pair = seeds.reshape(-1, 2)[(bucket % np.uint64(len(seeds) // 2)).astype(np.int64)].astype(np.int64)
    at = (_slots(slot, pair[:, 0], n) + pair[:, 1]) % n
    return np.where(prints[at] == own, places[at].astype(np.int64), -1)


#: What a byte of a text belongs to: white space 0, which is dropped, or a word. In runs, of text whose ASCII letters are lower case,
#: letters, digits and other than ASCII bytes are told from the rest.
WORD_KINDS = np.array([0 if x in b" \t\n\r\f\v" else 1 for x in range(256)], np.uint8)
RUN_KINDS = np.array([2 if k and x < 0x80 and not (97 <= x <= 122 or 48 <= x <= 57) else k for x, k in enumerate(WORD_KINDS.tolist())], np.uint8)
BAR = b"|"
#: How the vocabulary marks a token that ends a word.
WORD_END = "</w>"
CONTROL = re.compile(rb"[\x00-\x1f\x7f]")


def lower(run: bytes) -> str:
    """A run as the tokenizer's normalizer has it, which may take a character apart."""
    return unicodedata.normalize("NFC", run.decode()).lower()


def plain(run: bytes) -> bool:
    """Whether a run's ids don't depend on its neighbours: its characters are all letters or digits, when normalised
    too, or all ASCII punctuation. Other characters could join the punctuation beside them."""
    if run[0] >= 0x80 or run[:1].isalnum():
        return run.isascii() or run.decode().isalnum() and lower(run).isalnum()
    return not CONTROL.search(run)


def letters(run: bytes) -> bool:
    """Whether a run is one word to the tokenizer."""
    return run.isalpha() if run.isascii() else run.decode().isalpha() and lower(run).isalpha()


def _parts(texts: list[bytes], kinds: np.ndarray) -> tuple[list[bytes], pa.Array, np.ndarray]:
    """The different stretches of one kind of byte in some texts, the number of each stretch in order, and where each text and the end start among those."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = kinds[data]
    edge = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1))  # the last byte is white space, so a part has an edge behind it
    own = np.flatnonzero(kind[edge])
    start = edge[own]
    offsets = np.append(0, np.cumsum(edge[own + 1] - start)) if len(own) else np.zeros(1, np.int64)
    parts = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(data[kind != 0])]).dictionary_encode()
    ends = np.cumsum([len(x) + 1 for x in texts])
    return parts.dictionary.to_pylist(), parts.indices, np.append(0, np.searchsorted(start, ends))


class Encoder:
    """Ids of whole texts, from those of their runs; the ids of runs already seen are kept, in a table of bounded size.

    The vocabulary is one for lower case that drops white space and merges within runs of letters and runs of
    punctuation, so the ids of most texts are those of their runs, one after the other. Texts with apostrophes
    (contractions cross runs), with ``<|`` (special tokens are in lower case) or with a run that isn't ``plain`` are
    encoded by words instead: white space ends every token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.runs: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.unsafe: set[bytes] = set()  # of runs
        (self.bar,) = self._ids(BAR)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.final = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a word
        self.final[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def _ids(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, memo: dict[bytes, bytes], parts: set[bytes], by_run: bool) -> None:
        if len(memo) + len(parts) > MEMO:
            memo.clear()
            if by_run:
                self.unsafe.clear()
        if by_run:
            self.unsafe.update(x for x in parts if not plain(x))
        # many parts are one text: words one after the other, as the last id of a word tells where it ends
        words = [x for x in parts if letters(x)]
        others = parts.difference(words)
        for some in (words[i : i + 4096] for i in range(0, len(words), 4096)):
            ids = self._ids(b" ".join(some))
            if not self._cut(memo, some, ids, *self._places(ids)):
                others.update(some)
        # and other parts with a bar between them; those that have a bar themselves are texts of their own
        barred = [x for x in others if BAR not in x]
        for some in (barred[i : i + 4096] for i in range(0, len(barred), 4096)):
            ids = self._ids(b" | ".join(some))
            bars = np.flatnonzero(ids == self.bar)
            if not self._cut(memo, some, ids, np.append(0, bars + 1), np.append(bars, len(ids))):
                raise ValueError("the tokenizer doesn't keep words apart")
        memo.update((x, self._ids(x).tobytes()) for x in others if BAR in x)

    def _places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word of a text starts and ends among its ids."""
        ends = np.flatnonzero(self.final[ids]) + 1
        return np.append(0, ends[:-1]), ends

    @staticmethod
    def _cut(memo: dict[bytes, bytes], parts: list[bytes], ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> bool:
        if len(end) != len(parts):
            return False
        data = ids.tobytes()
        memo.update(zip(parts, map(data.__getitem__, map(slice, (4 * start).tolist(), (4 * end).tolist())), strict=True))
        return True

    def _by(self, memo: dict[bytes, bytes], texts: list[bytes], by_run: bool) -> list[bytes | None]:
        """The ids of texts by their runs, or by their words; None for one with a run that isn't plain.

        Parts are numbered by Arrow, so Python looks only at the different ones of these texts.
        """
        parts, index, first = _parts(texts, RUN_KINDS if by_run else WORD_KINDS)
        ids = list(map(memo.get, parts))
        missing = {p for p, x in zip(parts, ids, strict=True) if x is None}
        if missing:
            if len(memo) + len(missing) > MEMO:  # the table starts anew, with these texts' parts
                missing = set(parts)
            self._learn(memo, missing, by_run)
            ids = list(map(memo.__getitem__, parts))
        found = pa.array(ids, pa.large_binary()).take(index)
        at = np.frombuffer(found.buffers()[1], np.int64, len(index) + 1)[first].tolist() if len(index) else [0] * len(first)
        data = memoryview(found.buffers()[2] or b"")
        good = np.ones(len(texts), bool)
        if by_run and self.unsafe:
            bad = np.fromiter(map(self.unsafe.__contains__, parts), bool, len(parts))
            upto = np.append(0, np.cumsum(bad[index.to_numpy()]))
            good = upto[first[1:]] == upto[first[:-1]]
        return [bytes(data[x:y]) if yes else None for x, y, yes in zip(at[:-1], at[1:], good.tolist(), strict=True)]

    def _groups(self, texts: list[bytes]):
        """A few texts at a time, so that what is learnt at once is bounded too."""
        group, size = [], 0
        for i, text in enumerate(texts):
            group.append(i)
            size += len(text)
            if size > 1 << 23 or i == len(texts) - 1:
                yield group
                group, size = [], 0

    def encode(self, texts: list[bytes], end: int) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with the end id."""
        last, out = np.array([end], "<u4").tobytes(), [b""] * len(texts)
        for group in self._groups(texts):
            easy = [i for i in group if b"'" not in texts[i] and b"<|" not in texts[i]]
            for i, ids in zip(easy, self._by(self.runs, [texts[i].lower() for i in easy], True), strict=True):
                out[i] = ids
            hard = [i for i in set(group) - set(easy)] + [i for i in easy if out[i] is None]
            for i, ids in zip(hard, self._by(self.words, [texts[i] for i in hard], False), strict=True):
                out[i] = ids
        return [x + last for x in out]


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _shard(part: int, number: int, ids: list[int], data: list[bytes]) -> dict:
    keys = np.array(ids, np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))  # the first row of each key
    seeds, prints, holder = build_index(keys[first])
    bounds = np.concatenate(([0], np.cumsum([len(x) // 4 for x in data])))
    return {
        "part": part, "shard": number, "first_id": ids[0], "last_id": ids[-1], "n_docs": len(ids), "n_ids": int(bounds[-1]), "payload": b"".join(data),
        "bounds": bounds.astype("<i8").tobytes(), "ids": keys.astype("<i8").tobytes(), "seeds": seeds.tobytes(), "prints": prints.tobytes(), "places": first[holder].astype(np.uint32).tobytes(),
    }


def _write(path: str, end: int, shard_ids: int):
    def apply(batches):
        part, number, ids, data, held = TaskContext.get().partitionId(), 0, [], [], 0
        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary()), ("bounds", pa.binary()), ("ids", pa.binary()), ("seeds", pa.binary()), ("prints", pa.binary()), ("places", pa.binary())])
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            for key, one in zip(ids_of(batch.column("doc_id")).tolist(), encoder(path).encode(texts, end), strict=True):
                if held >= shard_ids:
                    yield pa.RecordBatch.from_pylist([_shard(part, number, ids, data)], schema)
                    number, ids, data, held = number + 1, [], [], 0
                ids.append(key)
                data.append(one)
                held += len(one) // 4
        if ids:
            yield pa.RecordBatch.from_pylist([_shard(part, number, ids, data)], schema)

    return apply


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 2, shard_ids: int = 1 << 20) -> None:
    """Encodes each whole text by the tokenizer file at ``path``, ends it with ``end_id`` and writes shards to
    ``folder``, in ascending doc_id order.

    Null text: the end id alone. Null doc_id: last. Rows of one doc_id are neighbours, by a hash of their texts, and may
    fill several shards and tasks; its key leads to the first of a shard. Empty table: no shards. Other columns are ignored.
    """
    ready(docs)
    docs = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text").asc()]
    shards = docs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_write(path, end_id, shard_ids), SHARD)
    shards.write.option("compression", "zstd").mode("error").parquet(folder)


def _digest(batches):
    for batch in batches:
        for row in batch.to_pylist():
            keys, bounds = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["bounds"], "<i8")
            index = [np.frombuffer(row[c], np.uint32) for c in ("seeds", "prints", "places")]
            place = look_up(keys, *index)
            if (place < 0).any() or (keys[place] != keys).any():
                raise ValueError("an index of the token files doesn't fit its documents")
            # rows of one key follow the first of them
            place += np.arange(len(keys)) - np.searchsorted(keys, keys, side="left")
            view = memoryview(row["payload"])
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([row["part"]] * len(keys), pa.int32()),
                    "shard": pa.array([row["shard"]] * len(keys), pa.int32()),
                    "doc_id": pa.array(keys, pa.int64(), mask=keys == NO_ID),
                    "start": bounds[place],
                    "n_tokens": bounds[place + 1] - bounds[place],
                    "ids_crc32": pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(bounds[place], bounds[place + 1], strict=True)], pa.int64()),
                }
            )


def token_digest(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, looked up in the shards by its key.

    start counts the ids of all documents before it; ids_crc32 is over its little-endian 32-bit ids, end id included.
    """
    shards = spark.read.schema(SHARD).parquet(folder)
    # one row for each million ids, so this order is over a table that is far smaller than the documents
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    found = ready(shards) and shards.mapInArrow(_digest, "part int, shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(base, ["part", "shard"]).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def find_shards(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """part, shard, file, doc_id: the shards whose range of keys holds a key (doc_id, long), for each different one.

    Only the ranges of the shards are read. Keys and ranges meet in as many stretches of the key space as there are shards, so that all
    ranges together cover at most twice as many stretches, however unevenly keys lie.
    """
    ranges = shards.where(F.col("first_id") < NO_ID).select("part", "shard", "first_id", "last_id", F.col("_metadata.file_path").alias("file"))
    ends = F.greatest("first_id", F.when(F.col("last_id") < NO_ID, F.col("last_id")))  # documents of null ids end the last one
    n, low, high = ranges.agg(F.count("*"), F.min("first_id"), F.max(ends)).first()
    low = low or 0
    size = max(1, -(-((high or 0) - low + 1) // max(1, n)))
    # decimals, as a difference of two longs may be none
    exact = lambda x: F.lit(x).cast("decimal(20,0)")
    place = lambda c: F.least(F.floor((F.col(c).cast("decimal(20,0)") - exact(low)) / exact(size)).cast("long"), F.lit(n))
    covered = ranges.withColumn("place", F.explode(F.sequence(place("first_id"), place("last_id"))))
    wanted = keys.select("doc_id").distinct().where((F.col("doc_id") >= low) & (F.col("doc_id") < NO_ID)).withColumn("place", place("doc_id"))
    return covered.join(wanted, "place").where("doc_id between first_id and last_id").select("part", "shard", "file", "doc_id")


def _look_up_keys(batches):
    for batch in batches:
        for row in batch.to_pylist():
            bounds, own = np.frombuffer(row["bounds"], "<i8"), np.array(row["wanted"], np.int64)
            place = look_up(own, *[np.frombuffer(row[c], np.uint32) for c in ("seeds", "prints", "places")])
            own, place = own[place >= 0], place[place >= 0]
            same = np.frombuffer(row["ids"], "<i8")[place] == own  # an absent key may have a fingerprint of the index
            own, place = own[same], place[same]
            ids = [np.frombuffer(row["payload"], "<u4", bounds[p + 1] - bounds[p], 4 * bounds[p]).astype(np.int64) for p in place]
            at = [[row["part"], row["shard"]]] * len(own)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(own, pa.int64()), "at": pa.array(at, pa.list_(pa.int32())), "ids": pa.array(ids, pa.list_(pa.int64()))})


def get_tokens(spark, folder: str, keys: DataFrame | list[int]) -> DataFrame:
    """doc_id, ids of the documents with these keys, a table with the long column doc_id or a list.

    The ranges of all shards tell the files that can have a key; only those are read, and each key is looked up in the index of its shard. So
    a key costs its shard's file, which a task of the writer bounds, however large the store is. Absent and null keys give no row, repeated
    ones one; a key written twice gives its first row.
    """
    if not isinstance(keys, DataFrame):
        keys = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    wanted = cut(find_shards(spark.read.schema(SHARD).parquet(folder), keys))
    files = [r.file for r in wanted.select("file").distinct().collect()]
    shape = "doc_id long, at array<int>, ids array<long>"
    if not files:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    shards = spark.read.schema(SHARD).parquet(*files)
    own = wanted.groupBy("part", "shard").agg(F.collect_list("doc_id").alias("wanted"))  # no more keys than the shard has documents or gaps
    found = ready(shards) and shards.join(own, ["part", "shard"]).mapInArrow(_look_up_keys, shape)
    return found.groupBy("doc_id").agg(F.min_by("ids", "at").alias("ids"))


def token_store(docs: DataFrame, path: str, end_id: int = 2, shard_ids: int = 1 << 20) -> DataFrame:
    """Writes the documents' ids to a new folder under the shared one and reads them back; see ``write_tokens`` and
    ``token_digest``."""
    spark = ready(docs)
    folder = shared_dir(spark)
    write_tokens(docs, path, folder, end_id, shard_ids)
    return token_digest(spark, folder)
