"""Byte-level BPE by the ranks of a vocabulary file, encoded by a sentencepiece model that is written from it.

The model is serialised here, field by field: one piece for each token, its bytes mapped to printable characters,
with minus its rank as its score, and a normaliser that changes nothing. Its merges, best score first and leftmost
among equals, are those of the ranks. A text is split by the vocabulary's pattern; each match is encoded by itself,
a match that is a token as a whole is that token. Decoding maps ids back to bytes.

Each task keeps the ids of the matches it has seen, in a table of bounded size that starts anew when full, and the model is built once per
worker from the vocabulary file, whose path is a parameter. No shuffle: a text is encoded where it is read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, ready

MEMO = 150_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints one, else one from U+0100 on, in order."""
    own = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
    other = [b for b in range(256) if b not in own]
    table = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [table[b] for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised model whose ids are the places in tokens; one more id stands for unknown and never occurs."""
    chars = byte_characters()
    # fixed numbers of the model format: ModelProto 1 pieces (1 piece, 2 score, 3 type), 2 trainer (3 model type,
    # 4 vocabulary size, 40 unknown id, 41 begin id, 42 end id, 43 padding id), 3 normaliser (1 name, 3 dummy prefix,
    # 4 remove extra spaces, 5 escape spaces); model type 2 is BPE, piece types 1 normal and 2 unknown
    minus_one = (1 << 64) - 1
    pieces = [_block(1, _block(1, "".join(chars[b] for b in t).encode()) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, 1)) for rank, t in enumerate(tokens)]
    unknown = _block(1, _block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + b"".join(_number(f, minus_one) for f in (41, 42, 43))
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + unknown + _block(2, trainer) + _block(3, normaliser)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank; the ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, filter(bytes.strip, lines))}
    return [ranks[i] for i in range(len(ranks))]


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        self.split = regex.compile(pattern).findall
        self.map = {b: c for b, c in enumerate(byte_characters())}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.same = list(range(len(self.tokens) + 1)).__getitem__  # one object for each id, however many entries hold it

    def _match(self, part: str) -> tuple[int, ...]:
        data = part.encode()
        whole = self.ids.get(data)
        ids = (whole,) if whole is not None else tuple(map(self.same, self.model.encode(data.decode("latin-1").translate(self.map))))
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(part) < 64:
            self.memo[part] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        known, out = self.memo.get, []
        for part in self.split(text):
            out += known(part) or self._match(part)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _encode(path: str, pattern: str):
    def apply(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            ids = [bpe.encode(x.as_py() or "") for x in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return apply


def bpe_encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids: the token ids of each whole text; null text: none."""
    ready(docs)
    docs = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_encode(path, pattern), "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, data: the bytes of the tokens of each row; null ids: empty."""

    def apply(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            data = [bpe.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "data": pa.array(data, pa.binary())})

    ready(encoded)
    return pick(encoded, doc_id="doc_id", ids="ids").mapInArrow(apply, "doc_id long, data binary")


def _round_trip(path: str, pattern: str):
    def apply(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            n, written, read = [], [], []
            for x in batch.column("text"):
                ids = bpe.encode(x.as_py() or "")
                n.append(len(ids))
                written.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                read.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": written, "decoded_sha256": read})

    return apply


def bpe_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each whole text and decodes its ids again.

    ids_sha256 is over decimal ids joined by commas, decoded_sha256 over the decoded bytes, both in lowercase hex. Null
    and empty texts have no tokens and the digests of nothing. Null and repeated ids pass through; other columns go.
    """
    ready(docs)
    docs = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_round_trip(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
