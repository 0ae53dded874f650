"""Best-fit packing: every id of every document in its place, few sequences, whatever the partitions."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, ids string, number long, length int, piece int"


def texts(n=400, seed=3):
    rng = random.Random(seed)
    words = ["the", "House", "naïve", "ünïted", "don't", "42", "<|endoftext|>", "x" * 30, "…", "日本", "ok!"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 20, 60, 150]))), "a", 1, 1, 1) for i in range(n)]
    rows += [(9000 + i, rows[5][1], None, None, None, None) for i in range(100)] + [(1, rows[1][1], "a", 1, 1, 1), (None, "lost", "a", 1, 1, 1), (None, None, None, 1, 1, 1)]
    return rows + [(9500, None, "a", 1, 1, 1), (9501, "", "a", 1, 1, 1), (9502, "word " * 5000, "a", 1, 1, 1), (9503, " \n\t", "a", 1, 1, 1)]


def encoded(rows):
    t = Tokenizer.from_file(PATH)
    return [(i, np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")) for i, text, *_ in rows]


@pytest.mark.parametrize("parts,how", [(3, {}), (40, {"slack": 0, "fan_in": 4, "most_pieces": 50}), (20, {"slack": 30, "fan_in": 3})])
def test_packed_pieces(spark, parts, how):
    rows, cap = texts(), 256
    want = sorted((i is None, i or 0, p // cap, p, len(ids[p : p + cap]), zlib.crc32(ids[p : p + cap].tobytes())) for i, ids in encoded(rows) for p in range(0, len(ids), cap))
    got = packing.packed_pieces(spark.createDataFrame(rows, DOCS).repartition(parts), PATH, capacity=cap, **how).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= cap
    least = -(-sum(n for *_, n, _ in want) // cap)
    assert len(sequences) <= least * 1.02 + 1, (len(sequences), least)


def test_packed_sequences(spark):
    rows = texts(60)
    docs = spark.createDataFrame(rows, DOCS)
    whole = {}
    for i, ids in encoded(rows):
        whole.setdefault(i, []).append(ids)
    found = packing.packed_sequences(docs, PATH, capacity=512).collect()
    assert sum(r.n_ids for r in found) == sum(len(x) for own in whole.values() for x in own)
    for r in found:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.n_ids <= 512 and r.starts[0] == 0
        for i, a, b in zip(r.doc_ids, r.starts, [*r.starts[1:], r.n_ids], strict=True):
            assert any(np.array_equal(ids[a:b], x[p : p + 512]) for x in whole[i] for p in range(0, len(x), 512))
    assert packing.packed_sequences(docs.where("false"), PATH).count() == 0 and packing.packed_pieces(docs.where("false"), PATH).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_best_fit(seed):
    """As a plain search for the fullest bin with room."""
    rng = random.Random(seed)
    sizes = [rng.randint(1, 100) for _ in range(300)]
    room, want = [], []
    for i in sorted(range(300), key=lambda i: -sizes[i]):
        fits = [r for r in room if r >= sizes[i]]
        if fits:
            room[room.index(min(fits))] -= sizes[i]
        else:
            room.append(100 - sizes[i])
    want = sorted(room)
    got = packing.best_fit(sizes, 100)
    assert sorted(100 - sum(sizes[i] for i in b) for b in got) == want and sorted(i for b in got for i in b) == list(range(300))


def test_even_halves(spark):
    """Items that only fit two by two meet, also across tasks."""
    items = spark.range(4001).select(F.col("id").alias("number"), (F.lit(40) + F.col("id") % 2 * 20).cast("int").alias("length")).repartition(30)
    got = packing.pack(items, 100, fan_in=4)
    assert got.select("sequence_id").distinct().count() == 2001 and got.count() == 4001
